"""File and finding inventories: code signals, declarations, equal content, changed paths, signal candidates, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.audit import beginnings
from brindle.operators.work import work_folder, written

# Words of a topic and the candidate type and probe that they stand for, first match wins.
CANDIDATE_RULES = [
    (("parallel", "orchestration", "graph"), "orchestration", "FI-01"),
    (("token", "context", "memory", "indexing"), "context_efficiency", "FI-02"),
    (("typed", "decision", "benchmark", "evaluation"), "decision_evaluation", "FI-03"),
    (("research", "evidence", "search"), "evidence_provenance", "FI-04"),
    (("resource", "inference", "runtime"), "resource_inference", "FI-05"),
    (("security", "supply", "terminal"), "security_reliability", "FI-06"),
    (("observability", "ci", "actions"), "observability_ci", "FI-07"),
    (("recovery", "browser", "agent"), "recovery_agent", "FI-08"),
    (("migration", "rust", "go", "typescript", "java", "kotlin", "net", "c++", "zig"), "migration_portability", "FI-09"),
]
OTHER_CANDIDATE = ("general_agent", "FI-11")

# What declares a function, by file extension; the name is the group.
_SCRIPT = r"(?m)^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_]\w*)\s*\("
DECLARATIONS = {
    ".py": r"(?m)^\s*(?:async\s+def|def)\s+([A-Za-z_]\w*)\s*\(",
    ".rs": r"(?m)^\s*(?:pub\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)\s*[\(<]",
    ".go": r"(?m)^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\(",
    ".ts": _SCRIPT,
    ".tsx": _SCRIPT,
    ".js": _SCRIPT,
    ".jsx": _SCRIPT,
    ".mjs": _SCRIPT,
    ".kt": r"(?m)^\s*(?:public\s+|private\s+|internal\s+|protected\s+|suspend\s+)*fun\s+([A-Za-z_]\w*)\s*\(",
    ".swift": r"(?m)^\s*(?:public\s+|private\s+|internal\s+|fileprivate\s+|mutating\s+|static\s+)*func\s+([A-Za-z_]\w*)\s*\(",
    ".nim": r"(?m)^\s*(?:proc|func|method|iterator|template)\s+([A-Za-z_]\w*)\b",
    ".zig": r"(?m)^\s*pub\s+fn\s+([A-Za-z_]\w*)\s*\(",
    ".gleam": r"(?m)^\s*(?:pub\s+)?fn\s+([A-Za-z_]\w*)\s*\(",
    ".php": r"(?m)^\s*(?:public|protected|private|static|\s)*function\s+([A-Za-z_]\w*)\s*\(",
}
# What tells that a source file runs other programs, uses the network, keeps state or is an entry point.
SIGNALS = {
    "has_subprocess": r"subprocess|os\.system|Popen",
    "has_exec_python": r"python(?:3)?\s+-m|sys\.executable",
    "has_network": r"requests|httpx|urllib|aiohttp",
    "has_state": r"sqlite|d1|redis|kv|durable|ledger|persistence",
    "worker_entrypoint": r"WorkerEntrypoint|export\s+default|async\s+def\s+scheduled\b|async\s+def\s+fetch\b",
    "main_entrypoint": r"""if\s+__name__\s*==\s*["']__main__["']""",
}
IMPORT = r"(?:^|\n)\s*(?:from|import)\s+([A-Za-z_][\w.]*)"
EXPORTED = r"(?m)^(?:async\s+)?(?:def|class)\s+\w+"
MAX_IMPORTS = 120
# Credential-like literals, by what they are.
LITERALS = [
    (r"""Authorization\s*[:=]\s*[`"']Bearer\s+[A-Za-z0-9._-]{20,}""", "high", "bearer credential"),
    (r"""(?i)(?:api[_-]?key|access[_-]?key|secret|password|token)\s*[:=]\s*["'][A-Za-z0-9_./+=:-]{24,}["']""", "high", "credential-like literal"),
]
#: Shingles of items, of 16 bytes each, that are broadcast at most.
FEW_SHINGLES = 250_000
#: Most findings and characters of a detail in a report.
MAX_FINDINGS, MAX_DETAIL = 40, 600


def candidate_type(topic: Column, focus: Column) -> Column:
    """struct(type, probe) of the first rule of which the topic or focus contains a word anywhere."""
    text = F.lower(F.concat_ws(" ", topic, focus))
    hit = lambda words: reduce(lambda a, b: a | b, [text.contains(w) for w in words])
    one = lambda kind, probe: F.struct(F.lit(kind).alias("type"), F.lit(probe).alias("probe"))
    (words, *first), *rest = CANDIDATE_RULES
    return reduce(lambda acc, r: acc.when(hit(r[0]), one(*r[1:])), rest, F.when(hit(words), one(*first))).otherwise(one(*OTHER_CANDIDATE))


def signal_candidates(jobs: DataFrame, most: int = 8) -> DataFrame:
    """A row for each job (job_id, topic, focus, target_issues, sources by kind, statuses) and issue that it targets.

    ``seeds``, ``repositories`` and ``issues`` are arrays of (title, url); the
    first ``most`` of them, in that order, support the candidate.
    """
    of = lambda name, kind: F.transform(F.coalesce(name, F.array().cast("array<struct<title:string,url:string>>")), lambda x: F.named_struct(F.lit("source_type"), F.lit(kind), F.lit("title"), x["title"], F.lit("url"), x["url"]))
    support = F.slice(F.concat(of("seeds", "seed"), of("repositories", "repository"), of("issues", "issue")), 1, most)
    kind = candidate_type(F.col("topic"), F.col("focus"))
    social = F.coalesce(F.col("reddit_status") == 200, F.lit(False)) | F.coalesce(F.col("x_status") == 200, F.lit(False))
    rows = jobs.select("job_id", "topic", kind.alias("k"), social.alias("social_signal_present"), support.alias("supporting_sources"), F.explode("target_issues").alias("issue"))
    return rows.select(F.concat_ws("-", F.col("job_id").cast("string"), "issue").alias("candidate_id"), "issue", "job_id",
        F.col("k.type").alias("candidate_type"), F.col("k.probe").alias("benchmark_probe"), "supporting_sources", "social_signal_present")


def code_signals(files: DataFrame, path: str, text: str) -> DataFrame:
    """path, imports (each once, in order, MAX_IMPORTS at most), n_exported and a flag for each of SIGNALS."""
    body = F.coalesce(F.col(text), F.lit(""))
    imports = F.slice(F.array_distinct(F.regexp_extract_all(body, F.lit(IMPORT), F.lit(1))), 1, MAX_IMPORTS)
    return files.select(path, imports.alias("imports"), F.regexp_count(body, F.lit(EXPORTED)).cast("long").alias("n_exported"), *[body.rlike(p).alias(n) for n, p in SIGNALS.items()])


def extension(path: Column) -> Column:
    """Last dot and what follows it in lower case, of the file name only; empty where there is none or the name begins with it."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def declarations(files: DataFrame, path: str, text: str) -> DataFrame:
    """(path, name, language): names that a file's functions declare, each once; files of other extensions have none."""
    body, ext = F.coalesce(F.col(text), F.lit("")), extension(F.col(path))
    by_pattern: dict[str, list[str]] = {}
    for e, p in DECLARATIONS.items():
        by_pattern.setdefault(p, []).append(e)
    (first, exts), *rest = by_pattern.items()
    names = lambda p: F.regexp_extract_all(body, F.lit(p), F.lit(1))
    found = reduce(lambda acc, r: acc.when(ext.isin(*r[1]), names(r[0])), rest, F.when(ext.isin(*exts), names(first)))
    return files.select(path, F.explode(F.array_distinct(found)).alias("name"), F.substring(ext, 2, 100).alias("language"))


def shared_declarations(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, n_left, n_right, left_path, right_path): names that both sides declare, ignoring case, with their first files.

    A name that many files declare gives one row, not all pairs of files.
    """
    side = lambda df, s: df.groupBy(F.lower("name").alias("key")).agg(F.count("*").alias(f"n_{s}"), F.min("path").alias(f"{s}_path"))
    return side(left, "left").join(side(right, "right"), "key").select("key", "n_left", "n_right", "left_path", "right_path")


def same_content(left: DataFrame, right: DataFrame, digest: str, path: str) -> DataFrame:
    """(digest, left_path, right_path): content that both sides have; of several paths of a digest the last counts."""
    side = lambda df, s: df.where(F.col(digest).isNotNull()).groupBy(F.col(digest).alias("digest")).agg(F.max(path).alias(f"{s}_path"))
    return side(left, "left").join(side(right, "right"), "digest")


def inventory_counts(files: DataFrame, path: str, covered: Column, *by: str) -> DataFrame:
    """(kind, value, n, coverage): files by extension and by each column of ``by``, with the per cent of them that are covered."""
    rows = files.select(F.coalesce(F.nullif(F.ltrim(extension(F.col(path)), F.lit(".")), F.lit("")), F.lit("[none]")).alias("extension"), *by, covered.alias("__c"))
    share = F.round(100 * F.avg(F.coalesce(F.col("__c"), F.lit(False)).cast("double")), 2).alias("coverage")
    kinds = ["extension", *by]
    # one pass over the rows for all columns
    sets = rows.groupingSets([[k] for k in kinds], *kinds).agg(F.grouping_id(*kinds).alias("g"), F.count("*").alias("n"), share)
    which = lambda i: (1 << len(kinds)) - 1 - (1 << (len(kinds) - 1 - i))
    kind = reduce(lambda acc, i: acc.when(F.col("g") == which(i), kinds[i]), range(1, len(kinds)), F.when(F.col("g") == which(0), kinds[0]))
    value = reduce(lambda acc, i: acc.when(F.col("g") == which(i), F.col(kinds[i]).cast("string")), range(1, len(kinds)), F.when(F.col("g") == which(0), F.col(kinds[0])))
    return sets.select(kind.alias("kind"), value.alias("value"), "n", "coverage")


def path_overlaps(findings: DataFrame, changed: DataFrame, reported: DataFrame | None = None) -> DataFrame:
    """(finding_id, n_files): findings (finding_id, severity, paths) that touch ``changed`` files (file) and aren't in ``reported`` (finding_id).

    A path touches a file that it equals, that lies below it, or that begins
    with what stands before its first star. Each of these is a single name or a
    beginning of names, and two beginnings hold the same files, one the other's,
    or none in common. So files are counted once for each beginning that is
    asked for, and a finding adds up the counts of those of its beginnings that
    no other one of its own holds; no pair of a finding and a file is made.
    Informational findings are left out.
    """
    asked = findings.where(F.col("severity") != "info").select("finding_id", F.explode("paths").alias("path")).where("path is not null")
    if reported is not None:
        asked = asked.join(reported.select("finding_id").distinct(), "finding_id", "left_anti")
    one = lambda key, equal: F.struct(key.alias("key"), F.lit(equal).alias("equal"))
    rules = F.array_compact(F.array(
        one(F.col("path"), True), one(F.concat(F.rtrim("path", F.lit("/")), F.lit("/")), False),
        F.when(F.col("path").contains("*"), one(F.substring_index("path", "*", 1), False))))
    ruled = asked.select("finding_id", F.explode(rules).alias("r")).select("finding_id", "r.*").distinct()
    keys = ruled.select("key", "equal").distinct()
    files = changed.select("file").where("file is not null").distinct()
    # the lengths that occur: few, as they are bounded by the length of a path
    sizes = F.broadcast(keys.where("not equal").select(F.length("key").alias("size")).distinct())
    heads = files.join(sizes, F.length("file") >= F.col("size")).select(F.expr("left(file, size)").alias("key"), F.lit(False).alias("equal"))
    held = keys.join(heads.groupBy("key", "equal").agg(F.count("*").alias("n")).unionByName(files.select(F.col("file").alias("key"), F.lit(True).alias("equal"), F.lit(1).cast("long").alias("n"))), ["key", "equal"])
    found = ruled.join(held, ["key", "equal"]).groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct("key", "equal", "n"))).alias("r"))
    # in order of names what a beginning holds follows it at once
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, r: Column) -> Column:
        inside = F.coalesce(F.startswith(r["key"], acc["last"]), F.lit(False))
        return F.when(inside, acc).otherwise(F.struct(F.when(r["equal"], acc["last"]).otherwise(r["key"]).alias("last"), (acc["n"] + r["n"]).alias("n")))

    return found.select("finding_id", F.aggregate("r", start, add)["n"].alias("n_files"))


def missing_paths(catalog: DataFrame, inventory: DataFrame, path: str) -> DataFrame:
    """(source, path): paths that a catalog names and the inventory lacks, be it as a file or as a folder of one."""
    parts = F.split(path, "/")
    there = inventory.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("key")).distinct()
    named = catalog.where(F.trim(F.coalesce(path, F.lit(""))) != "").select("source", path, F.rtrim(path, F.lit("/")).alias("key"))
    return named.join(there, "key", "left_anti").select("source", path).distinct()


def missing_anchors(surfaces: DataFrame, anchors: DataFrame) -> DataFrame:
    """(surface, anchor): anchors that a surface must have and that no row of ``surfaces`` (surface, anchor) gives it."""
    return anchors.select("surface", "anchor").distinct().join(surfaces.select("surface", "anchor").distinct(), ["surface", "anchor"], "left_anti")


def ordered_findings(findings: DataFrame) -> DataFrame:
    """Findings by document, line and kind."""
    return findings.orderBy("document", "line", "kind")


def report_findings(findings: DataFrame, gates: DataFrame, most: int = MAX_FINDINGS) -> DataFrame:
    """(source, kind, document, line, detail): the first ``most`` findings, details cut to MAX_DETAIL, then failures of ``gates`` (gate, status).

    The limit is the report's; findings come by document, line and kind, gate
    failures after them by name.
    """
    cut = lambda c: F.left(F.coalesce(c, F.lit("")), F.lit(MAX_DETAIL))
    text = lambda name, other: F.coalesce(F.col(name).cast("string"), F.lit(other))
    own = findings.select(F.lit(0).alias("o"), F.lit("instruction-audit").alias("source"), text("kind", "finding").alias("kind"), text("document",
        "unknown").alias("document"), F.col("line").cast("long").alias("l"), text("line", "?").alias("line"), cut(F.col("detail")).alias("detail"))
    failed = gates.where(F.upper("status").isin("FAIL", "FAILED", "BLOCKED"))
    gate = failed.select(F.lit(1).alias("o"), F.lit("aggregate-benchmark").alias("source"), F.lit("hard-gate-failure").alias("kind"),
        F.lit("gates").alias("document"), F.lit(None).cast("long").alias("l"), F.lit("?").alias("line"), cut(F.concat_ws("=", "gate",
        F.upper("status"))).alias("detail"))
    return own.unionByName(gate).orderBy("o", "document", "l", "kind", "detail").limit(most).select("source", "kind", "document", "line", "detail")


def literal_findings(files: DataFrame, path: str, text: str, markers: list[str] = (), exempt: DataFrame | None = None) -> DataFrame:
    """(path, line, label): lines with a credential-like literal or one of ``markers``, without paths that begin with a prefix of ``exempt`` (prefix)."""
    rules = [(p, label) for p, _, label in LITERALS] + [(f"\\Q{m}\\E", "protected marker") for m in markers]
    lines = files.select(path, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("i", "raw"))
    hits = F.array_distinct(F.array_compact(F.array(*[F.when(F.col("raw").rlike(p), label) for p, label in rules])))
    found = lines.select(path, (F.col("i") + 1).alias("line"), F.explode(hits).alias("label"))
    if exempt is None:
        return found
    # paths that begin with an exempt prefix are found by an equi-join of their beginnings
    free = found.select(path).distinct().withColumn("prefix", F.explode(beginnings(F.col(path), exempt))).join(exempt, "prefix", "left_semi").select(path).distinct()
    return found.join(free, path, "left_anti")


def near_passages(docs: DataFrame, items: DataFrame, doc: str, item: str, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc, item, n_shared): texts of which ``items`` hold most: over ``percent`` per cent of the item's distinct ``width``-word shingles occur in the text.

    Shingles meet by hash; an item is met by counts, not by all pairs of texts.
    Null and shorter texts have no shingles.
    """
    def shingles(df: DataFrame, key: str) -> DataFrame:
        words = df.select(F.col(key), F.split(F.lower(F.trim(F.coalesce("text", F.lit("")))), r"\s+").alias("w"))  # split once, not in each step below
        grams = F.transform(F.sequence(F.lit(0), F.size("w") - width), lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(width)]))
        return words.where(F.size("w") >= width).select(F.col(key), F.explode(F.array_distinct(grams)).alias("h"))

    own = written(shingles(items, item), work_folder(items.sparkSession, "shingles"))
    if own.count() <= FEW_SHINGLES:
        own = F.broadcast(own)
    sizes = own.groupBy(item).agg(F.count("*").alias("size"))
    shared = shingles(docs, doc).join(own, "h").groupBy(doc, item).agg(F.count("*").alias("n_shared"))
    return shared.join(sizes, item).where(F.col("n_shared") * 100 >= F.col("size") * percent).select(doc, item, "n_shared")
