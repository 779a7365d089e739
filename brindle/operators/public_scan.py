"""What a public repository must not hold: private imports, paths and revisions, endpoints outside their modules, credentials, unpinned steps, names used too often."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.inventory import LITERALS
from brindle.operators.surfaces import normal

# Where a mention of something private does no harm, and where steps are run.
HARMLESS = r"^(docs|tests|benchmark)/|/tests/|_test\.py$"
WORKFLOW = r"^\.github/workflows/"
# Rules of a public surface with what they say.
SAID = {
    "private-marker": "public source contains a protected marker",
    "credential-literal": "public source contains a hard-coded credential",
    "private-reference": "public runtime source contains a private implementation import/path",
    "private-revision": "public runtime source embeds an immutable private revision",
    "workflow-private-execution": "public workflow directly executes private code",
}
# Hosts of model providers, modules that may name them, and what looks like a credential.
PROVIDER_HOSTS = [
    "api.groq.com", "generativelanguage.googleapis.com", "openrouter.ai", "api.cerebras.ai",
    "api.siliconflow.cn", "integrate.api.nvidia.com", "api.cohere.com", "api-inference.huggingface.co",
]
PROVIDER_MODULES = r"provider_catalog|provider_runtime|provider_configuration|provider_retry"
SECRET_LIKE = r"sk-[A-Za-z0-9]{20,}|gh[pousr]_[A-Za-z0-9]{20,}|AIza[0-9A-Za-z_-]{20,}"
# Endings of the files that each rule looks at.
CALLERS, CONFIGURED, IMPLEMENTED = r"\.(mjs|cjs|js|ts|tsx|py)$", r"\.(mjs|cjs|js|ts|tsx|py|yml|yaml|json|toml)$", r"\.(mjs|cjs|js|ts|py)$"
# Messages of findings; a finding's fingerprint depends on them.
MISSING = "Required canonical file is missing: "
UNPINNED = "GitHub Action is not pinned to a full commit SHA: "
ENDPOINT = "Direct external provider endpoint outside canonical provider modules: "
SECRET = "Credential-shaped literal detected; authoritative secret validation remains with the dedicated secret-scan workflow."
SAME_NAME = ('Multiple implementation files share basename "', '". Review for duplicate authority.')
OVERLAP = ('Potentially overlapping workflow family: "', '".')
#: Paths shown of a group of equal names, of a family of workflows.
SHOWN_NAMES, SHOWN_FAMILY = 8, 10


def quoted(text: str) -> str:
    """A text as a pattern that matches it alone."""
    return "".join(c if c.isalnum() or c in "_/-" else f"\\{c}" for c in text)


def private_rules(package: str, folder: str, repository: str) -> dict[str, str]:
    """Patterns by rule for one private package, folder and repository."""
    alone = r"(?<![A-Za-z0-9_.-])"
    package, folder, repository = quoted(package), quoted(folder), quoted(repository)
    return {
        "private-reference": rf"{alone}(?:from|import)\s+{package}\.[A-Za-z0-9_.]+|{alone}{folder}/[A-Za-z0-9_./-]+",
        "private-revision": rf"{repository}@[0-9a-f]{{40}}",
        "workflow-private-execution": rf"(?:python|python3|node|deno|go|cargo\s+run)[ \t]+(?:{folder}|[^\n]*/{folder})",
    }


def private_findings(files: DataFrame, path: str, text: str, rules: dict[str, str], markers: list[str] = (), approved: list[str] = (), own: list[str] = ()) -> DataFrame:
    """(path, rule, message): what files give away, one row a file and rule.

    References and revisions count outside of documents, tests, benchmarks,
    workflows and ``approved`` paths; execution counts in workflows that aren't
    approved. Credentials and ``markers`` count everywhere but in the ``own``
    paths of the scan. Null texts have no findings, rows that repeat a path
    none of their own; a null path is nowhere special.
    """
    p, t = normal(F.coalesce(path, F.lit(""))), F.coalesce(F.col(text), F.lit(""))
    among = lambda paths: p.isin(*paths) if paths else F.lit(False)
    harmless = p.rlike(f"{HARMLESS}|{WORKFLOW}") | among(approved)
    contains = [t.contains(m) for m in markers]
    found = {
        "private-marker": ~among(own) & reduce(lambda a, b: a | b, contains, F.lit(False)),
        "credential-literal": ~among(own) & reduce(lambda a, b: a | b, [t.rlike(x) for x, _, _ in LITERALS]),
        "private-reference": ~among(own) & ~harmless & t.rlike(rules["private-reference"]),
        "private-revision": ~among(own) & ~harmless & t.rlike(rules["private-revision"]),
        "workflow-private-execution": p.rlike(WORKFLOW) & ~among(approved) & t.rlike(rules["workflow-private-execution"]),
    }
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule"), F.lit(SAID[r]).alias("message"))) for r, c in found.items()]))
    return files.select(p.alias("path"), F.explode(hits).alias("h")).select("path", "h.rule", "h.message").distinct()


def _finding(severity: str, kind: str, message: Column, evidence: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), message.alias("message"), evidence.cast("array<string>").alias("evidence"))


def _in_text(p: Column, t: Column, hosts: list[str]) -> list[Column]:
    """Arrays of findings of one file: steps that aren't pinned, hosts called directly, what looks like a credential."""
    lines = F.split(t, "\r?\n", -1)
    ref = lambda line: F.regexp_extract(line, r"uses:\s*([^\s#]+)@([^\s#]+)", 2)
    loose = F.filter(F.transform(lines, lambda line, i: F.struct(ref(line).alias("ref"), (i + 1).alias("line"))), lambda r: (r["ref"] != "") & ~r["ref"].rlike("^[0-9a-f]{40}$"))
    steps = F.transform(loose, lambda r: _finding("warning", "unpinned_action", F.concat(F.lit(UNPINNED), r["ref"]), F.array(F.concat(p, F.lit(":"), r["line"].cast("string")))))
    called = F.filter(F.array(*[F.lit(h) for h in hosts]).cast("array<string>"), lambda h: t.contains(h))
    calls = F.transform(called, lambda h: _finding("warning", "direct_provider_endpoint", F.concat(F.lit(ENDPOINT), h), F.array(h)))
    secret = F.array(_finding("warning", "secret_like_literal", F.lit(SECRET), F.array(p)))
    return [
        F.when(p.rlike(WORKFLOW) & p.endswith(".yml") & t.contains("uses:"), steps),
        F.when(p.rlike(CALLERS) & ~p.rlike(PROVIDER_MODULES), calls),
        F.when(p.rlike(CONFIGURED) & t.rlike(SECRET_LIKE), secret),
    ]


def _clusters(paths: DataFrame, name: Column, least: int, shown: int, kind: str, said: tuple[str, str]) -> DataFrame:
    """A finding for each name of ``least`` or more paths, at the first of them, with the first ``shown`` as evidence.

    A name may have very many paths: they are counted, and only the first of
    them are gathered, cut down in each task before the shuffle.
    """
    named = paths.select(name.alias("name"), "path")
    many = named.groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("first")).where(F.col("n") >= least)
    place = F.row_number().over(Window.partitionBy("name").orderBy("path"))
    few = named.withColumn("place", place).where(F.col("place") <= shown).groupBy("name").agg(F.array_sort(F.collect_list("path")).alias("some"))
    message = F.concat(F.lit(said[0]), "name", F.lit(said[1]))
    return many.join(few, "name").select(F.col("first").alias("path"), _finding("info", kind, message, F.col("some")).alias("f"))


def surface_findings(files: DataFrame, path: str, text: str, required: list[str] = (), hosts: list[str] = PROVIDER_HOSTS) -> DataFrame:
    """(severity, kind, path, message, evidence, fingerprint) of a repository's files.

    Missing ``required`` files, workflow steps that aren't pinned to a commit,
    provider hosts outside their modules, credential-like literals, three or
    more implementation files of one name, and workflows whose names differ by
    version or number only. Whole texts are read. The fingerprint is the
    first 16 hex digits of the SHA-256 of severity, kind, path and message as
    JSON. Rows of one path count as one file; null paths are left out, null
    texts are empty.
    """
    rows = files.where(F.col(path).isNotNull()).select(normal(F.col(path)).alias("path"), F.coalesce(text, F.lit("")).alias("text"))
    hits = F.flatten(F.array_compact(F.array(*_in_text(F.col("path"), F.col("text"), list(hosts)))))
    inside = rows.select("path", F.explode(hits).alias("f"))
    paths = rows.select("path").distinct()
    base = F.regexp_extract("path", "([^/]*)$", 1)
    same = _clusters(paths.where(F.lower(base).rlike(IMPLEMENTED)), F.lower(base), 3, SHOWN_NAMES, "duplicate_filename_cluster", SAME_NAME)
    family = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r"\.yml$", ""), r"-v\d+(?:-v\d+)*$", ""), r"\d+$", "")
    flows = paths.where(F.col("path").rlike(WORKFLOW) & F.col("path").endswith(".yml"))
    overlap = _clusters(flows, F.regexp_replace(family, "[-_]+", " "), 2, SHOWN_FAMILY, "workflow_overlap_cluster", OVERLAP)
    asked = files.sparkSession.createDataFrame([(r,) for r in required], "path string")
    lost = asked.join(paths, "path", "left_anti").select("path", _finding("critical", "missing_required_file", F.concat(F.lit(MISSING), "path"), F.array()).alias("f"))
    every = inside.unionByName(same).unionByName(overlap).unionByName(lost).select("f.severity", "f.kind", "path", "f.message", "f.evidence").distinct()
    digest = F.sha2(F.to_json(F.struct("severity", "kind", "path", "message")), 256)
    return every.withColumn("fingerprint", F.left(digest, F.lit(16)))
