"""What a file of a repository is and where it belongs, who mentions it, and how complete a registry of components is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class of a path, the first pattern that matches counts.
CLASSES = [
    (r"(^|/)tests?/|(^|/)test_[^/]+\.py$", "test"),
    (r"(^|/)benchmark/", "benchmark"),
    (r"(^|/)(tools|scripts)/", "tooling"),
    (r"/(archive|history|retired)/", "archive"),
    (r"^(foundation_core|backend|private|extractor_mapper)/|(^|/)(worker|foundation_worker)\.py$", "runtime"),
]
# Where a file should go by what its path says, before its class decides: pattern, language, disposition, confidence.
OWNERS = [
    (r"private/(policy|resource_ledger|durable_resource_ledger|promotion|artifact_manifest|audit_provenance|replay|idempotency)|backend/persistence", "retain-python", "RETAIN", 0.98),
    (r"(?i:url|canonical)|text_normalization|html_kernel|jsonld|robots|sitemap|link_pagination|product_mapping", "rust", "MIGRATE", 0.90),
    (r"(?i)edge|sse|search|browser|endpoint|acquisition|next_data|stream", "typescript", "MIGRATE", 0.90),
    (r"(?i)fanout", "go", "MIGRATE", 0.90),
]
# The same by class.
BY_CLASS = {
    "tooling": ("node-or-shell", "MIGRATE", 0.85), "test": ("follow-production-owner", "FOLLOW", 0.99),
    "benchmark": ("follow-production-owner", "FOLLOW", 0.99), "archive": ("none", "ARCHIVE", 1.0),
}
UNDECIDED = ("review-required", "REVIEW REQUIRED", 0.0)
# What in a path speaks for which domain of work, whatever its case.
DOMAINS = {
    "extractor": ["extractor_mapper", "extractor", "commerce-feed", "woocommerce"],
    "mapper": ["mapper", "mapping", "product_mapper"],
    "chatbot": ["private/chatbot", "chatbot", "heroic"],
    "provider": ["provider", "model", "llm", "ai-agent"],
    "runtime": ["worker", "runtime", "browser", "resource", "durable"],
    "security": ["security", "secret", "auth", "trust", "moderation", "prompt"],
    "repository": ["REPOSITORY_MAP.json", "docs/AI_PROJECT_MAP.json", ".github"],
    "polyglot": ["polyglot", "language", "migration", "rust", "typescript"],
    "documentation": ["docs/", "README.md", ".md"],
    "dependencies": ["package.json", "requirements", "pyproject.toml", "uv.lock", "poetry.lock"],
    "workflows": [".github/workflows/", ".github/actions/"],
    "tests": ["tests/", "test_"],
}
# Bytes and lines from which a source is looked at, and critical; folders of what is made or kept.
ATTENTION, CRITICAL = (25_000, 500), (50_000, 1000)
MADE = r"docs/HISTORY/|docs/history/|/runtime-evidence/"
#: Weight of each of the five parts of a completeness score.
WEIGHT = 0.20


def normal(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def path_class(path: Column) -> Column:
    """test, benchmark, tooling, archive, runtime or other."""
    p = normal(path)
    (first, name), *more = CLASSES
    return reduce(lambda acc, r: acc.when(p.rlike(r[0]), r[1]), more, F.when(p.rlike(first), name)).otherwise("other")


def path_target(path: Column) -> Column:
    """struct(language, disposition, confidence): where a file should go, by its path and then by its class."""
    answer = lambda a: F.struct(F.lit(a[0]).alias("language"), F.lit(a[1]).alias("disposition"), F.lit(float(a[2])).alias("confidence"))
    p, kind = normal(path), path_class(path)
    (first, *what), *more = OWNERS
    out = reduce(lambda acc, r: acc.when(p.rlike(r[0]), answer(r[1:])), more, F.when(p.rlike(first), answer(what)))
    return reduce(lambda acc, k: acc.when(kind == k, answer(BY_CLASS[k])), BY_CLASS, out).otherwise(answer(UNDECIDED))


def path_domains(path: Column) -> Column:
    """Sorted domains that a path speaks for; repository where it speaks for none."""
    low = F.lower(path)
    hits = [F.when(reduce(lambda a, b: a | b, [low.contains(n.lower()) for n in needles]), name) for name, needles in DOMAINS.items()]
    found = F.array_sort(F.array_compact(F.array(*hits)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("repository")))


def source_sizes(files: DataFrame, path: str, text: str) -> DataFrame:
    """(path, n_bytes, n_lines, severity, made) of large sources; ``made`` are generated or historical ones. An empty text is one line."""
    t = F.coalesce(F.col(text), F.lit(""))
    sized = files.select(path, F.octet_length(t).cast("long").alias("n_bytes"), F.size(F.split(t, "\n", -1)).cast("long").alias("n_lines"))
    over = lambda b: (F.col("n_bytes") > b[0]) | (F.col("n_lines") > b[1])
    severity = F.when(over(CRITICAL), "critical").when(over(ATTENTION), "attention")
    return sized.withColumns({"severity": severity, "made": normal(F.col(path)).rlike(MADE)}).where("severity is not null")


def module_references(files: DataFrame, path: str, text: str, ending: str = ".py") -> DataFrame:
    """(module, file): files that aren't modules and name one, by its path or by its dotted name.

    Words that look like a path or a dotted name are taken out of the texts,
    with all that is left of them when folders before are dropped, and join the
    modules' names; no text is searched for each module.
    """
    is_module = F.col(path).endswith(ending)
    # a module that many rows give is one module, or it would meet what names it once a row
    own = files.where(is_module).select(F.col(path).alias("module")).distinct()
    dotted = F.translate(F.expr(f"left(module, length(module) - {len(ending)})"), "/", ".")
    names = own.select("module", F.explode(F.array(F.col("module"), dotted)).alias("name"))
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"([A-Za-z0-9_-]+(?:[./][A-Za-z0-9_-]+)+)"))
    cut = lambda w, sep: F.transform(F.sequence(F.lit(1), F.size(F.split(w, sep))), lambda i: F.array_join(F.slice(F.split(w, sep), i, 1 << 20), sep.strip("\\")))
    words = files.where(~is_module).select(F.col(path).alias("file"), F.explode(F.array_distinct(found)).alias("w"))
    tails = words.select("file", F.explode(F.when(F.col("w").contains("/"), cut(F.col("w"), "/")).otherwise(cut(F.col("w"), r"\."))).alias("name")).distinct()
    return tails.join(names, "name").select("module", "file").distinct()


def completeness_report(components: DataFrame, keys: list[str], required: list[str], known: DataFrame, controls: tuple[str, ...], links: DataFrame) -> DataFrame:
    """One row a registry (``keys``): per cent of components with all fields, known references and all controls, navigation, contract, score and PASS or FAIL.

    ``components``: keys, component, the ``required`` fields, references (array
    of names) and tags (array). ``known`` has the names there are (name),
    ``links`` the components that can be reached (keys, component). Navigation is
    100 if all can be reached and nothing else is linked, else 0; the contract
    is 100 if nothing at all is wrong. Each of the five counts a fifth.
    """
    asked = components.select(*keys, "component", F.explode("references").alias("name"))
    lost = asked.join(known.select("name").distinct(), "name", "left_anti").groupBy(*keys, "component").agg(F.count("*").alias("n_lost"))
    there = links.select(*keys, "component").distinct().withColumn("linked", F.lit(True))
    full = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in required])
    rows = components.select(*keys, "component", full.alias("fields"), (F.size(F.array_except(F.array(*[F.lit(c) for c in controls]), F.coalesce("tags", F.array().cast("array<string>")))) == 0).alias("controls"), F.lit(True).alias("own"))
    rows = rows.join(lost, [*keys, "component"], "left").join(there, [*keys, "component"], "full_outer").withColumn("own", F.coalesce("own", F.lit(False)))
    own = F.col("own")
    share = lambda c: F.round(100 * F.count_if(own & c) / F.greatest(F.count_if(own), F.lit(1)), 2)
    g = rows.groupBy(*keys).agg(
        F.count_if(own).alias("n"), share(F.col("fields")).alias("registry"), share(F.col("n_lost").isNull()).alias("references"), share(F.col("controls")).alias("controls"),
        F.when(F.count_if(own & F.col("linked").isNull()) + F.count_if(~own) > 0, 0.0).otherwise(100.0).alias("navigation"))
    whole = reduce(lambda a, b: a & b, [F.col(c) == 100 for c in ("registry", "references", "controls", "navigation")])
    g = g.withColumn("contract", F.when(whole, 100.0).otherwise(0.0))
    score = reduce(lambda a, b: a + b, [F.col(c) * WEIGHT for c in ("registry", "references", "controls", "navigation", "contract")])
    return g.withColumns({"score": F.round(score, 2), "status": F.when(F.col("contract") == 100, "PASS").otherwise("FAIL")})
