"""Rules on file names: forbidden paths, groups whose sides must change together, clusters of like names, hygiene."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Artifacts that shouldn't be kept with sources, folders where dated documents may lie.
FORBIDDEN = ["**/__pycache__/**", "*.coverage", "*.pyc", "*.pyo", ".pytest_cache/**", "coverage.xml", "htmlcov/**", "node_modules/**", ".DS_Store"]
DATED_ALLOWED = ["docs/history/", "docs/HISTORY/", "docs/feed-lab/", "docs/runtime/"]
DATED = r"(?:19|20)\d{2}[-_]\d{2}[-_]\d{2}"
SOURCE_NAME = r"\.(mjs|cjs|js|ts|py)$"


def glob_regex(glob: str, star_crosses: bool = False) -> str:
    """Regular expression of a glob: ** any text, * any text within a folder, or any at all with ``star_crosses``, ? one character."""
    star = ".*" if star_crosses else "[^/]*"
    parts = re.split(r"(\*\*|\*|\?)", glob)
    return "^" + "".join({"**": ".*", "*": star, "?": "."}.get(x, f"\\Q{x}\\E" if x else "") for x in parts) + "$"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def any_glob(path: Column, globs: list[str], star_crosses: bool = False) -> Column:
    return reduce(lambda a, b: a | b, [path.rlike(glob_regex(g, star_crosses)) for g in globs])


def path_findings(paths: DataFrame, path: str, rules: list[tuple[str, str]]) -> DataFrame:
    """(path, code) for each rule (glob, code) that a path matches; a star matches across folders."""
    codes = F.array_compact(F.array(*[F.when(F.col(path).rlike(glob_regex(g, True)), code) for g, code in rules]))
    return paths.select(path, F.explode(F.array_distinct(codes)).alias("code"))


def paired_changes(files: DataFrame, path: str, changed: Column, groups: dict[str, tuple[list[str], list[str], bool]]) -> DataFrame:
    """(group, n_matched, n_changed, n_docs_changed, problem) by one pass over ``files``.

    A group has globs of sources, paths of documents, and whether a change of
    the one asks for a change of the other. problem is no_match,
    missing_document, change_without_document or ''.
    """
    p, c = F.col(path), F.coalesce(changed, F.lit(False))
    flags = []
    for i, (globs, docs, _) in enumerate(groups.values()):
        hit, doc = any_glob(p, globs), p.isin(*docs)
        flags += [F.count_if(hit).alias(f"m{i}"), F.count_if(hit & c).alias(f"c{i}"), F.count_if(doc & c).alias(f"d{i}"), (F.count_distinct(F.when(doc, p)) < len(set(docs))).alias(f"l{i}")]
    one = files.agg(*flags)
    rows = []
    for i, (name, (_, _, asks)) in enumerate(groups.items()):
        m, n, d, lacks = (F.col(f"{x}{i}") for x in "mcdl")
        problem = F.when(m == 0, "no_match").when(lacks, "missing_document").when(F.lit(asks) & (n > 0) & (d == 0), "change_without_document").otherwise("")
        rows.append(F.struct(F.lit(name).alias("group"), m.alias("n_matched"), n.alias("n_changed"), d.alias("n_docs_changed"), problem.alias("problem")))
    return one.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def name_clusters(paths: DataFrame, path: str, least: int = 3) -> DataFrame:
    """(name, n, first_path): source file names, in lower case, that ``least`` files or more bear."""
    named = paths.select(F.lower(base_name(F.col(path))).alias("name"), path).where(F.col("name").rlike(SOURCE_NAME))
    return named.groupBy("name").agg(F.count("*").alias("n"), F.min(path).alias("first_path")).where(F.col("n") >= least)


def version_families(paths: DataFrame, path: str) -> DataFrame:
    """(family, n, first_path): names without extension, version marks and closing digits that several files share."""
    stem = F.regexp_replace(F.regexp_replace(base_name(F.col(path)), r"\.[^.]*$", ""), r"-v\d+(?:-v\d+)*$", "")
    family = F.regexp_replace(F.regexp_replace(stem, r"\d+$", ""), r"[-_]+", " ")
    return paths.select(family.alias("family"), path).groupBy("family").agg(F.count("*").alias("n"), F.min(path).alias("first_path")).where("n > 1")


def name_hygiene(files: DataFrame, path: str, content: str | None = None) -> DataFrame:
    """(path, rule): forbidden artifacts, documents named by a date outside the allowed folders, and with ``content``, bytes that are no UTF-8."""
    p = F.col(path)
    dated = F.lower(p).endswith(".md") & base_name(p).rlike(DATED) & ~reduce(lambda a, b: a | b, [p.startswith(x) for x in DATED_ALLOWED])
    rules = [F.when(any_glob(p, FORBIDDEN), "forbidden-artifact"), F.when(dated, "date-named-document")]
    if content:
        rules.append(F.when(~F.is_valid_utf8(F.col(content)), "utf8"))
    return files.select(path, F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def stale_terms(lines: DataFrame, terms: list[str]) -> DataFrame:
    """(doc, line, term) of deprecated terms in the normalised lines (doc, line, key), whatever their case."""
    hits = F.array_compact(F.array(*[F.when(F.col("key").contains(t.lower()), t) for t in terms]))
    return lines.select("doc", "line", F.explode(hits).alias("term"))
