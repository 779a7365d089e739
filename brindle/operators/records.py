"""Checks, classes and plans on record tables: thin uses of the rule engine and of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.evaluation import row_errors
from brindle.operators.tiers import EVIDENCE_TIERS, rank

def filled(*names: str) -> dict[str, Column]:
    """Rules: each text column holds more than blanks."""
    return {f"blank:{n}": F.trim(F.coalesce(F.col(n).cast("string"), F.lit(""))) != "" for n in names}


def not_negative(*names: str) -> dict[str, Column]:
    return {f"negative:{n}": F.col(n) >= 0 for n in names}


def one_of(name: str, values: tuple[str, ...]) -> dict[str, Column]:
    return {f"unknown:{name}": F.col(name).isin(*values)}


def fork_rules() -> dict[str, Column]:
    """Rules of a decision: two different candidates, choices among them, outcome hidden, sane costs."""
    return {
        "too_few_candidates": F.size("candidates") >= 2,
        "repeated_candidates": F.size("candidates") == F.size(F.array_distinct("candidates")),
        "chosen_not_a_candidate": F.array_contains("candidates", F.col("chosen_candidate")),
        "best_not_a_candidate": F.array_contains("candidates", F.col("hindsight_best_candidate")),
        "outcome_visible": ~F.col("outcome_visible"),
        "bad_latency": F.col("decision_latency_ms") >= 0,
        "bad_calls": F.col("decision_calls") >= 1,
    }


def check(rows: DataFrame, keys: list[str], rules: dict[str, Column], unique: str | None = None) -> DataFrame:
    """keys, errors (sorted names of broken rules); with ``unique`` repeats of that column are an error too."""
    if unique:
        counts = rows.groupBy(unique).agg(F.count("*").alias("__n"))
        rows = rows.join(counts, unique)
        rules = rules | {f"repeated:{unique}": F.col("__n") == 1}
    return rows.select(*keys, row_errors(rules).alias("errors"))


def least_tier(rows: DataFrame, keys: list[str], tier: str) -> DataFrame:
    """keys, the weakest known tier, and whether a row has no known one."""
    r = rows.withColumn("__rank", rank(F.lower(F.trim(tier))))
    least = F.get(F.array(*[F.lit(t) for t in EVIDENCE_TIERS]), F.min("__rank").cast("int"))
    return r.groupBy(*keys).agg(F.when(F.min("__rank").isNotNull(), least).alias("least_tier"), F.bool_or(F.col("__rank").isNull()).alias("untyped"))


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)


def upsert_plan(new: DataFrame, stored: DataFrame, key: str, digest: str, severity: str) -> DataFrame:
    """key, action: insert, update, update_and_notify, or skip for unchanged and informational findings."""
    old = stored.select(key, F.col(digest).alias("__old"), F.lit(True).alias("__known"))
    changed = ~F.col(digest).eqNullSafe(F.col("__old"))
    action = F.when(F.col(severity) == "info", "skip").when(F.col("__known").isNull(), "insert").when(~changed, "skip").when(F.col(severity) == "high", "update_and_notify").otherwise("update")
    return new.join(old, key, "left").select(key, action.alias("action"))


def missing_both_ways(declared: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, problem: declared but not found, or found but not declared."""
    a, b = declared.select(key).distinct(), found.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("problem", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("problem", F.lit("undeclared")))


def reconcile(children: DataFrame, parent: str, state: str, active: tuple[str, ...], terminal: tuple[str, ...]) -> DataFrame:
    """parent, state: running while a child is active, verifying once all are terminal, else unknown."""
    g = children.groupBy(parent).agg(F.bool_or(F.col(state).isin(*active)).alias("a"), F.bool_and(F.col(state).isin(*terminal)).alias("t"))
    return g.select(parent, F.when(F.col("a"), "running").when(F.col("t"), "verifying").otherwise("unknown").alias("state"))


def drift(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """keys, expected and actual value where they differ; what isn't there is null."""
    j = expected.withColumnRenamed("value", "expected").join(actual.withColumnRenamed("value", "actual"), keys, "left")
    return j.where(~F.col("expected").eqNullSafe(F.col("actual"))).select(*keys, "expected", "actual")


#: The temporal mode that needs a reconciliation.
TEMPORAL = "old_vs_new"


def plan_checks(cases: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """``cases`` with missing (families that the plan lacks), causes and passed.

    ``cases``: families and planned (arrays of source families), temporal (null:
    current), planned_stages (array), citations and reconciles (what the plan
    says). A plan passes if no family is missing, all ``stages`` are in it,
    citations are planned, and a comparison of old and new is reconciled.
    """
    empty = F.array().cast("array<string>")
    names = lambda c: F.coalesce(F.col(c), empty)
    missing = F.array_sort(F.array_except(names("families"), names("planned")))
    temporal = F.coalesce(F.col("temporal"), F.lit("current"))
    causes = F.concat(missing, F.array_compact(F.array(
        F.when(F.size(F.array_except(F.array(*[F.lit(s) for s in stages]), names("planned_stages"))) > 0, "__missing_required_stage__"),
        F.when(~F.coalesce("citations", F.lit(False)), "__citations_not_planned__"),
        F.when((temporal == TEMPORAL) & ~F.coalesce("reconciles", F.lit(False)), "__temporal_reconciliation_missing__"))))
    return cases.withColumns({"temporal": temporal, "missing": missing, "causes": causes}).withColumn("passed", F.size("causes") == 0)


def corpus_coverage(checked: DataFrame, project: tuple[str, ...]) -> DataFrame:
    """(kind, value, n, failed) of ``plan_checks`` rows with a category: by category, source family, temporal mode and cause, and in all and of one's own project.

    Of a cause, failed is n: it only counts where it made a case fail.
    """
    category = F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("unknown"))
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    many = lambda kind, c: F.transform(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))), lambda v: one(kind, v))
    whole = F.array_compact(F.array(one("category", category), one("temporal", F.col("temporal")), one("all", F.lit("")), F.when(category.isin(*project), one("project", F.lit("")))))
    rows = checked.select(F.explode(F.concat(whole, many("family", "families"), many("cause", "causes"))).alias("x"), "passed").select("x.*", "passed")
    return rows.groupBy("kind", "value").agg(F.count("*").alias("n"), F.count_if(~F.col("passed")).alias("failed"))
