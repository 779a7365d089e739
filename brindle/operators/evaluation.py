"""Evaluation runs: checks, scores, grouped means, gates and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import clamp3

# Weights of the component scores.
WEIGHTS = {"correctness": 0.24, "evidence_quality": 0.18, "completeness": 0.16, "precision": 0.14, "token_efficiency": 0.10, "tool_efficiency": 0.06,
    "context_efficiency": 0.07, "self_correction": 0.05}
METRICS = [*WEIGHTS, "overall"]


def score_runs(obs: DataFrame) -> DataFrame:
    """Component scores and the weighted overall score, each clamped to 0..1 and rounded to three places."""
    c = lambda n: F.col(n).cast("double")
    one = lambda n: F.greatest(c(n), F.lit(1.0))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(clamp3(a / F.nullif(b, F.lit(0.0))))
    tokens = c("input_tokens") + c("output_tokens") + c("thinking_tokens")
    some = F.greatest(tokens, F.lit(1.0))
    noise = c("duplicate_actions") + c("irrelevant_actions") + c("unsupported_claims")
    context = c("cached_tokens") / some * 0.35 + 1.0 / (1 + c("compaction_events")) * 0.35 + (1.0 - F.least(F.lit(1.0), c("context_peak_tokens") / some)) * 0.30
    parts = {
        "correctness": ratio(c("correct_claims"), c("required_claims")),
        "evidence_quality": ratio(c("supported_claims"), F.greatest(c("correct_claims"), c("required_claims"), F.lit(1.0))),
        "completeness": clamp3(1.0 - ratio(c("missed_requirements"), one("required_claims"))),
        "precision": clamp3(1.0 - F.least(F.lit(1.0), noise / F.greatest(c("tool_calls") + c("files_read"), F.lit(1.0)))),
        "token_efficiency": clamp3((c("correct_claims") + c("supported_claims") + c("self_corrections")) / F.greatest(tokens / 1000.0, F.lit(1.0))),
        "tool_efficiency": ratio(c("useful_tool_calls"), one("tool_calls")),
        "context_efficiency": clamp3(context),
        "self_correction": clamp3(c("self_corrections") / F.greatest(c("successful_actions"), c("self_corrections"), F.lit(1.0))),
    }
    scored = obs.withColumns(parts)
    return scored.withColumn("overall", clamp3(sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))))


def mean_scores(scored: DataFrame, groups: list[str]) -> DataFrame:
    """Means by each of ``groups`` on its own: (dimension, value, runs, metrics)."""
    means = [F.round(F.avg(m), 3).alias(m) for m in METRICS]
    sets = [[F.col(g)] for g in groups]
    out = scored.groupingSets(sets, *groups).agg(F.count("*").alias("runs"), F.grouping_id(*groups).alias("gid"), *means)
    last = len(groups) - 1
    which = lambda i: F.col("gid") == (2 ** len(groups) - 1) - 2 ** (last - i)
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, g in enumerate(groups):
        name, value = F.when(which(i), g).otherwise(name), F.when(which(i), F.col(g).cast("string")).otherwise(value)
    return out.select(name.alias("dimension"), value.alias("value"), "runs", *METRICS)


def fork_scores(forks: DataFrame) -> DataFrame:
    """decision_correct and normalized_rank_distance of each fork; candidates keep their order."""
    place = lambda c: F.array_position("candidates", F.col(c))
    distance = F.abs(place("chosen_candidate") - place("hindsight_best_candidate")) / F.greatest(F.size("candidates") - 1, F.lit(1))
    return forks.withColumn("decision_correct", F.col("chosen_candidate") == F.col("hindsight_best_candidate")).withColumn("normalized_rank_distance", F.round(distance, 3))


def fork_report(forks: DataFrame, keys: list[str]) -> DataFrame:
    s = fork_scores(forks)
    return s.groupBy(*keys).agg(F.count("*").alias("observations"), F.count_if("decision_correct").alias("correct_observations"),
        F.round(F.count_if("decision_correct") / F.count("*"), 3).alias("decision_accuracy"), F.round(F.avg("normalized_rank_distance"),
        3).alias("mean_rank_distance"), F.round(F.avg("decision_latency_ms"), 3).alias("mean_latency_ms"))


def row_errors(rules: dict[str, Column]) -> Column:
    """Sorted names of the rules that a row breaks; a rule that is null counts as broken."""
    return F.array_sort(F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]), lambda x: x.isNotNull()))


def quarantine(df: DataFrame, rules: dict[str, Column], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, the others with their ``errors``); ``strict`` fails the job on the first bad row."""
    checked = df.withColumn("errors", row_errors(rules))
    if strict:
        checked = checked.withColumn("errors", F.when(F.size("errors") > 0, F.raise_error(F.array_join("errors", ","))).otherwise(F.col("errors")))
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def regressions(baseline: DataFrame, candidate: DataFrame, keys: list[str], lower_is_better: tuple[str, ...] = ("latency",)) -> DataFrame:
    """Critical dimensions that got worse by more than they may: keys, dimension, baseline, value, max_regression."""
    b = baseline.select(*keys, "dimension", F.col("value").alias("baseline_value"))
    both = candidate.where("critical and value is not null and max_regression is not null").join(b, [*keys, "dimension"])
    worse = F.when(F.col("dimension").isin(*lower_is_better), F.col("value") - F.col("baseline_value")).otherwise(F.col("baseline_value") - F.col("value"))
    return both.where(worse > F.col("max_regression")).select(*keys, "dimension", "baseline_value", "value", "max_regression")


def release_gate(baseline: DataFrame, candidate: DataFrame, dimensions: list[str], keys: list[str]) -> DataFrame:
    """state PASS only where no dimension is missing and none regressed: keys, n_missing, n_regressed, state."""
    groups = candidate.select(*keys).distinct()
    missing = groups.withColumn("dimension", F.explode(F.array(*[F.lit(d) for d in dimensions]))).join(candidate.where("value is not null").select(*keys, "dimension"), [*keys, "dimension"], "left_anti").groupBy(*keys).agg(F.count("*").alias("n_missing"))
    worse = regressions(baseline, candidate, keys).groupBy(*keys).agg(F.count("*").alias("n_regressed"))
    out = groups.join(missing, keys, "left").join(worse, keys, "left").na.fill(0, ["n_missing", "n_regressed"])
    return out.withColumn("state", F.when((F.col("n_missing") == 0) & (F.col("n_regressed") == 0), "PASS").otherwise("BLOCKED"))


def baseline_diff(runs: DataFrame, identity: list[str], order: str) -> DataFrame:
    """Each run against the latest completed run before it with the same identity.

    ``runs``: execution_state, completed, useful, high, signals (array).
    REGRESSED wins over IMPROVED; without a baseline NO_BASELINE.
    """
    by = Window.partitionBy(*identity).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    names = ["completed", "useful", "high", "signals", "execution_state"]
    prior = F.last(F.when(F.col("execution_state") == "completed", F.struct(*names)), ignorenulls=True).over(by)
    r = runs.withColumn("p", prior)
    less = lambda c: F.col(c) < F.col(f"p.{c}")
    more = lambda c: F.col(c) > F.col(f"p.{c}")
    down = (F.col("execution_state") != "completed") | less("completed") | less("useful") | more("high")
    up = more("completed") | more("useful") | less("high")
    decision = F.when(F.col("p").isNull(), "NO_BASELINE").when(down, "REGRESSED").when(up, "IMPROVED").otherwise("STABLE")
    delta = [(F.col(c) - F.col(f"p.{c}")).alias(f"{c}_delta") for c in ("completed", "useful", "high")]
    change = [F.array_sort(F.array_except("signals", "p.signals")).alias("added"), F.array_sort(F.array_except("p.signals", "signals")).alias("resolved")]
    return r.select(*identity, order, decision.alias("decision"), *delta, *change)


def compare_efficiency(pairs: DataFrame, growth: float = 0.10, min_cache_hit: float = 0.0, min_output_tokens: int = 0, min_output_ratio: float = 0.0,
    max_amplification: float | None = None) -> DataFrame:
    """accepted and reason of each baseline (b_) and candidate (c_) pair; the order of the tests is their meaning."""
    c = lambda n: F.col(n).cast("double")
    total = lambda s: c(f"{s}_input") + c(f"{s}_output")
    kept = lambda s: F.when(c(f"{s}_retained") + c(f"{s}_dropped") == 0, 1.0).otherwise(c(f"{s}_retained") / F.nullif(c(f"{s}_retained") + c(f"{s}_dropped"), F.lit(0.0)))
    grown = lambda new, old: (new - old) / F.nullif(old, F.lit(0.0))
    floor = F.greatest(F.lit(min_output_tokens), F.floor(c("b_output") * min_output_ratio))
    amplification = total("c") / F.greatest(F.lit(1.0), c("c_output")) > F.lit(max_amplification) if max_amplification is not None else F.lit(False)
    reason = (
        F.when(F.col("c_accepted") & ~F.col("b_accepted"), "candidate is accepted while baseline is not")
        .when(~F.col("c_accepted"), "candidate is not accepted")
        .when((c("b_input") <= 0) | (total("b") <= 0), "baseline token measurements must be positive")
        .when(grown(c("c_input"), c("b_input")) > growth, "candidate input-token growth exceeds gate")
        .when(grown(total("c"), total("b")) > growth, "candidate total-token growth exceeds gate")
        .when(c("c_cache_hits") / F.greatest(F.lit(1.0), c("c_calls")) < min_cache_hit, "candidate cache-hit ratio is below gate")
        .when(amplification, "candidate context amplification exceeds gate")
        .when((total("c") <= total("b")) & (floor > 0) & (c("c_output") < floor), "candidate output size is below configured floor")
        .when(total("c") <= total("b"), "candidate accepted with non-increasing token use")
        .when(kept("c") > kept("b"), "candidate spends limited extra tokens for better evidence retention")
        .otherwise("candidate did not justify additional token use")
    )
    yes = ("candidate is accepted while baseline is not", "candidate accepted with non-increasing token use", "candidate spends limited extra tokens for better evidence retention")
    return pairs.withColumn("reason", reason).withColumn("accepted", F.col("reason").isin(*yes))
