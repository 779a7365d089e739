"""Summaries of benchmark shards that merge: maps of counts, mergeable quantile sketches, and scorecards over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.telemetry import STATUSES, exact_percentiles, target_health

#: Items of a sketch's level; ranks are then within about 1.33 / k ** 0.9 of the exact ones, in most cases.
SKETCH_K = 400


def long_counts(rows: DataFrame, keys: list[str], fields: dict[str, Column]) -> DataFrame:
    """(keys, field, value, n): how often each value of each field occurs; array fields count each item, nulls count nothing."""
    one = lambda name, c: F.struct(F.lit(name).alias("field"), c.cast("string").alias("value"))
    arrays = {f for f, c in fields.items() if rows.select(c.alias(f)).schema[f].dataType.typeName() == "array"}
    items = lambda f, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: one(f, x))
    every = [items(f, c) if f in arrays else F.array(one(f, c)) for f, c in fields.items()]
    pairs = rows.select(*keys, F.explode(F.concat(*every)).alias("x")).select(*keys, "x.*")
    return pairs.where("value is not null").groupBy(*keys, "field", "value").agg(F.count("*").alias("n"))


def to_maps(counts: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, a map value -> n for each field), keys of maps in order. A map is one value of a row; for fields with more values than a row may hold keep ``counts``."""
    entries = lambda f: F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("value", "n"))))
    return counts.groupBy(*keys).agg(*[F.map_from_entries(entries(f)).alias(f) for f in fields])


def merged_counts(shards: DataFrame, keys: list[str], maps: list[str]) -> DataFrame:
    """(keys, field, value, n): the maps of all shards, exploded and summed; a null map is empty, a null count 0."""
    one = [shards.select(*keys, F.lit(m).alias("field"), F.explode(m).alias("value", "n")) for m in maps]
    rows = reduce(DataFrame.unionByName, one)
    return rows.groupBy(*keys, "field", F.col("value").cast("string").alias("value")).agg(F.sum(F.coalesce(F.col("n").cast("long"), F.lit(0))).alias("n"))


def shown(counts: Column) -> Column:
    """A map of counts as text, ``value=n`` in order of values, joined by semicolons."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce(counts, F.create_map().cast("map<string,bigint>")))), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")


def shard_summaries(receipts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, observations, status_counts, http_status_counts, diagnostic_counts, min_ms, median_ms, p95_ms, max_ms) of receipts (status, http_status, diagnostics, elapsed_ms)."""
    fields = {"status_counts": F.col("status"), "http_status_counts": F.col("http_status"), "diagnostic_counts": F.col("diagnostics")}
    maps = to_maps(long_counts(receipts, keys, fields), keys, list(fields))
    times = exact_percentiles(receipts, keys, "elapsed_ms", {"min_ms": 0.0, "median_ms": 0.5, "p95_ms": 0.95, "max_ms": 1.0})
    n = receipts.groupBy(*keys).agg(F.count("*").alias("observations"))
    return n.join(maps, keys, "left").join(times, keys, "left")


def failing_target_rows(receipts: DataFrame, keys: list[str], target: str) -> DataFrame:
    """(keys, target, observations, failures, health, action) of every target of a run, over all its shards."""
    return target_health(receipts, [*keys, target])


def run_scorecards(shards: DataFrame, targets: DataFrame, contracts: DataFrame, keys: list[str]) -> DataFrame:
    """One row a run over its shards: merged maps, rates to six places, latency, health classes and verdicts.

    ``shards``: keys, shard, selected_targets, cycles, the three maps,
    measured (observations with latency), median_ms, p95_ms. ``targets``: keys,
    health, one row a target. ``contracts``: keys, queries, passed, failed. A
    run is executed if it has an observation; clean if none of them failed; its
    contract holds if queries ran and all passed. overall is PASS if all three
    hold, else WARN. Rates over no observation are null.
    """
    maps = ["status_counts", "http_status_counts", "diagnostic_counts"]
    counts = to_maps(merged_counts(shards, keys, maps), keys, maps)
    weight = F.when(F.col("median_ms").isNotNull(), F.col("measured"))
    own = shards.groupBy(*keys).agg(
        F.array_sort(F.collect_set("shard")).alias("shards"), F.sum("selected_targets").alias("selected_targets"), F.sum("cycles").alias("cycles"),
        F.round(F.sum(F.col("median_ms") * weight) / F.nullif(F.sum(weight), F.lit(0)), 3).alias("median_ms"), F.max("p95_ms").alias("p95_ms"))
    health = to_maps(targets.groupBy(*keys, F.lit("health_class_counts").alias("field"), F.col("health").alias("value")).agg(F.count("*").alias("n")), keys, ["health_class_counts"])
    j = own.join(counts, keys, "left").join(health, keys, "left").join(contracts.select(*keys, "queries", "passed", "failed"), keys, "left")
    of = lambda s: F.coalesce(F.try_element_at("status_counts", F.lit(s)), F.lit(0))
    j = j.withColumn("observations", F.aggregate(F.map_values(F.coalesce("status_counts", F.create_map().cast("map<string,bigint>"))), F.lit(0).cast("long"), lambda a, x: a + x))
    rate = lambda c: F.round(c / F.nullif(F.col("observations"), F.lit(0)), 6)
    failures = reduce(lambda a, b: a + b, [of(s) for s in STATUSES if s != "ok"])
    verdict = lambda c: F.when(F.coalesce(c, F.lit(False)), "PASS").otherwise("FAIL")
    j = j.withColumns({
        "execution": verdict((F.col("observations") > 0) & (F.size("shards") > 0)),
        "contract": verdict((F.col("queries") > 0) & (F.col("failed") == 0) & (F.col("passed") == F.col("queries"))),
        "clean": verdict(failures == 0),
    })
    overall = F.when((F.col("execution") == "PASS") & (F.col("contract") == "PASS") & (F.col("clean") == "PASS"), "PASS").otherwise("WARN")
    rates = {"usable_rate": rate(of("ok")), "operational_rate": rate(of("blocked") + of("resource_limited")), "error_rate": rate(of("error")), "empty_rate": rate(of("empty")), "failure_rate": rate(failures)}
    return j.select(*keys, "shards", "selected_targets", "cycles", "observations", *[c.alias(n) for n, c in rates.items()], *maps, "health_class_counts", "median_ms", "p95_ms",
        F.round(F.col("passed") / F.nullif(F.col("queries"), F.lit(0)), 6).alias("pass_rate"), "execution", "contract", "clean", overall.alias("overall"))


def sketches(rows: DataFrame, keys: list[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """(keys, sketch, n): a mergeable quantile sketch of each group's whole numbers, a few KB whatever the group's size."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.kll_sketch_agg_bigint(value, k).alias("sketch"), F.count("*").alias("n"))


def merged_sketches(shards: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of shards merged by ``keys``."""
    return shards.groupBy(*keys).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"), F.sum("n").alias("n"))


def sketch_quantiles(merged: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """(keys, n, a quantile by each name): approximate, the rank within about 1.33 / k ** 0.9; exact for groups of fewer than k values."""
    return merged.select(*keys, "n", *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(p)).alias(name) for name, p in at.items()])


def session_times(events: DataFrame, keys: list[str], at: str, kind: str, evidence: tuple[str, ...]) -> DataFrame:
    """(keys, ttfb_us, evidence_us, final_us) of each session from its first event on: to the second event, to the first event of a kind in ``evidence``, to the last."""
    us = F.unix_micros(F.col(at).cast("timestamp"))
    e = events.select(*keys, us.alias("us"), F.col(kind).isin(*evidence).alias("proof"))
    # of equal times the second event comes at once
    g = e.groupBy(*keys, "us").agg(F.count("*").alias("n"), F.bool_or("proof").alias("proof"))
    first = g.groupBy(*keys).agg(F.min("us").alias("start"), F.min(F.struct("us", "n")).alias("f"), F.min(F.when(F.col("proof"), F.col("us"))).alias("e"), F.max("us").alias("z"))
    later = g.join(first.select(*keys, "start"), keys).where("us > start").groupBy(*keys).agg(F.min("us").alias("second"))
    j = first.join(later, keys, "left")
    second = F.when(F.col("f.n") > 1, F.col("start")).otherwise(F.col("second"))
    return j.select(*keys, (second - F.col("start")).alias("ttfb_us"), (F.col("e") - F.col("start")).alias("evidence_us"), (F.col("z") - F.col("start")).alias("final_us"))
