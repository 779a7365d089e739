"""Acquisition telemetry: receipts to summaries, percentiles, health and scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Strings whose occurrences hint at a product page.
PRODUCT_HINTS = ("product", 'itemprop="name"', "productid", "sku", "add-to-cart", "price")
STATUSES = ("ok", "empty", "blocked", "resource_limited", "error")


def exact_percentiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """The values at index int((n - 1) * p) of each group's sorted values, by name.

    Equal values are counted first, so a group of any size is a run of distinct
    values with running counts; nothing is gathered.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    by = Window.partitionBy(*keys)
    ranked = counts.withColumn("upto", F.sum("n").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(by))
    place = lambda p: F.floor((F.col("all") - 1) * F.lit(p))
    picked = [F.min(F.when(F.col("upto") > place(p), F.col(value))).alias(name) for name, p in at.items()]
    return ranked.groupBy(*keys).agg(*picked)


def health(observations: Column, failures: Column, blocked: Column, limited: Column, errors: Column, http_seen: Column) -> Column:
    """struct(health, action) of a target from its counts."""
    pair = lambda a, b: F.struct(F.lit(a).alias("health"), F.lit(b).alias("action"))
    share = lambda c: c / F.nullif(observations, F.lit(0)) >= 0.95
    return (
        F.when(observations <= 0, pair("unknown", "collect_more_observations"))
        .when(share(blocked), pair("blocked", "quarantine_until_manual_recheck"))
        .when(share(limited), pair("rate_limited", "exponential_backoff_and_quarantine"))
        .when(share(errors) & (http_seen == 0), pair("transport_error", "investigate_dns_tls_or_network_path"))
        .when(failures == 0, pair("healthy", "retain_normal_sampling"))
        .when(failures / F.nullif(observations, F.lit(0)) >= 0.5, pair("degraded", "retain_for_targeted_recheck"))
        .otherwise(pair("intermittent", "retain_with_failure_aware_retry"))
    )


def summarize(receipts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by status and HTTP answer of receipts (status, http_status, elapsed_ms), by ``keys``."""
    status = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES]
    return receipts.groupBy(*keys).agg(F.count("*").alias("observations"), F.count_if(F.col("status") != "ok").alias("failures"), *status,
        F.count("http_status").alias("http_seen"), F.sum("elapsed_ms").alias("elapsed_ms"))


def target_health(receipts: DataFrame, keys: list[str]) -> DataFrame:
    s = summarize(receipts, keys)
    h = health(*[F.col(c) for c in ("observations", "failures", "n_blocked", "n_resource_limited", "n_error", "http_seen")])
    return s.select(*keys, "observations", "failures", h.alias("h")).select(*keys, "observations", "failures", "h.*")


def scorecard(shards: DataFrame) -> DataFrame:
    """One row over shard summaries: rates to six places, weighted median, largest p95, verdict.

    ``shards``: observations, n_ok, n_blocked, n_resource_limited, n_error,
    n_empty, median_ms, p95_ms. Rates over no observation are null.
    """
    total = F.sum("observations")
    rate = lambda c: F.round(F.sum(c) / F.nullif(total, F.lit(0)), 6)
    out = shards.agg(
        F.count("*").alias("shards"),
        total.alias("observations"),
        rate("n_ok").alias("usable_rate"),
        rate("n_blocked").alias("blocked_rate"),
        rate("n_resource_limited").alias("limited_rate"),
        rate("n_error").alias("error_rate"),
        rate("n_empty").alias("empty_rate"),
        F.round(F.sum(F.col("median_ms") * F.col("observations")) / F.nullif(F.sum(F.when(F.col("median_ms").isNotNull(), F.col("observations"))), F.lit(0)), 3).alias("median_ms"),
        F.max("p95_ms").alias("p95_ms"),
    )
    bad = (F.col("blocked_rate") > 0) | (F.col("limited_rate") > 0) | (F.col("error_rate") > 0)
    return out.withColumn("overall", F.when(F.col("observations").isNull() | bad, "WARN").otherwise("PASS"))
