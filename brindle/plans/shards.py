"""Queries on benchmark shards made of events: a user's day is a run, whose events are dealt to shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import shards as S
from brindle.operators.telemetry import exact_percentiles
from brindle.operators.work import work_folder, written
from brindle.plans.registry import load, query
from brindle.plans.telemetry import RECEIPTS_SQL, receipts

#: Receipts with the diagnostics that they left; runs are users' days, targets kinds of events.
ROWS_SQL = f"""{RECEIPTS_SQL}, rows as (select r.*, target || '/' || recorded_at::date as run, target % 7 <> 3 as holds, event_id % 4 as part, e.event_type || '/' || event_id % 2 as place,
      case when event_id % 6 = 0 then [] when event_id % 5 = 0 then ['attempts-2', 'slow'] else ['attempts-1'] end as diagnostics from receipts r join events e using (event_id))"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    arrays = lambda *x: F.array(*[F.lit(y) for y in x]).cast("array<string>")
    found = F.when(i % 6 == 0, arrays()).when(i % 5 == 0, arrays("attempts-2", "slow")).otherwise(arrays("attempts-1"))
    kind = load(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit("/"), (i % 2).cast("string")).alias("place"))
    return receipts(spark, sf_dir).join(kind, "event_id").withColumns({"run": F.concat(F.col("target").cast("string"), F.lit("/"), F.to_date("recorded_at").cast("string")), "holds": F.col("target") % 7 != 3, "part": i % 4, "diagnostics": found})


def map_sql(field: str, by: str) -> str:
    """A CTE ``m_<field>`` (by, text of the counts of a field's values) over ``rows``."""
    source = "(select *, unnest(diagnostics) as value from rows)" if field == "diagnostics" else f"(select *, {field}::varchar as value from rows)"
    return f"m_{field} as (select {by}, string_agg(value || '=' || n, ';' order by value) as {field} from (select {by}, value, count(*) as n from {source} where value is not null group by all) group by {by})"


@query(f"""with {ROWS_SQL}, {map_sql('status', 'target')}, {map_sql('http_status', 'target')}, {map_sql('diagnostics', 'target')},
    t as (select target, elapsed_ms, row_number() over (partition by target order by elapsed_ms) - 1 as i, count(*) over (partition by target) as n from rows),
    p as (select target, max(n) as observations, min(elapsed_ms) as min_ms, max(elapsed_ms) filter (i = floor((n - 1) * 0.5)) as median_ms, max(elapsed_ms) filter (i = floor((n - 1) * 0.95)) as p95_ms, max(elapsed_ms) as max_ms from t group by 1)
    select p.*, coalesce(status, '') as status_counts, coalesce(http_status, '') as http_status_counts, coalesce(diagnostics, '') as diagnostic_counts
    from p left join m_status using (target) left join m_http_status using (target) left join m_diagnostics using (target)""")
def target_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency and counts by status, HTTP answer and diagnostic of each target."""
    out = S.shard_summaries(rows(spark, sf_dir), ["target"])
    maps = [c for c in out.columns if c.endswith("_counts")]
    return out.select(*[c for c in out.columns if c not in maps], *[S.shown(F.col(m)).alias(m) for m in maps])


@query(f"""with {ROWS_SQL}, {map_sql('status', 'run')}, {map_sql('http_status', 'run')}, {map_sql('diagnostics', 'run')},
    s as (select run, part, elapsed_ms, row_number() over (partition by run, part order by elapsed_ms) - 1 as i, count(*) over (partition by run, part) as n from rows),
    p as (select run, part, max(n) as measured, max(elapsed_ms) filter (i = floor((n - 1) * 0.5)) as median_ms, max(elapsed_ms) filter (i = floor((n - 1) * 0.95)) as p95_ms from s group by all),
    q as (select run, string_agg(part, ',' order by part) as shards, count(*) * 3 as selected_targets, round(sum(median_ms * measured) / sum(measured), 3) as median_ms, max(p95_ms) as p95_ms from p group by run),
    g as (select run, count(*) as observations, count(*) filter (status = 'ok') as ok, count(*) filter (status in ('blocked', 'resource_limited')) as o, count(*) filter (status = 'error') as e, count(*) filter (status = 'empty') as m, bool_and(holds) as holds from rows group by run),
    h as (select run, place, count(*) as n, count(*) filter (status <> 'ok') as f, count(*) filter (status = 'blocked') as b, count(*) filter (status = 'error') as e, count(http_status) as w from rows group by all),
    k as (select run, case when b / n >= 0.95 then 'blocked' when e / n >= 0.95 and w = 0 then 'transport_error' when f = 0 then 'healthy' when f / n >= 0.5 then 'degraded' else 'intermittent' end as health from h),
    m_health as (select run, string_agg(health || '=' || n, ';' order by health) as health_class_counts from (select run, health, count(*) as n from k group by all) group by run)
    select run, shards, selected_targets, observations, round(ok / observations, 6) as usable_rate, round(o / observations, 6) as operational_rate, round(e / observations, 6) as error_rate, round(m / observations, 6) as empty_rate, round((observations - ok) / observations, 6) as failure_rate,
      coalesce(status, '') as status_counts, coalesce(http_status, '') as http_status_counts, coalesce(diagnostics, '') as diagnostic_counts, health_class_counts, q.median_ms, q.p95_ms, case when holds then 1.0 else round(13 / 14, 6) end as pass_rate,
      'PASS' as execution, case when holds then 'PASS' else 'FAIL' end as contract, case when ok = observations then 'PASS' else 'FAIL' end as clean, case when holds and ok = observations then 'PASS' else 'WARN' end as overall
    from q join g using (run) left join m_status using (run) left join m_http_status using (run) left join m_diagnostics using (run) join m_health using (run)""")
def run_scorecards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorecards of runs: the maps of their shards merged, health classes, and verdicts with contracts that some runs break."""
    r = rows(spark, sf_dir)
    shards = S.shard_summaries(r, ["run", "part"]).select("run", F.col("part").alias("shard"), F.lit(3).cast("long").alias("selected_targets"), F.lit(1).alias("cycles"), "status_counts", "http_status_counts", "diagnostic_counts", F.col("observations").alias("measured"), "median_ms", "p95_ms")
    failed = F.when(F.col("holds"), 0).otherwise(1)
    contracts = r.select("run", "holds").distinct().select("run", F.lit(14).alias("queries"), (14 - failed).alias("passed"), failed.alias("failed"))
    out = S.run_scorecards(shards, S.failing_target_rows(r, ["run"], "place"), contracts, ["run"])
    maps = [c for c in out.columns if c.endswith("_counts")]
    plain = [c for c in out.columns if c not in (*maps, "shards", "cycles")]
    return out.select(F.array_join("shards", ",").alias("shards"), *plain, *[S.shown(F.col(m)).alias(m) for m in maps])


@query("""select user_id % 7 as workload, event_type as stage, count(*) as n, true as p50_within, true as p95_within, true as p99_within from events group by all""")
def stage_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile sketches of shards, written, read and merged: whether each quantile's rank among all values is within two per cent of what was asked."""
    s = load(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("workload"), F.col("event_type").alias("stage"), (F.col("event_id") % 8).alias("shard"), F.round(F.col("value") * 1000).cast("long").alias("us"))
    keys, at = ["workload", "stage"], {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    stored = written(S.sketches(s, [*keys, "shard"], "us"), work_folder(spark, "sketches"))
    found = S.sketch_quantiles(S.merged_sketches(stored, keys), keys, at)
    # the exact rank of a value is a range where it occurs several times
    ranked = s.join(found, keys).groupBy(*keys, "n").agg(*[F.count_if(F.col("us") < F.col(q)).alias(f"{q}_low") for q in at], *[F.count_if(F.col("us") <= F.col(q)).alias(f"{q}_high") for q in at])
    within = lambda q, p: (F.col(f"{q}_low") <= (p + 0.02) * F.col("n")) & (F.col(f"{q}_high") >= (p - 0.02) * F.col("n"))
    return ranked.select(*keys, "n", *[within(q, p).alias(f"{q}_within") for q, p in at.items()])


@query("""with e as (select user_id, ts::date as day, epoch_us(ts) as ms, event_type, row_number() over (partition by user_id, ts::date order by ts) as i from events),
    s as (select user_id % 7 as workload, min(ms) filter (i = 2) - min(ms) as ttfb_us, min(ms) filter (event_type = 'purchase') - min(ms) as evidence_us, max(ms) - min(ms) as final_us from e group by user_id, day, 1),
    u as (unpivot (select workload, ttfb_us, evidence_us, final_us from s) on ttfb_us, evidence_us, final_us into name kind value v),
    r as (select *, row_number() over (partition by workload, kind order by v) - 1 as i, count(*) over (partition by workload, kind) as n from u)
    select workload, max(v) filter (kind = 'ttfb_us' and i = floor((n - 1) * 0.95)) as ttfb_p95_us, max(v) filter (kind = 'evidence_us' and i = floor((n - 1) * 0.95)) as evidence_p95_us, max(v) filter (kind = 'final_us' and i = floor((n - 1) * 0.95)) as final_p95_us from r group by 1""")
def session_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95th percentiles, by workload, of how long a day's session of a user takes to its second event, first purchase and end."""
    e = load(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    s = S.session_times(e, ["user_id", "day"], "ts", "event_type", ("purchase",)).withColumn("workload", F.col("user_id") % 7)
    kinds = ["ttfb", "evidence", "final"]
    long = s.select("workload", F.explode(F.create_map(*[x for k in kinds for x in (F.lit(k), F.col(f"{k}_us"))])).alias("kind", "ms"))
    p95 = exact_percentiles(long, ["workload", "kind"], "ms", {"p95": 0.95})
    return p95.groupBy("workload").agg(*[F.max(F.when(F.col("kind") == k, F.col("p95"))).alias(f"{k}_p95_us") for k in kinds])
