"""Streaming queries: the events table replayed as files; results equal those of the batch queries."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.work import work_folder, written
from brindle.plans.corpus import FRAMES_SQL, spoilt_frames
from brindle.plans.registry import ORACLE_SQL, load, query
from brindle.plans.telemetry import STATES, receipts
from brindle.streaming import stateful as X
from brindle.streaming import streams as S


def _folder(spark: SparkSession) -> str:
    return work_folder(spark, "stream")


#: Batches of a replay in order of time, and how many batches late a late row comes.
BATCHES, LATE = 6, 3


def _replay(rows: DataFrame, at: str, path: str, batch: Column) -> DataFrame:
    """``rows`` as files that a stream reads one a trigger, by ``batch``; then a row far in the future, which ends all windows and runs."""
    spark = rows.sparkSession
    kept = written(rows.withColumn("__batch", batch), f"{path}/rows")
    last = kept.limit(1).withColumn(at, F.lit(datetime.datetime(2100, 1, 1)).cast(rows.schema[at].dataType))
    for b in range(BATCHES + LATE):
        kept.where(F.col("__batch") == b).drop("__batch").coalesce(1).write.mode("append").parquet(f"{path}/events")
    last.drop("__batch").coalesce(1).write.mode("append").parquet(f"{path}/events")
    return S.source(spark, f"{path}/events", rows.schema, files_per_trigger=1)


def _batch(rows: DataFrame, at: str) -> Column:
    """Number of a row's batch when the whole range of times is cut into BATCHES equal parts."""
    low, high = rows.agg(F.min(F.unix_micros(at)), F.max(F.unix_micros(at))).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // BATCHES))
    return F.floor((F.unix_micros(at) - F.lit(low or 0)) / width)


#: The number of a row's batch; microseconds.
BATCH_SQL = f"t as (select epoch_us(min(ts)) as low, -((-(epoch_us(max(ts)) - epoch_us(min(ts)) + 1)) // {BATCHES}) as width from events)"


def _events(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """events as files that a stream reads one after the other."""
    e = load(spark, sf_dir, "events")
    e.repartitionByRange(4, "ts").write.parquet(f"{path}/events")
    return S.source(spark, f"{path}/events", e.schema)


@query(ORACLE_SQL["target_health"])
def stream_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    receipts(spark, sf_dir).write.parquet(f"{path}/receipts")
    stream = S.source(spark, f"{path}/receipts", receipts(spark, sf_dir).schema)
    return S.to_table(S.running_health(stream, ["target"]), path, "update", ["target"])


HOUR = 3_600_000_000


@query(f"""with recursive e as (select event_id, user_id, event_type, epoch_us(ts) as us, row_number() over (partition by user_id, event_type order by ts, event_id) as i,
      case when event_id % 19 = 0 then 'contradiction_check' when event_id % 17 = 0 then 'because' end as force from events),
    v as (select *, us as last, true as allowed, 'new_source' as reason from e where i = 1 union all
      select e.*, case when e.us - v.last >= {20 * HOUR} or e.force = 'contradiction_check' then e.us else v.last end,
        e.us - v.last >= {20 * HOUR} or coalesce(e.force = 'contradiction_check', false),
        case when e.us - v.last >= {20 * HOUR} then 'new_source' when e.force = 'contradiction_check' then e.force else 'already_visited_for_task' end
      from v join e on e.user_id = v.user_id and e.event_type = v.event_type and e.i = v.i + 1)
    select event_id, allowed, reason from v""")
def stream_visit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits replayed in order of time: within 20 hours of the last allowed one only forced ones pass."""
    path, i = _folder(spark), F.col("event_id")
    v = load(spark, sf_dir, "events").select(i.alias("visit_id"), F.col("user_id").cast("string").alias("task_id"), F.col("event_type").alias("url"), F.col("ts").cast("timestamp").alias("visited_at"), F.when(i % 19 == 0, "contradiction_check").when(i % 17 == 0, "because").alias("force_reason"))
    keyed = S.keyed_visits(_replay(v, "visited_at", path, _batch(v, "visited_at")))
    with X.rocksdb(spark):
        out = S.to_table(X.gated_visits(keyed, ["visit_key"], "1 minute", 20 * HOUR), path, "append")
    # the row that ends the replay is one of the visits once more
    return out.groupBy(F.col("visit_id").alias("event_id")).agg(F.min(F.struct(F.col("reason") == "new_source", "allowed", "reason")).alias("x"), F.count("*").alias("n")).select("event_id", "x.allowed", "x.reason")


@query(ORACLE_SQL["lifecycle_fold"])
def stream_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    raw = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    e = _events(spark, sf_dir, path).select("user_id", "ts", "event_id", F.try_element_at(raw, F.col("event_type")).alias("raw_state"))
    return S.to_table(S.lifecycle(e, "user_id", ["ts", "event_id"], "raw_state"), path, "update", ["user_id"])


@query(f"""with recursive e as (select *, epoch_us(ts) as us, case event_type when 'click' then 'RUNNING' when 'view' then 'STREAMING' when 'signup' then 'QUEUED' when 'purchase' then 'COMPLETE' else 'FAILED' end as st from events),
    g as (select *, coalesce(us - lag(us) over (partition by user_id order by us, event_id) > {12 * HOUR}, true) as opens from e),
    h as (select *, sum(opens::int) over (partition by user_id order by us, event_id rows unbounded preceding) as run from g),
    s as (select *, row_number() over (partition by user_id, run order by us, event_id) as i, count(*) over (partition by user_id, run) as n, min(ts) over (partition by user_id, run) as began_at from h),
    f as (select user_id, run, i, n, began_at, ts, st as state from s where i = 1 union all
      select f.user_id, f.run, s.i, f.n, f.began_at, s.ts, case when s.st = f.state then s.st when f.state = 'RUNNING' and s.st in ('STREAMING', 'COMPLETE', 'FAILED') then s.st when f.state = 'STREAMING' and s.st in ('COMPLETE', 'FAILED') then s.st
        when f.state = 'QUEUED' and s.st in ('RUNNING', 'STREAMING', 'COMPLETE', 'FAILED') then s.st when f.state = 'UNKNOWN' and s.st in ('RUNNING', 'STREAMING', 'COMPLETE') then s.st else 'UNKNOWN' end
      from f join s on s.user_id = f.user_id and s.run = f.run and s.i = f.i + 1)
    select user_id, began_at, ts as ended_at, state, n as n_events from f where i = n""")
def stream_idle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycles of users replayed in order of time; a run ends after twelve hours without an event, and leaves the state."""
    path = _folder(spark)
    raw = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    e = load(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("at"), F.try_element_at(raw, F.col("event_type")).alias("raw_state"))
    with X.rocksdb(spark):
        out = S.to_table(X.idle_runs(_replay(e, "at", path, _batch(e, "at")), "user_id", "1 minute", 12 * HOUR), path, "append")
    return out.select(F.col("key").alias("user_id"), *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("began_at", "ended_at")], "state", "n_events")


@query(f"""with {BATCH_SQL}, e as (select event_type as status, ts, time_bucket(interval '1 day', ts, timestamp '1970-01-01') as day, (epoch_us(ts) - low) // width + case when event_id % 40 = 0 then {LATE} else 0 end as batch from events, t),
    b as (select batch, max(ts) as high from e group by 1), w as (select e.batch, max(b.high) - interval '1 day' as mark from (select distinct batch from e) e left join b on b.batch < e.batch group by 1)
    select day, status, count(*) filter (mark is null or day + interval '1 day' > mark) as n, count(*) filter (day + interval '1 day' <= mark) as n_late from e join w using (batch) group by all having n > 0""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by day and kind, given out once the watermark has passed the day; some rows come three batches late and are counted apart."""
    path, i = _folder(spark), F.col("event_id")
    e = load(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("recorded_at"), F.col("event_type").alias("status"))
    stream = _replay(e, "recorded_at", path, _batch(e, "recorded_at") + F.when(i % 40 == 0, LATE).otherwise(0)).drop("event_id")
    out = S.to_table(S.windowed_counts(stream, "1 day", "1 day").select(F.col("window.start").cast("timestamp_ntz").alias("day"), "status", "n"), path, "append")
    every = e.groupBy(F.date_trunc("day", "recorded_at").cast("timestamp_ntz").alias("day"), "status").agg(F.count("*").alias("all"))
    return out.join(every, ["day", "status"]).select("day", "status", "n", (F.col("all") - F.col("n")).alias("n_late"))


@query(FRAMES_SQL)
def stream_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames replayed in several triggers, out of order, and put together again."""
    path = _folder(spark)
    frames = spoilt_frames(spark, sf_dir)
    frames.repartition(4, F.xxhash64("response_id", "seq") % 4).write.parquet(f"{path}/frames")
    stream = S.source(spark, f"{path}/frames", frames.schema, files_per_trigger=2)
    return S.to_table(S.reassembled(stream), path, "append")


@query("""with q as (select event_id, user_id, event_type, ts from events where event_id % 2 = 0),
    r as (select user_id, event_type, max(ts + interval 12 hour) as last, bool_or(event_id % 77 = 1) as open from events where event_id % 2 = 1 and value > 5 group by all)
    select event_id, coalesce(open or ts < last, false) as eligible from q left join r using (user_id, event_type)""")
def stream_resumable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the events as streamed requests against receipts made of the other half."""
    path = _folder(spark)
    e = load(spark, sf_dir, "events")
    i, expiry = F.col("event_id"), F.col("ts") + F.expr("interval 12 hours")
    done = e.where(i % 2 == 1).select(F.col("user_id").alias("request"), F.col("event_type").alias("input"), F.when(i % 77 != 1,
        expiry).alias("expires_at"), (F.col("value") > 5).alias("resume_eligible"), F.lit("completed").alias("status"))
    asked = _events(spark, sf_dir, path).where(i % 2 == 0).select("event_id", F.col("user_id").alias("request"), F.col("event_type").alias("input"), F.col("ts").alias("asked_at"))
    return S.to_table(S.resumable(asked, done).select("event_id", "eligible"), path, "append")


@query("select event_type as run_id, user_id % 3 as shard, count(*) as n, sum(event_id)::bigint as ids from events group by all")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended by run and shard, a second start adding nothing, and what then lies in the folders."""
    path = _folder(spark)
    e = _events(spark, sf_dir, path).select(F.col("event_type").alias("run_id"), (F.col("user_id") % 3).alias("shard"), "event_id")
    for _ in range(2):
        S.ingest(e, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("run_id", F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
