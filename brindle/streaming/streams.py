"""Structured Streaming forms of ingest, target health, visit dedup, lifecycle, resume and reassembly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from brindle.operators.ledger import ALLOWED, STATE_NAMES, visit_key
from brindle.operators.telemetry import target_health

#: Buckets that keys are dealt to; a stream keeps its number for good.
BUCKETS = 512


def source(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files_per_trigger: int = 16) -> DataFrame:
    """Files below ``path`` as a stream, a bounded number in each trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def ingest(receipts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append receipts to Parquet by run and shard, as far as there are any now."""
    return receipts.writeStream.partitionBy("run_id", "shard").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def running_health(receipts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and health of each target so far (update mode)."""
    return target_health(receipts, keys)


def windowed_counts(receipts: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Receipts by status and tumbling window; rows later than ``delay`` are dropped."""
    w = F.window("recorded_at", width)
    return receipts.withWatermark("recorded_at", delay).groupBy(w, "status").agg(F.count("*").alias("n"))


def keyed_visits(visits: DataFrame) -> DataFrame:
    """Visits (task_id, url, ...) with the key of their task and source."""
    return visits.withColumn("visit_key", visit_key(F.col("task_id"), F.col("url")))


def next_state(current: str | None, raw: str | None) -> str:
    state = STATE_NAMES.get("_".join((raw or "").strip().lower().replace("-", " ").split()))
    if state is None:
        return "UNKNOWN"
    return state if current is None or (current, state) in ALLOWED else "UNKNOWN"


def lifecycle(events: DataFrame, key: str, order: list[str], raw: str, idle_ms: int | None = None) -> DataFrame:
    """(key, state, n_events) after each trigger; a key's events of one trigger are taken in order.

    A key that gets no event for ``idle_ms`` of processing time is forgotten;
    by default none is.
    """

    def advance(k: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state, n = held.get if held.exists else (None, 0)
        for value in pd.concat(list(parts)).sort_values(order)[raw]:
            state, n = next_state(state, value), n + 1
        held.update((state, n))
        if idle_ms:
            held.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({key: [k[0]], "state": [state], "n_events": [n]})

    kind = events.schema[key].dataType.simpleString()
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return events.groupBy(key).applyInPandasWithState(advance, f"{key} {kind}, state string, n_events long", "state string, n long", "update", timeout)


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def reassembled(frames: DataFrame, idle_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(response_id, text, status, intact) of streamed frames once all of a response are there.

    Deltas wait in the state, in whatever order they come, until done has come
    and every place before it is filled. A response that gets no frame for
    ``idle_ms`` is given out as it is, not intact; by default all are waited for.
    A stream with such a limit never ends by itself. Responses are dealt to
    ``buckets``, as a call of Python costs far more than a response's frames.
    """

    def join(_: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.getCurrentProcessingTimeMs() if idle_ms else 0
        waiting: dict = {}  # response -> [places with texts, last place, status, digest, time of its last frame]
        for key, seqs, texts, *more in zip(*held.get, strict=True) if held.exists else ():
            waiting[key] = [dict(zip(seqs, texts, strict=True)), *more]
        touched = set()
        for part in () if held.hasTimedOut else parts:
            for key, seq, event, text, status, digest in zip(*(part[c].tolist() for c in ("response_id", "seq", "event", "text", "status", "digest")), strict=True):
                one = waiting.setdefault(key, [{}, None, None, None, now])
                text = text if event == "delta" and text is not None else ""
                one[0][seq] = max(text, one[0].get(seq, ""))
                if event == "done":
                    one[1:4] = seq, status, digest
                one[4] = now
                touched.add(key)
        out = []
        for key in list(touched if not idle_ms else waiting):
            places, last, status, digest, at = waiting[key]
            whole = last is not None and len(places) == last + 1
            if whole or (idle_ms and now - at >= idle_ms):
                text = "".join(places[i] for i in sorted(places))
                out.append((key, text, status, whole and hashlib.sha256(text.encode()).hexdigest() == digest))
                del waiting[key]
        if waiting:
            held.update(tuple(list(c) for c in zip(*((key, list(one[0]), list(one[0].values()), *one[1:]) for key, one in waiting.items()), strict=True)))
            if idle_ms:
                held.setTimeoutDuration(max(1, min(one[4] for one in waiting.values()) + idle_ms - now))
        elif held.exists:
            held.remove()
        if out:
            yield pd.DataFrame(out, columns=["response_id", "text", "status", "intact"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    state = "ids array<string>, seqs array<array<int>>, texts array<array<string>>, lasts array<int>, statuses array<string>, digests array<string>, ats array<long>"
    rows = frames.select(bucket(F.col("response_id"), buckets), "response_id", "seq", "event", "text", "status", "digest")
    return rows.groupBy("bucket").applyInPandasWithState(join, "response_id string, text string, status string, intact boolean", state, "append", timeout)


def resumable(requests: DataFrame, receipts: DataFrame) -> DataFrame:
    """Streamed requests (request, input, asked_at) with eligible, against a table of receipts (stream-static join).

    The rule is that of the batch form: a completed, resumable receipt of the
    same fingerprints that has no expiry or a later one. Receipts are
    aggregated first, so each request gives one row.
    """
    good = receipts.where("resume_eligible and status = 'completed'").groupBy("request", "input").agg(F.max("expires_at").alias("__last"), F.bool_or(F.col("expires_at").isNull()).alias("__open"))
    both = requests.join(good, ["request", "input"], "left_outer")
    eligible = F.coalesce(F.col("__open") | (F.col("asked_at") < F.col("__last")), F.col("__open"), F.lit(False))
    return both.withColumn("eligible", eligible).drop("__last", "__open")


def to_table(stream: DataFrame, path: str, mode: str, keys: list[str] | None = None, progress: list | None = None) -> DataFrame:
    """Run a stream over all there is, one Parquet folder a trigger; with ``keys`` the last row of each key counts. ``progress`` gets the progress of all triggers."""
    spark = stream.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/trigger={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress
    rows = spark.read.parquet(f"{path}/out")
    if keys:
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__batch")))).where("__n = 1")
    return rows.select(*stream.columns)
