"""Stateful streams with event-time timers: visits within a delay of one another, and lifecycles that end when idle.

Keys are dealt to a fixed number of buckets. A bucket's typed value in the
state store has what is held of each of its keys that are alive, and one timer
that drops those which the watermark has passed. A call of Python, a read and a
write of state cost far more than the rows of a key, so they are made once a
bucket and trigger, not once a key. Results depend on the rows' times only, not
on how rows are dealt to triggers or keys to buckets, as long as no row comes
later than the watermark allows. Time to live of state is a matter of
processing time in Spark; timers on event time take its place here.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brindle.streaming.streams import BUCKETS, bucket, next_state

#: What lets a visit pass although the source was visited within the delay.
FORCE_REASONS = ("freshness_expired", "previous_failure_retry", "contradiction_check", "new_revision_or_region", "material_question_change", "high_churn_source")  # fixed values
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started meanwhile keep their state in RocksDB, which these processors need."""
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)


def micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


class Timed(StatefulProcessor):
    """What is held of each key of a bucket, as columns of equal length in one value, until a timer on the event time drops it."""

    schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.schema)

    def alive(self) -> dict:
        """key -> the other fields."""
        return {k: tuple(v) for k, *v in zip(*self.held.get(), strict=True)} if self.held.exists() else {}

    def ends(self, held: tuple) -> int:
        """The millisecond from which a key's fields are of no use."""
        raise NotImplementedError

    def keep(self, alive: dict) -> None:
        """Write what is alive and set the timer to the first that ends."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if alive:
            self.held.update(tuple(list(c) for c in zip(*((k, *v) for k, v in alive.items()), strict=True)))
            self.handle.registerTimer(min(map(self.ends, alive.values())))
        else:
            self.held.clear()

    def passed(self, timerValues: Any, expiredTimerInfo: Any) -> dict:
        """Drop and give what the watermark has passed."""
        mark = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        alive = self.alive()
        over = {k: v for k, v in alive.items() if self.ends(v) <= mark}
        self.keep({k: v for k, v in alive.items() if k not in over})
        return over

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.passed(timerValues, expiredTimerInfo)
        return iter(())

    def close(self) -> None:
        pass


class VisitGate(Timed):
    """Visits: allowed if none of their key was allowed within the delay before, or if a known reason forces them."""

    schema = "keys array<string>, lasts array<bigint>"

    def __init__(self, delay_us: int):
        self.delay = delay_us

    def ends(self, held: tuple) -> int:
        return (held[0] + self.delay) // 1000 + 1

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        alive, out = self.alive(), []
        part = pd.concat(list(rows)).sort_values(["visited_at", "visit_id"])
        for k, i, at, force in zip(part["k"], part["visit_id"].tolist(), micros(part["visited_at"]), part["force_reason"], strict=True):
            last = alive.get(k)
            if last is None or at - last[0] >= self.delay:
                reason = "new_source"
            else:
                reason = force if force in FORCE_REASONS else "already_visited_for_task"
            if reason != "already_visited_for_task":
                alive[k] = (at,)
            out.append((i, reason != "already_visited_for_task", reason))
        self.keep(alive)
        yield pd.DataFrame(out, columns=["visit_id", "allowed", "reason"])


class IdleRuns(Timed):
    """Lifecycles: a key's run ends, and is given out, when no event comes for the idle time."""

    schema = "keys array<string>, states array<string>, ns array<bigint>, begans array<bigint>, lasts array<bigint>"

    def __init__(self, idle_us: int):
        self.idle = idle_us

    def ends(self, held: tuple) -> int:
        return (held[3] + self.idle) // 1000 + 1

    def rows(self, runs: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(runs, columns=["k", "state", "n_events", "began_at", "ended_at"])
        times = {c: pd.to_datetime(out[c], unit="us") for c in ("began_at", "ended_at")}
        return out.assign(**times)[["k", "began_at", "ended_at", "state", "n_events"]]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        alive, ended = self.alive(), []
        part = pd.concat(list(rows)).sort_values(["at", "event_id"])
        for k, at, raw in zip(part["k"], micros(part["at"]), part["raw_state"], strict=True):
            run = alive.get(k)
            if run is not None and at - run[3] > self.idle:
                ended.append((k, *run))
                run = None
            state, n, began, _ = run or (None, 0, at, at)
            alive[k] = (next_state(state, raw), n + 1, began, at)
        self.keep(alive)
        if ended:
            yield self.rows(ended)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        over = self.passed(timerValues, expiredTimerInfo)
        if over:
            yield self.rows([(k, *v) for k, v in over.items()])


def gated_visits(visits: DataFrame, key: list[str], delay: str, delay_us: int, buckets: int = BUCKETS) -> DataFrame:
    """(visit_id, allowed, reason) of streamed visits (key, visit_id, visited_at, force_reason).

    ``delay`` is how late rows may come. A visit is allowed if none of its key
    was within ``delay_us`` before, or if it has one of the known reasons; what
    is allowed counts as the last visit. Needs ``rocksdb``.
    """
    name = F.to_json(F.struct(*key), {"ignoreNullFields": "false"})
    rows = visits.withWatermark("visited_at", delay).select(bucket(name, buckets), name.alias("k"), "visit_id", "visited_at", "force_reason")
    return rows.groupBy("bucket").transformWithStateInPandas(VisitGate(delay_us), "visit_id long, allowed boolean, reason string", "append", "eventTime")


def idle_runs(events: DataFrame, key: str, delay: str, idle_us: int, buckets: int = BUCKETS) -> DataFrame:
    """(key, began_at, ended_at, state, n_events) of runs that have ended, of streamed events (key, event_id, at, raw_state).

    A run is a key's events without a gap of more than ``idle_us``; it is given
    out when an event after such a gap comes or the watermark passes it. Needs
    ``rocksdb``.
    """
    name = F.col(key).cast("string")
    rows = events.withWatermark("at", delay).select(bucket(name, buckets), name.alias("k"), "event_id", "at", "raw_state")
    out = rows.groupBy("bucket").transformWithStateInPandas(IdleRuns(idle_us), "k string, began_at timestamp, ended_at timestamp, state string, n_events long", "append", "eventTime")
    return out.select(F.col("k").cast(events.schema[key].dataType).alias("key"), "began_at", "ended_at", "state", "n_events")
