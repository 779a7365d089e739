"""Lineage of derived artifacts: what of an artifact stands where in its sources, and the other way round.

An artifact is made of one or more parents; a map says which of its characters
are which characters of a parent, or that this is lost. The closure composes
maps along all ways to the sources by doubling: in each round every way that
hasn't come to a source is lengthened by what its end already knows, so ways of
length n take log2(n) rounds. Ways and spans that meet again are merged.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.work import drop_folder, work_folder, written

#: Width in characters of the bins in which spans meet what is asked for.
BIN = 1024


class Lineage(NamedTuple):
    """states: (id, source, state, near, far, n_spans, n_chars); spans: (id, source, start, end, origin)."""

    states: DataFrame
    spans: DataFrame


def span_closure(maps: DataFrame) -> Lineage:
    """Close ``maps`` (id, parent_id, start, end, origin) over all ways from artifacts to sources.

    A map row says that characters start to end (excluded) of the artifact are
    those of the parent from ``origin`` on; a null start says MAPPING_LOST, an empty
    span that the artifact has the parent but no character of it. A source is
    what has no row of its own. Null ids and repeated rows are ignored.

    states has a row for each artifact and source: mapped where some span
    reaches the source, MAPPING_LOST where all ways hold a lost map, else
    unmapped; ``near`` and ``far`` are the lengths of the shortest and longest
    way, n_chars the characters of all spans. Artifacts whose way runs into a
    ring have one more row with a null source and the state cycle. spans has
    each exact span once. Joins are on the end of a way; Spark splits those of
    a parent that very many artifacts have.
    """
    spark = maps.sparkSession
    base = work_folder(spark, "lineage")
    rows = maps.where("id is not null and parent_id is not null").select("id", F.col("parent_id").alias("anc"), *(F.col(c).cast("long").alias(c) for c in ("start", "end", "origin")))
    known = written(rows.select("id").distinct(), f"{base}/ids")
    ways = rows.groupBy("id", "anc").agg(F.bool_and(F.col("start").isNull()).alias("lost")).withColumns({"near": F.lit(1).cast("long"), "far": F.lit(1).cast("long"), **{c: F.lit(None).cast("long") for c in ("start", "end", "origin")}})
    spans = rows.where("start < end").select("id", "anc", F.lit(False).alias("lost"), *(F.lit(None).cast("long").alias(c) for c in ("near", "far")), "start", "end", "origin")
    every = ways.unionByName(spans).join(known.select(F.col("id").alias("anc"), F.lit(True).alias("more")), "anc", "left").withColumn("more", F.coalesce("more", F.lit(False)))
    table = written(merged(every), f"{base}/0")
    most, n = math.ceil(math.log2(max(2, known.count()))) + 1, 0
    while n < most and not table.where("more").isEmpty():
        n += 1
        table = written(merged(table.where("not more").unionByName(lengthened(table))), f"{base}/{n}")
        drop_folder(spark, f"{base}/{n - 1}")
    found, is_way = table.where("not more"), F.col("start").isNull()
    exact = found.where(~is_way).select("id", F.col("anc").alias("source"), "start", "end", "origin")
    own = exact.groupBy("id", "source").agg(F.count("*").alias("n_spans"), F.sum(F.col("end") - F.col("start")).alias("n_chars"))
    reached = found.where(is_way).groupBy("id", F.col("anc").alias("source")).agg(F.bool_and("lost").alias("lost"), F.min("near").alias("near"), F.max("far").alias("far"))
    state = F.when(F.col("n_spans") > 0, "mapped").when(F.col("lost"), "MAPPING_LOST").otherwise("unmapped")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    states = reached.join(own, ["id", "source"], "left").select("id", "source", state.alias("state"), "near", "far", zero("n_spans"), zero("n_chars"))
    ring = table.where(F.col("more") & is_way).select("id").distinct()
    none = F.lit(None).cast("long")
    ring = ring.select("id", F.lit(None).cast(states.schema["source"].dataType).alias("source"), F.lit("cycle").alias("state"), none.alias("near"), none.alias("far"), F.lit(0).cast("long").alias("n_spans"), F.lit(0).cast("long").alias("n_chars"))
    return Lineage(states.unionByName(ring), exact)


def merged(rows: DataFrame) -> DataFrame:
    """Ways of equal ends and spans of equal places as one."""
    return rows.groupBy("id", "anc", "lost", "more", "start", "end", "origin").agg(F.min("near").alias("near"), F.max("far").alias("far"))


def lengthened(table: DataFrame) -> DataFrame:
    """Ways that haven't ended, each by all ways of its end, and spans by the spans of theirs that they share characters with."""
    a = table.where("more").select("id", F.col("anc").alias("mid"), F.col("lost").alias("lost1"), *(F.col(c).alias(f"{c}1") for c in ("near", "far", "start", "end", "origin")), F.col("start").isNull().alias("way"))
    b = table.select(F.col("id").alias("mid"), "anc", F.col("lost").alias("lost2"), "more", *(F.col(c).alias(f"{c}2") for c in ("near", "far", "start", "end", "origin")), F.col("start").isNull().alias("way"))
    both = a.join(b, ["mid", "way"])
    shift = F.col("start1") - F.col("origin1")  # from a character of the middle to that of the artifact
    start, end = F.greatest("start1", F.col("start2") + shift), F.least("end1", F.col("end2") + shift)
    out = both.select("id", "anc", (F.col("lost1") | F.col("lost2")).alias("lost"), "more", "way", (F.col("near1") + F.col("near2")).alias("near"), (F.col("far1") + F.col("far2")).alias("far"),
        F.when(~F.col("way"), start).alias("start"), F.when(~F.col("way"), end).alias("end"), F.when(~F.col("way"), F.col("origin2") + start - shift - F.col("start2")).alias("origin"))
    return out.where("way or start < end").drop("way")


def derived_from(spans: DataFrame, asked: DataFrame, width: int = BIN) -> DataFrame:
    """(source, asked_start, asked_end, id, start, end): characters of artifacts that come from the ``asked`` ones (source, asked_start, asked_end).

    Spans and questions meet by source and bin of ``width`` characters, so a
    source that very many artifacts have is spread over its bins; of the bins
    that both share only the first one counts.
    """
    bins = lambda start, end: F.explode(F.sequence(F.floor(start / width), F.floor((end - 1) / width))).alias("bin")
    s = spans.withColumn("upto", F.col("origin") + F.col("end") - F.col("start"))
    s = s.select("id", "source", "start", "origin", "upto", bins(F.col("origin"), F.col("upto")))
    q = asked.where("asked_start < asked_end").select("source", "asked_start", "asked_end", bins(F.col("asked_start"), F.col("asked_end")))
    lo, hi = F.greatest("origin", "asked_start"), F.least("upto", "asked_end")
    met = s.join(q, ["source", "bin"]).where((lo < hi) & (F.col("bin") == F.floor(lo / width)))
    return met.select("source", "asked_start", "asked_end", "id", (F.col("start") + lo - F.col("origin")).alias("start"), (F.col("start") + hi - F.col("origin")).alias("end"))
