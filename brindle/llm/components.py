"""Connected components of a table of links, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import drop_dir, hot_join, work_dir, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is its smallest reachable node.

    Alternates two steps until nothing changes: every node hands its smaller
    neighbourhood minimum to its larger neighbours, then to its smaller ones.
    The number of rounds grows with the logarithm of the longest path. A node
    with very many links is handled by ``hot_join``; no node's neighbours are
    ever gathered in one place. Null ends and self links are ignored.
    """
    spark = links.sparkSession
    base, step = work_dir(spark), 0
    pairs = links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct()
    pairs = written(pairs, f"{base}/{step}")
    while True:
        # large step: both directions, each node's minimum goes to its larger neighbours
        both = pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        least = written(least, f"{base}/{step}-m")
        star = hot_join(both.where("v > u"), least, "u", "n").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        star = written(star.where("lo < hi").distinct(), f"{base}/{step}-l")
        # small step: each node's smaller neighbours meet at its minimum
        least = star.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        least = written(least, f"{base}/{step}-s")
        moved = hot_join(star, least, "hi", "n").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).unionByName(least.select(F.col("m").alias("lo"), "hi"))
        step += 1
        pairs = written(moved.where("lo < hi").distinct(), f"{base}/{step}")
        for name in (f"{step - 1}", f"{step - 1}-m", f"{step - 1}-l", f"{step - 1}-s"):
            drop_dir(spark, f"{base}/{name}")
        # done when each node hangs on one other, and that one on none
        twice = pairs.groupBy("hi").count().where("count > 1").select("hi")
        chained = pairs.select("hi").join(pairs.select(F.col("lo").alias("hi")).distinct(), "hi", "left_semi")
        if twice.unionByName(chained).isEmpty():
            break
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
