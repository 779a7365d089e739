"""Digest trees of inventories: one digest for a group of any size, and cheap differences between two inventories.

Lines are ordered by the hash of their key, so a node is a range of that order,
named by the hash's first hexadecimal digits. A leaf's digest is made of its
lines, an inner node's of its up to 16 children; no row holds more than that.
A line that comes or goes changes the nodes above it and no others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.work import work_folder, written

#: Lines of a leaf on average, at most.
LEAF = 16


def digest_lines(rows: DataFrame, keys: list[str], key: Column, value: Column) -> DataFrame:
    """(keys, key, h, d, n): each different line of a group once, with the hash of its key, its digest and how often it is there."""
    k, v = (F.coalesce(c.cast("string"), F.lit("")) for c in (key, value))
    lines = rows.select(*keys, k.alias("key"), F.sha2(k, 256).alias("h"), F.sha2(F.concat(F.length(k).cast("string"), F.lit(":"), k, v), 256).alias("d"))
    return lines.groupBy(*keys, "key", "h", "d").agg(F.count("*").alias("n"))


def depth_for(lines: DataFrame, keys: list[str], leaf: int = LEAF) -> int:
    """Levels below the root with which the largest group's leaves have ``leaf`` lines on average at most."""
    most = lines.groupBy(*keys).agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    depth = 0
    while leaf * 16**depth < most:
        depth += 1
    return depth


def digest_tree(lines: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """(keys, prefix, n, digest) of all nodes; the root's prefix is empty. ``lines`` are those of ``digest_lines``."""
    path = work_folder(lines.sparkSession, "tree")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "d", "n"))), lambda x: F.concat(x["d"], F.lit(":"), x["n"].cast("string"))), "\n")
    level = lines.groupBy(*keys, F.substring("h", 1, depth).alias("prefix")).agg(F.sum("n").alias("n"), F.sha2(text, 256).alias("digest"))
    levels = [written(level, f"{path}/{depth}")]
    for size in range(depth - 1, -1, -1):
        child = F.concat("prefix", F.lit(":"), "digest")
        up = levels[-1].withColumn("c", child).groupBy(*keys, F.left("prefix", F.lit(size)).alias("prefix"))
        levels.append(written(up.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("c")), "\n"), 256).alias("digest")), f"{path}/{size}"))
    return reduce(DataFrame.unionByName, levels)


def roots(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_lines, digest) of each group."""
    return digest_tree(lines, keys, depth_for(lines, keys)).where("prefix = ''").select(*keys, F.col("n").alias("n_lines"), "digest")


def unequal_leaves(left: DataFrame, right: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """(keys, prefix) of leaves that differ, found from the root down: only children of unequal nodes are compared."""
    suspects = None
    for size in range(depth + 1):
        a, b = (t.where(F.length("prefix") == size).select(*keys, "prefix", F.col("digest").alias(name)) for t, name in ((left, "a"), (right, "b")))
        if suspects is not None:
            below = suspects.withColumnRenamed("prefix", "upper")
            a, b = (t.withColumn("upper", F.left("prefix", F.lit(size - 1))).join(below, [*keys, "upper"], "left_semi").drop("upper") for t in (a, b))
        suspects = a.join(b, [*keys, "prefix"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys, "prefix")
    return suspects


def inventory_changes(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, key, change): lines of ``digest_lines`` that are removed, added or changed from left to right; only lines of unequal leaves are read against each other.

    A key with several lines is changed if their digests or numbers differ.
    """
    path = work_folder(left.sparkSession, "tree")
    left, right = written(left, f"{path}/left"), written(right, f"{path}/right")
    depth = max(depth_for(left, keys), depth_for(right, keys))
    leaves = written(unequal_leaves(digest_tree(left, keys, depth), digest_tree(right, keys, depth), keys, depth), f"{path}/leaves")

    def side(lines: DataFrame, name: str) -> DataFrame:
        own = lines.withColumn("prefix", F.substring("h", 1, depth)).join(leaves, [*keys, "prefix"], "left_semi")
        # 64 bits of every line of a key, added up, tell whether the same lines are there as often
        return own.groupBy(*keys, "key").agg(F.sum(F.xxhash64("d", "n").cast("decimal(38,0)")).alias(name))

    both = side(left, "a").join(side(right, "b"), [*keys, "key"], "full_outer")
    change = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "changed")
    return both.select(*keys, "key", change.alias("change")).where("change is not null")
