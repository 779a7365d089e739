"""Contradictions between typed claims, without comparing all claims of a bucket.

Claims are made comparable first: amounts in the base unit of their dimension,
claims that only give a bound (starts_at and the like) or no value left out.
Claims of one bucket (entity, predicate, scope, time window, dimension) and one
value are a class. Two amounts contradict if they differ by more than a part of
the larger one, so the amounts that contradict a given one are those below one
bound and above another; one sorted pass over a bucket's classes and bounds
tells how many these are and which class is the nearest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Qualifiers with which a value is a bound and not the value.
BOUNDS = ("starts_at", "from", "up_to", "at_least", "at_most", "approximately")


def normalized(claims: DataFrame, units: dict[str, tuple[str, int]]) -> DataFrame:
    """``claims`` (value, unit, qualifier, ...) with dimension and amount in its base unit; those that assert no exact value are left out.

    ``units`` gives each unit's dimension and factor. A unit that isn't known
    is a dimension of its own, so that its values meet only their like.
    """
    table = F.create_map(*[F.lit(x) for u in units for x in (u, units[u][0])])
    factor = F.create_map(*[F.lit(x) for u in units for x in (u, units[u][1])])
    unit = F.lower(F.trim(F.coalesce("unit", F.lit(""))))
    exact = F.col("value").isNotNull() & ~F.coalesce(F.lower(F.trim("qualifier")).isin(*BOUNDS), F.lit(False))
    return claims.where(exact).withColumns({"dimension": F.coalesce(F.try_element_at(table, unit), unit), "amount": F.col("value").cast("long") * F.coalesce(F.try_element_at(factor, unit), F.lit(1))})


def classes(claims: DataFrame, bucket: list[str], value: str) -> DataFrame:
    """(bucket, value, rep, n): claims of one value as a class, named by its smallest id."""
    return claims.groupBy(*bucket, value).agg(F.min("id").alias("rep"), F.count("*").alias("n"))


def amount_conflicts(claims: DataFrame, bucket: list[str], percent: int) -> DataFrame:
    """(bucket, amount, rep, n, n_below, n_above, below_rep, above_rep): every class that contradicts another, with how many claims do on either side and the nearest such classes.

    Amounts a and b contradict where |a - b| > ``percent`` / 100 * max(|a|, |b|).
    Bounds are exact: all places are whole numbers, scaled by 100 * (100 - percent).
    The sort of a bucket is over its different values, however many claims there are.
    """
    rest = 100 - percent
    c = classes(claims, bucket, "amount")
    a = F.col("amount").cast("decimal(20,0)")
    place, low, high = a * 100 * rest, F.when(a > 0, a * rest * rest).otherwise(a * 100 * 100), F.when(a >= 0, a * 100 * 100).otherwise(a * rest * rest)
    point = lambda kind, at, n, rep: F.struct(F.lit(kind).alias("kind"), at.cast("decimal(38,0)").alias("at"), n.cast("long").alias("n_here"), rep.alias("rep_here"))
    none = F.lit(None).cast(claims.schema["id"].dataType)
    # a lower bound comes before, an upper bound after classes at its place
    points = c.select(*bucket, "amount", "rep", "n", F.explode(F.array(point(1, place, F.col("n"), F.col("rep")), point(0, low, F.lit(0), none), point(2, high, F.lit(0), none))).alias("p")).select("*", "p.*").drop("p")
    order = Window.partitionBy(*bucket).orderBy("at", "kind")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    swept = points.withColumns({"before": F.sum("n_here").over(upto), "following": F.sum("n_here").over(after), "last": F.last("rep_here", ignorenulls=True).over(upto), "next": F.first("rep_here", ignorenulls=True).over(after)})
    at = lambda kind, name: F.max(F.when(F.col("kind") == kind, F.col(name)))
    out = swept.groupBy(*bucket, "amount", "rep", "n").agg(at(0, "before").alias("n_below"), at(2, "following").alias("n_above"), at(0, "last").alias("below_rep"), at(2, "next").alias("above_rep"))
    return out.where("n_below + n_above > 0")


def category_conflicts(claims: DataFrame, bucket: list[str]) -> DataFrame:
    """(bucket, category, negated, rep, n, n_other, other_rep): classes of mutually exclusive categories that contradict others.

    Two positive claims contradict if their categories differ; a positive and a
    negated one if they are the same. ``other_rep`` is the smallest class
    against it. Buckets are summed, not gathered.
    """
    c = claims.where("category is not null").groupBy(*bucket, "category", "negated").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    w, same = Window.partitionBy(*bucket), Window.partitionBy(*bucket, "category")
    positive = ~F.col("negated")
    c = c.withColumns({"all_n": F.sum(F.when(positive, F.col("n"))).over(w), "first_rep": F.min(F.when(positive, F.col("rep"))).over(w)})
    c = c.withColumns({"second_rep": F.min(F.when(positive & (F.col("rep") != F.col("first_rep")), F.col("rep"))).over(w),
        "opposite_n": F.sum("n").over(same) - F.col("n"), "opposite_rep": F.max(F.when(~positive, F.col("rep"))).over(same), "asserted_rep": F.max(F.when(positive, F.col("rep"))).over(same)})
    other = F.when(F.col("rep") == F.col("first_rep"), F.col("second_rep")).otherwise(F.col("first_rep"))
    n_other = F.when(positive, F.col("all_n") - F.col("n") + F.col("opposite_n")).otherwise(F.col("opposite_n"))
    rep = F.when(positive, F.least(other, "opposite_rep")).otherwise(F.col("asserted_rep"))
    return c.select(*bucket, "category", "negated", "rep", "n", n_other.alias("n_other"), rep.alias("other_rep")).where("n_other > 0")


def members(claims: DataFrame, bucket: list[str], value: str) -> DataFrame:
    """(id, rep): each claim with its class."""
    c = classes(claims, bucket, value)
    same = [claims[k].eqNullSafe(c[k]) for k in (*bucket, value)]
    cond: Column = same[0]
    for x in same[1:]:
        cond = cond & x
    return claims.join(c, cond).select(claims["id"], c["rep"])
