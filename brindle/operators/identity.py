"""Entity matching by classes: decisions between groups of records that are alike, instead of between all records.

Records with equal identity columns are one class. Classes that share an
identifier or the URL meet one by one. Those that only share brand and title
are first grouped by all columns but the identifiers, of which only is kept
which are there: all pairs of two such groups have one decision, but those that
share an identifier, which have met already. So the output grows with the
records and the variants of a product, not with the square of a product's
offers.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.urls import url_key
from brindle.operators.catalog import IDENTITY_DIMENSIONS, IDENTITY_STRONG

FIELDS = ["url", *IDENTITY_STRONG, "brand", *IDENTITY_DIMENSIONS]


class Matches(NamedTuple):
    """decisions: (kind, t_rep, c_rep, n_pairs, matched, conflicts, accepted, reason); t_members and c_members: (id, rep, group)."""

    decisions: DataFrame
    t_members: DataFrame
    c_members: DataFrame


def prepared(df: DataFrame) -> DataFrame:
    """id and the identity columns in comparable form; what a table lacks is null."""
    col = lambda f: (url_key(F.col(f)) if f == "url" else F.nullif(F.lower(F.trim(F.col(f).cast("string"))), F.lit(""))) if f in df.columns else F.lit(None).cast("string")
    return df.select("id", *[col(f).alias(f) for f in [*FIELDS, "title"]])


def classed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, group, n, identity columns) of each class, and (id, rep, group) of each record; rep and group are smallest ids."""
    columns = [*FIELDS, "title"]
    soft = [c for c in columns if c not in IDENTITY_STRONG]
    # one text a record that is equal where all columns are, nulls included
    key = lambda names, more=(): F.to_json(F.struct(*[F.col(n) for n in names], *more), {"ignoreNullFields": "false"})
    has = F.concat(*[F.col(f).isNotNull().cast("int").cast("string") for f in IDENTITY_STRONG]).alias("has")
    rows = prepared(df).withColumns({"k": F.sha2(key(columns), 256), "g": F.sha2(key(soft, (has,)), 256)})
    classes = rows.groupBy("k", "g", *columns).agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    groups = classes.groupBy("g").agg(F.min("rep").alias("group"))
    classes = classes.join(groups, "g")
    members = rows.select("id", "k").join(classes.select("k", "rep", "group"), "k").select("id", "rep", "group")
    return classes.drop("k", "g"), members


def decision(pairs: DataFrame, keys: list[str], fields: list[str], named: Column) -> DataFrame:
    """``keys``, matched, conflicts, accepted and reason of pairs with the columns t_<field> and c_<field>."""
    pick = lambda test: F.filter(F.array(*[F.when(test(F.col(f"t_{f}"), F.col(f"c_{f}")), f) for f in fields]), lambda x: x.isNotNull())
    rows = pairs.select(*keys, pick(lambda a, b: a == b).alias("matched"), pick(lambda a, b: a != b).alias("conflicts"), named.alias("named"))
    strong = F.size(F.array_intersect("matched", F.array(*[F.lit(f) for f in IDENTITY_STRONG]))) > 0
    reason = (
        F.when(F.size("conflicts") > 0, "identity conflict")
        .when(strong, "exact identity match")
        .when(F.array_contains("matched", "url"), "canonical URL match")
        .when(F.coalesce("named", F.lit(False)), "exact brand and title match")
        .otherwise("insufficient identity evidence")
    )
    return rows.select(*keys, "matched", "conflicts", reason.rlike("match$").alias("accepted"), reason.alias("reason"))


def match_classes(targets: DataFrame, candidates: DataFrame) -> Matches:
    """Decisions between the classes of ``targets`` and ``candidates`` (id and any identity columns) that share an identifier, the URL, or brand and title.

    kind ``strong``: two classes, named by their smallest ids, that share an
    identifier or the URL. kind ``soft``: two groups of classes that share brand
    and title; the decision holds for all their pairs that aren't among the
    strong ones, whose number is n_pairs. An identifier that both sides of a
    soft pair have is a conflict. Pairs that are in neither kind can't be
    accepted. Null and blank values match nothing; a null id is an id.
    """
    (t, t_members), (c, c_members) = classed(targets), classed(candidates)
    side = lambda df, p: df.select(*[F.col(x).alias(f"{p}_{x}") for x in df.columns])
    t, c = side(t, "t"), side(c, "c")
    meet = lambda f: t.where(F.col(f"t_{f}").isNotNull()).select("t_rep", F.col(f"t_{f}").alias("v")).join(c.where(F.col(f"c_{f}").isNotNull()).select("c_rep", F.col(f"c_{f}").alias("v")), "v").select("t_rep", "c_rep")
    shared = reduce(DataFrame.unionByName, [meet(f) for f in ("url", *IDENTITY_STRONG)]).distinct()
    both = shared.join(t, "t_rep").join(c, "c_rep").withColumn("n_pairs", F.col("t_n") * F.col("c_n"))
    named = (F.col("t_title") == F.col("c_title")) & (F.col("t_brand") == F.col("c_brand"))
    strong = decision(both, ["t_rep", "c_rep", "n_pairs"], FIELDS, named)
    listed = both.where(named).groupBy("t_group", "c_group").agg(F.sum("n_pairs").alias("listed"))
    soft_fields = [f for f in FIELDS if f not in IDENTITY_STRONG]

    def grouped(df: DataFrame, p: str) -> DataFrame:
        flags = [F.max(F.col(f"{p}_{f}").isNotNull()).alias(f"{p}_{f}") for f in IDENTITY_STRONG]
        return df.where(F.col(f"{p}_brand").isNotNull() & F.col(f"{p}_title").isNotNull()).groupBy(f"{p}_group", *[f"{p}_{f}" for f in [*soft_fields, "title"]]).agg(F.sum(f"{p}_n").alias(f"{p}_n"), *flags)

    a, b = grouped(t, "t"), grouped(c, "c")
    pairs = a.join(b, (F.col("t_brand") == F.col("c_brand")) & (F.col("t_title") == F.col("c_title"))).where(~F.coalesce(F.col("t_url") == F.col("c_url"), F.lit(False)))
    # an identifier that both have is a conflict, one that a side lacks says nothing
    for f in IDENTITY_STRONG:
        there = F.col(f"t_{f}") & F.col(f"c_{f}")
        pairs = pairs.withColumns({f"t_{f}": F.when(there, "a"), f"c_{f}": F.when(there, "b")})
    pairs = pairs.join(listed, ["t_group", "c_group"], "left").withColumn("n_pairs", F.col("t_n") * F.col("c_n") - F.coalesce("listed", F.lit(0))).where("n_pairs > 0")
    soft = decision(pairs.withColumnsRenamed({"t_group": "t_rep", "c_group": "c_rep"}), ["t_rep", "c_rep", "n_pairs"], FIELDS, F.lit(True))
    decisions = strong.select(F.lit("strong").alias("kind"), "*").unionByName(soft.select(F.lit("soft").alias("kind"), "*"))
    return Matches(decisions, t_members, c_members)
