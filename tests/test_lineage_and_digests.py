"""Span closure, digest trees and typed contradictions on small made tables."""

import random

import pytest
from brindle.operators import contradiction, digest_tree, lineage
from pyspark.sql import functions as F

MAPS = "id string, parent_id string, start long, end long, origin long, state string"


def closure(spark, rows):
    out = lineage.span_closure(spark.createDataFrame([(*r, "clash") for r in rows], MAPS).repartition(3))
    return {(r.id, r.source): (r.state, r.near, r.far, r.n_spans, r.n_chars) for r in out.states.collect()}, {tuple(r) for r in out.spans.collect()}


def test_spans_are_composed_and_lost_maps_stay_lost(spark):
    rows = [("b", "a", 0, 10, 5), ("b", "a", 10, 20, 40), ("c", "b", 0, 12, 4), ("d", "c", None, None, None), ("e", "d", 0, 9, 0), ("f", "c", 3, 3, 0), ("f", "c", 3, 3, 0), (None, "a", 0, 1, 0)]
    states, spans = closure(spark, rows)
    assert states == {("b", "a"): ("mapped", 1, 1, 2, 20), ("c", "a"): ("mapped", 2, 2, 2, 12), ("d", "a"): ("MAPPING_LOST", 3, 3, 0, 0), ("e", "a"): ("MAPPING_LOST", 4, 4, 0, 0), ("f", "a"): ("unmapped", 3, 3, 0, 0)}
    assert spans == {("b", "a", 0, 10, 5), ("b", "a", 10, 20, 40), ("c", "a", 0, 6, 9), ("c", "a", 6, 12, 40)}


def test_long_chains_diamonds_and_rings(spark):
    chain = [(f"n{i:02}", f"n{i - 1:02}", 0, 100, 1) for i in range(1, 40)]
    diamond = [("y1", "x", 0, 5, 0), ("y2", "x", 0, 5, 0), ("z", "y1", 0, 5, 0), ("z", "y2", 0, 5, 0), ("z", "y2", 5, 8, 2)]
    ring = [("r1", "r2", 0, 1, 0), ("r2", "r1", 0, 1, 0), ("q", "r1", 0, 1, 0), ("q", "x", 0, 1, 0), ("s", "s", 0, 1, 0)]
    states, spans = closure(spark, chain + diamond + ring)
    assert states["n39", "n00"] == ("mapped", 39, 39, 1, 62) and ("n39", "n00", 0, 62, 39) in spans  # each step shifts by one
    assert states["z", "x"] == ("mapped", 2, 2, 2, 8)  # equal spans of both ways are one
    assert {i for (i, s), v in states.items() if v[0] == "cycle"} == {"r1", "r2", "q", "s"} and states["q", "x"][0] == "mapped"
    assert closure(spark, []) == ({}, set())


def test_reverse_lookup_equals_a_scan_whatever_the_bins(spark):
    r = random.Random(7)
    spans = [(f"d{i}", r.choice("ab"), s := r.randrange(50), s + r.randrange(1, 90), r.randrange(300)) for i in range(120)]
    asked = [("a", 0, 1), ("a", 10, 200), ("b", 64, 65), ("b", 100, 100), ("c", 0, 9)]
    want = sorted((q, a, z, i, s + max(o, a) - o, s + min(o + e - s, z) - o) for q, a, z in asked for i, src, s, e, o in spans if src == q and max(o, a) < min(o + e - s, z))
    sdf = spark.createDataFrame(spans, "id string, source string, start long, end long, origin long")
    qdf = spark.createDataFrame(asked, "source string, asked_start long, asked_end long")
    for width in (7, 1024):
        assert sorted(tuple(x) for x in lineage.derived_from(sdf, qdf, width).collect()) == want


def lines(spark, rows):
    df = spark.createDataFrame(rows, "repo string, k string, v string, digest string, n int").repartition(3)
    return digest_tree.digest_lines(df, ["repo"], F.col("k"), F.col("v"))


def test_tree_digests_tell_contents_apart_and_not_order(spark):
    rows = [("r", f"k{i}", str(i % 7), "clash", 1) for i in range(900)] + [("s", None, None, "clash", 1), ("s", "x", "y", "clash", 1), ("s", "x", "y", "clash", 1)]
    one = {x.repo: (x.n_lines, x.digest) for x in digest_tree.roots(lines(spark, rows), ["repo"]).collect()}
    two = {x.repo: (x.n_lines, x.digest) for x in digest_tree.roots(lines(spark, rows[::-1]), ["repo"]).collect()}
    assert one == two and one["r"][0] == 900 and one["s"][0] == 3
    for spoilt in (rows[1:], rows + rows[:1], [("r", "k0", "other", "", 1), *rows[1:]]):
        assert {x.repo: x.digest for x in digest_tree.roots(lines(spark, spoilt), ["repo"]).collect()}["r"] != one["r"][1]
    tree = digest_tree.digest_tree(lines(spark, rows), ["repo"], 2)
    assert tree.groupBy("repo", F.length("prefix").alias("size")).agg(F.sum("n").alias("n")).where("repo = 'r' and n <> 900").isEmpty()


def test_only_unequal_leaves_are_compared(spark):
    left = [("r", f"k{i}", "v", "", 1) for i in range(2000)]
    right = [("r", f"k{i}", "v" if i != 77 else "w", "", 1) for i in range(5, 2000)] + [("r", "new", "v", "", 1), ("r", "k9", "v", "", 1), ("t", "a", "b", "", 1)]
    a, b = lines(spark, left), lines(spark, right)
    leaves = digest_tree.unequal_leaves(*(digest_tree.digest_tree(x, ["repo"], 2) for x in (a, b)), ["repo"], 2).count()
    assert leaves <= 9
    got = {(x.repo, x.key): x.change for x in digest_tree.inventory_changes(a, b, ["repo"]).collect()}
    assert got == {("r", f"k{i}"): "removed" for i in range(5)} | {("r", "k77"): "changed", ("r", "k9"): "changed", ("r", "new"): "added", ("t", "a"): "added"}
    assert digest_tree.inventory_changes(a, a, ["repo"]).count() == 0


CLAIMS = "id long, entity string, value long, unit string, qualifier string, category string, negated boolean, rep long"


@pytest.mark.parametrize("percent", [1, 30, 99])
def test_amounts_against_all_pairs(spark, percent):
    r = random.Random(percent)
    rows = [(i, r.choice("ab"), r.choice([None, 0, 1, -1, r.randint(-300, 300), r.randint(1, 10**12)]), r.choice([" KG", "g", None, "stone"]), r.choice([None, None, "starts_at", "exact"]), None, False, 9) for i in range(250)]
    df = contradiction.normalized(spark.createDataFrame(rows, CLAIMS).drop("rep"), {"g": ("mass", 1), "kg": ("mass", 1000)})
    bucket = ["entity", "dimension"]
    got = {(x.entity, x.dimension, x.amount): (x.rep, x.n, x.n_below, x.n_above, x.below_rep, x.above_rep) for x in contradiction.amount_conflicts(df, bucket, percent).collect()}
    cls = {}
    for i, e, v, u, q, *_ in rows:
        if v is not None and q != "starts_at":
            u = (u or "").strip().lower()
            cls.setdefault((e, "mass" if u in ("g", "kg") else u), {}).setdefault(v * (1000 if u == "kg" else 1), []).append(i)
    want = {}
    for (e, d), by in cls.items():
        for a, ids in by.items():
            far = [b for b in by if abs(a - b) * 100 > percent * max(abs(a), abs(b))]
            low, high = [b for b in far if b < a], [b for b in far if b > a]
            if far:
                want[e, d, a] = (min(ids), len(ids), sum(len(by[b]) for b in low), sum(len(by[b]) for b in high), min(by[max(low)]) if low else None, min(by[min(high)]) if high else None)
    assert got == want
    assert contradiction.members(df, bucket, "amount").count() == sum(len(i) for by in cls.values() for i in by.values())


def test_categories_exclude_each_other_and_denials_their_own(spark):
    rows = [(1, "a", "red", False), (2, "a", "red", False), (3, "a", "blue", False), (4, "a", "green", True), (5, "b", "red", False), (6, "b", "red", True), (7, "c", "red", True), (8, "c", "blue", True), (9, "d", None, False), (10, "d", "x", False)]
    df = spark.createDataFrame([(i, e, c, n, 1) for i, e, c, n in rows], "id long, entity string, category string, negated boolean, n int").drop("n")
    got = {(x.entity, x.category, x.negated): (x.rep, x.n, x.n_other, x.other_rep) for x in contradiction.category_conflicts(df, ["entity"]).collect()}
    assert got == {("a", "red", False): (1, 2, 1, 3), ("a", "blue", False): (3, 1, 2, 1), ("b", "red", False): (5, 1, 1, 6), ("b", "red", True): (6, 1, 1, 5)}
