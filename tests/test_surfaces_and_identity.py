"""Paths, references, registries, pages, identity classes and near copies on small made tables."""

import random

import pytest
from brindle.operators import audit, identity, minhash, pages, surfaces
from pyspark.sql import functions as F


@pytest.mark.parametrize("path, kind, target", [
    ("tests/a.py", "test", ("follow-production-owner", "FOLLOW", 0.99)), ("x\\tests\\b", "test", ("follow-production-owner", "FOLLOW", 0.99)), ("test_a.py", "test", ("follow-production-owner", "FOLLOW", 0.99)),
    ("tools/x.py", "tooling", ("node-or-shell", "MIGRATE", 0.85)), ("a/history/b", "archive", ("none", "ARCHIVE", 1.0)), ("history/b", "other", ("review-required", "REVIEW REQUIRED", 0.0)),
    ("private/policy_x.py", "runtime", ("retain-python", "RETAIN", 0.98)), ("a/CanonicalX.py", "other", ("rust", "MIGRATE", 0.9)), ("a/Edge.py", "other", ("typescript", "MIGRATE", 0.9)), ("a/FANOUT", "other", ("go", "MIGRATE", 0.9)), (None, "other", ("review-required", "REVIEW REQUIRED", 0.0)),
])
def test_paths(spark, path, kind, target):
    row = spark.createDataFrame([(path,)], "p string").select(surfaces.path_class(F.col("p")).alias("c"), surfaces.path_target(F.col("p")).alias("t")).first()
    assert row.c == kind and tuple(row.t) == target


def test_modules_are_found_by_path_tail_and_dotted_name(spark):
    rows = [("a/b.py", "a/c.py"), ("a/c.py", None), ("d.py", ""), ("r1", "see x/a/b.py."), ("r2", "import a.b, z.a.c"), ("r3", "a/bb.py xa/c.pyc d.py"), ("r4", None)]
    got = {tuple(r) for r in surfaces.module_references(spark.createDataFrame(rows, "path string, text string"), "path", "text").collect()}
    assert got == {("a/b.py", "r1"), ("a/b.py", "r2"), ("a/c.py", "r2"), ("d.py", "r3")}


@pytest.mark.parametrize("page, title, blocks", [
    ("<title> a &amp; b\n c</title>", "a & b c", 1 - 1), ("<!-- <title>x</title> --><TITLE lang=en>y</TITLE >", "y", 0), ("<script>'<title>no</title>'</script><title>z</title>", "z", 0),
    ("<title>one</title><title>two</title>", "one two", 0), ("<title>a<b>c</b></title>", "a c", 0), ("<title>open", "open", 0), ("<script type='application/ld+json'>{}</script>", "", 1),
    ('<script async type=application/ld+json>{}</script><script type="application/LD+JSON"> </script>', "", 1), ("<script data-type='application/ld+json'>{}</script>", "", 0), ("<script type='application/ld&#43;json'>x", "", 1), ("", "", 0), (None, "", 0), ("<title>" + "w " * 900 + "</title>", ("w " * 150).rstrip()[:300], 0),
])
def test_pages_by_expression_and_tokenizer(spark, page, title, blocks):
    row = pages.page_structure(spark.createDataFrame([(1, page, None)], "page_id int, html string, http_status int")).first()
    assert (row.title.strip(), row.jsonld_blocks) == (title, blocks)
    assert pages.tokens_of(page or "")[0].strip() == title and pages.tokens_of(page or "")[1] == blocks


def test_very_long_pages_and_answers(spark):
    long = "<script>" + "x<" * 200000 + "</script><!--" + "y" * 300000 + "--><title>t</title> price"
    rows = [(1, long, 200), (2, "price", 403), (3, "price", 429), (4, "price", 500), (5, "price", 404), (6, " \n", 200), (7, "price", 200), (8, "none", 200)]
    got = {r.page_id: r.status for r in pages.page_structure(spark.createDataFrame(rows, "page_id int, html string, http_status int")).collect()}
    assert got == {1: "ok", 2: "blocked", 3: "resource_limited", 4: "error", 5: "error", 6: "empty", 7: "ok", 8: "empty"}


FIELDS = "id long, url string, sku string, gtin string, brand string, title string, region string, color string, n int, rep long"


def records(r, n, start):
    pick = lambda *x: r.choice(x)
    return [(start + i, pick(None, None, "http://X/a/", "http://x/a#f", "http://y/b"), pick(None, None, "S1", "s1 ", "S2", " "), pick(None, None, "1", "2"), pick("Acme", "acme", "Best", None), pick("Phone", "phone ", "Tab", None), pick(None, "in", "us"), pick(None, None, "red"), 1, 2) for i in range(n)]


def by_pairs(targets, candidates):
    names = ["url", "sku", "gtin", "brand", "region", "color"]
    norm = lambda row: {k: ((v.split("#")[0].rstrip("/").lower() if k == "url" else v.strip().lower()) or None) if v is not None else None for k, v in zip(["url", "sku", "gtin", "brand", "title", "region", "color"], row[1:8], strict=True)}
    out = {}
    for a in targets:
        for b in candidates:
            x, y = norm(a), norm(b)
            both = [f for f in names if x[f] and y[f]]
            matched, conflicts = [f for f in both if x[f] == y[f]], [f for f in both if x[f] != y[f]]
            named = x["title"] and x["title"] == y["title"] and x["brand"] and x["brand"] == y["brand"]
            ok = not conflicts and bool({"sku", "gtin", "url"} & set(matched) or named)
            if {"sku", "gtin", "url"} & set(matched) or named:
                out[a[0], b[0]] = ok
    return out


def test_class_decisions_expand_to_those_of_all_pairs(spark):
    r = random.Random(11)
    targets, candidates = records(r, 70, 0), records(r, 90, 1000)
    m = identity.match_classes(spark.createDataFrame(targets, FIELDS), spark.createDataFrame(candidates, FIELDS))
    t, c = ({x.id: (x.rep, x.group) for x in d.collect()} for d in (m.t_members, m.c_members))
    rows = m.decisions.collect()
    strong = {(x.t_rep, x.c_rep): x.accepted for x in rows if x.kind == "strong"}
    soft = {(x.t_rep, x.c_rep): x.accepted for x in rows if x.kind == "soft"}
    got = {}
    for a, (ar, ag) in t.items():
        for b, (br, bg) in c.items():
            if (ar, br) in strong:
                got[a, b] = strong[ar, br]
            elif (ag, bg) in soft:
                got[a, b] = soft[ag, bg]
    assert got == by_pairs(targets, candidates) and sum(x.n_pairs for x in rows) == len(got)
    assert len(rows) < len(got)
    assert identity.match_classes(spark.createDataFrame([], FIELDS), spark.createDataFrame(candidates, FIELDS)).decisions.count() == 0


@pytest.mark.parametrize("bound", [0.2, 0.5, 0.8, 1.0])
def test_similar_pairs_lose_none(spark, bound):
    r = random.Random(int(bound * 10))
    rows = [(i, r.choices("abcdefgh", [9, 5, 3, 2, 2, 1, 1, 1], k=r.randint(0, 6)), r.choices("xyzuv", k=r.randint(0, 4)) if i % 9 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, p array<string>, q array<string>")
    got = {(x.left_id, x.right_id): x.score for x in audit.similar_pairs(df, df, ["p", "q"], bound).collect()}
    j = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if set(a) | set(b) else 0.0
    want = {(i, k): round((j(p, a) + j(q or [], b or [])) / 2, 6) for i, p, q in rows for k, a, b in rows}
    assert got == {k: pytest.approx(v, abs=2e-6) for k, v in want.items() if v >= bound and v > 0}


def test_near_copies_are_found_and_copies_are_one_class(spark):
    r = random.Random(3)
    prose = lambda n: [f"w{r.randint(0, 900)}" for _ in range(n)]
    base = [prose(120) for _ in range(12)]
    def spoilt(w, n):
        w = list(w)
        for _ in range(n):
            w[r.randrange(len(w))] = "zz"
        return " ".join(w)
    left = [(i, " ".join(b)) for i, b in enumerate(base)] + [(50, None), (51, " \n"), (52, "Two  words"), (53, " ".join(base[0]).upper())]
    right = [(100 + i, spoilt(b, i % 4)) for i, b in enumerate(base)] + [(200 + i, " ".join(base[1])) for i in range(30)] + [(300, "two words"), (301, ""), (302, " ".join(prose(100)))]
    frame = lambda rows: spark.createDataFrame([(*x, 1, "s") for x in rows], "id int, text string, n int, s string").repartition(3)
    pairs, lm, rm = minhash.near_classes(frame(left), frame(right), "id", "text")
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    want = {(a, b) for a, x in left for b, y in right if shingles(x) and len(shingles(x) & shingles(y)) >= 0.8 * len(shingles(x) | shingles(y))}
    l, m = ({x.id: x.rep for x in d.collect()} for d in (lm, rm))  # noqa: E741
    found = {(x.left_rep, x.right_rep) for x in pairs.collect()}
    assert {(a, b) for a in l for b in m if (l[a], m[b]) in found} == want and len(found) < len(want) / 2
    assert {x.n_right for x in pairs.where("right_rep >= 200 and right_rep < 300").collect()} <= {30, 31}


def test_registries_pass_only_when_nothing_is_wrong(spark):
    rows = [("a", "x", "n", "p", ["w"], ["t"]), ("a", "y", None, "p", ["w", "gone"], None), ("b", "x", "n", "p", [], ["t", "u"])]
    c = spark.createDataFrame(rows, "registry string, component string, owner string, purpose string, references array<string>, tags array<string>").withColumnRenamed("registry", "k")
    links = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "more"), ("b", "x")], "k string, component string")
    got = {r.k: r for r in surfaces.completeness_report(c, ["k"], ["owner", "purpose"], spark.createDataFrame([("w",)], "name string"), ("t",), links).collect()}
    assert (got["a"].n, got["a"].registry, got["a"].references, got["a"].controls, got["a"].navigation, got["a"].score, got["a"].status) == (2, 50.0, 50.0, 50.0, 0.0, 30.0, "FAIL")
    assert (got["b"].n, got["b"].score, got["b"].status) == (1, 100.0, "PASS")
