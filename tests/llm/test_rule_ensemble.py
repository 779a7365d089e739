"""The rule ensemble: paths, lasso optimum, compiled expressions, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pytest
from brindle.llm import rule_ensemble as re_
from brindle.llm.quality_rules import FEATURES, grow

SF = "/root/testdata/sf0.01"


def made(n=3000, seed=1):
    r = np.random.default_rng(seed)
    x = r.random((n, len(FEATURES)))
    y = ((x[:, 2] > 0.6) & (x[:, 5] <= 0.7) ^ (r.random(n) < 0.05)).astype(float)
    return x, y


def test_paths_cover_each_leaf_once():
    x, y = made()
    trees = grow(x, y, np.zeros(len(FEATURES), int))
    rules = re_.paths(trees)
    assert len(rules) == len(set(rules)) > 50
    one = re_.Rule((("words", "<=", 0.5), ("words", ">", 0.2)))
    assert (one.holds(x) == ((x[:, 0] <= 0.5) & (x[:, 0] > 0.2))).all() and str(one) == "words <= 0.5 and words > 0.2"


def test_lasso_meets_its_optimality_conditions():
    x, y = made(800)
    _, held = re_.candidates(re_.paths(grow(x, y, np.zeros(len(FEATURES), int))), x)
    penalty = 0.01
    w, b = re_.lasso(held, y, penalty, rounds=20000, close=1e-10)
    grad = held.T @ (1 / (1 + np.exp(-(held @ w + b))) - y) / len(y)
    assert abs((1 / (1 + np.exp(-(held @ w + b))) - y).mean()) < 1e-4
    assert (np.abs(grad) <= penalty + 1e-4).all()
    assert np.allclose(grad[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-3)
    assert 0 < (w != 0).sum() < len(w) / 2


def test_fit_finds_the_rule_and_is_sparse():
    x, y = made()
    model = re_.fit(x, y)
    z, t = made(2000, 2)
    assert ((model.scores(z) >= 0.5) == t).mean() > 0.92
    assert 0 < len(model.rules) < len(re_.candidates(re_.paths(grow(x, y, np.zeros(len(FEATURES), int))), x)[0]) / 3 and len(model.lines()) == len(model.rules)


def test_compiled_expressions_equal_the_numpy_scores(spark):
    x, y = made()
    model = re_.fit(x, y)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:200]], ", ".join(f"{c} double" for c in re_.NAMES))
    got = df.select(model.column().alias("s"), model.fired().alias("n"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert [r.s for r in rows] == pytest.approx(model.scores(x[:200]).tolist())
    assert [r.n for r in rows] == sum(r.holds(x[:200]).astype(int) for r in model.rules).tolist()


def test_one_class_and_no_rows_give_constants():
    none = np.zeros((0, len(FEATURES)))
    assert re_.fit(none, np.zeros(0)).scores(np.zeros((2, len(FEATURES)))).tolist() == [0.5, 0.5]
    assert re_.fit(np.zeros((5, len(FEATURES))), np.ones(5)).scores(np.zeros((1, len(FEATURES)))).tolist() == pytest.approx([0.999])


def test_held_out_documents_are_judged_right(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in re_.rule_ensemble(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in rows.items())
    out = [(r.quality, rows[r.doc_id].predicted) for r in labels.where("quality is not null").collect() if rows[r.doc_id].held_out]
    bad = [p for q, p in out if q == 0]
    good = [p for q, p in out if q == 1]
    assert bad.count(0) >= 0.8 * len(bad) and good.count(1) >= 0.97 * len(good)
    # labels of the fold aren't read
    other = labels.withColumn("quality", re_.F.when(re_.held_out(), 1 - re_.F.col("quality")).otherwise(re_.F.col("quality")))
    assert re_.train(docs, other) == re_.train(docs, labels)


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    schema = "doc_id long, text string, quality int, score double, words double, held_out boolean, predicted int"
    good, bad = "Some plain words of a text. " * 20, "### *** $$$ x| " * 30
    rows = [(i, good if i % 3 else bad, 0, 0.5, 1.0, True, 3) for i in range(90)] + [(None, None, 0, 0.5, 1.0, True, 3), (1, bad, 0, 0.5, 1.0, True, 3), (200, "", 0, 0.5, 1.0, True, 3), (201, "y" * 300000, 0, 0.5, 1.0, True, 3)]
    docs = spark.createDataFrame(rows, schema).repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(90)] + [(None, 1, None), (5, None, None), (4, 1, None)], "doc_id long, quality int, text string")
    out = re_.rule_ensemble(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted", "n_rules"] and out.count() == len(rows)
    got = [r for r in out.collect() if r.doc_id is None]
    assert len(got) == 1 and got[0].held_out is False and 0 <= got[0].score <= 1
    by = {(r.doc_id, r.predicted) for r in out.collect()}
    assert {(2, 1), (3, 0), (1, 1), (1, 0)} <= by
    assert re_.rule_ensemble(docs.limit(0), labels).count() == 0
    assert {r.score for r in re_.rule_ensemble(docs, labels.limit(0)).collect()} == {0.5}
