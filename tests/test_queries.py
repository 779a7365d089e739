"""Registered queries against their SQL on the smallest tables, and plan checks."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from brindle.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(([fix(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), want.columns)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


NATIVE = [n for n in sorted(registry.QUERIES) if not n.startswith("stream_") and n not in ("payload_bounds", "url_safety", "page_signals", "text_forms")]


@pytest.mark.parametrize("name", NATIVE)
def test_plans_have_no_python_and_no_cartesian_product(spark, name):
    plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "EvalPython" not in plan and "MapInArrow" not in plan


def test_scans_are_pruned(spark):
    plan = registry.QUERIES["policy_diff"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderstatus" not in plan
