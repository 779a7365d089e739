"""Queries against their SQL on rows that the smallest tables lack."""

import datetime

import duckdb

from brindle.operators import catalog as operators
from brindle.plans import catalog, registry, telemetry  # noqa: F401


def both(spark, path, name, **tables):
    """Rows of a query and of its SQL over made tables (rows, schema)."""
    c = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{t}.parquet")
        c.sql(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, str(path))
    want = c.sql(f"select {', '.join(df.columns)} from ({registry.ORACLE_SQL[name]})").fetchall()
    return sorted(map(tuple, df.collect())), sorted(want)


def test_titles_with_quotes_and_cut_references(spark, tmp_path):
    titles = ["a &quot;b&quot; c", "cut &amp", "cut &am", "cut &quot", "cut &quo", "&amp;quot; &amp;lt;", "it&#x27;s", "&lt;x&gt; &lt", "&"]
    rows = [(i, "u", f"<html><title>{t}</title> price</html>") for i, t in enumerate(titles * 12)]
    got, want = both(spark, tmp_path, "page_signals", pages=(rows, "page_id long, url string, html string"))
    assert got == want and len(got) == len(rows)


def test_tokens_are_whole_numbers_in_the_sql_too(spark, tmp_path):
    day = lambda y: datetime.datetime(y, 5, 1)
    rows = [(1, 1, "F", 257060.79, day(1996), "p"), (2, 1, "F", 256074.0, day(1997), "p"), (3, 1, "F", 0.45, day(1997), "p"), (4, 2, "F", 249000.0, day(1998), "p"), (5, 2, "F", 237.29, day(1998), "p"), (6, 2, "F", 274198.1, day(1999), "p")]
    got, want = both(spark, tmp_path, "token_efficiency", orders=(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"))
    assert got == want and len(got) == 2


def test_entity_match_holds_all_pairs_of_records(spark):
    path = "/root/testdata/sf0.001"
    rows = catalog.entity_match(spark, path).collect()
    of = {kind: [r for r in rows if r.kind == kind] for kind in ("strong", "soft", "target", "candidate")}

    def pairs(r, by):
        return [(t.id, c.id) for t in of["target"] for c in of["candidate"] if (t.t_rep if by == "rep" else t.group) == r.t_rep and (c.c_rep if by == "rep" else c.group) == r.c_rep]

    got = {p: (r.matched, r.conflicts, r.accepted, r.reason) for r in of["strong"] for p in pairs(r, "rep")}
    for r in of["soft"]:
        rest = [p for p in pairs(r, "group") if p not in got]
        assert len(rest) == r.n_pairs
        got |= {p: (r.matched, r.conflicts, r.accepted, r.reason) for p in rest}
    want = operators.match_entities(*catalog.entity_sides(spark, path)).collect()
    assert got == {(r.t_id, r.c_id): (",".join(r.matched), ",".join(r.conflicts), r.accepted, r.reason) for r in want}
