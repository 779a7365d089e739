"""Stateful streams: bounded state and restarts; merged shard maps against known numbers; URLs and tables that are dirty."""

import datetime

import pytest
from brindle.functions import text
from brindle.functions import urls as U
from brindle.operators import audit, contracts, inventory, ledger, payload, shards
from brindle.plans import claims
from brindle.sources import files
from brindle.streaming import stateful, streams
from pyspark.sql import functions as F

T0 = datetime.datetime(2024, 5, 1)
SCHEMA = "user string, event_id long, at timestamp, raw_state string"


def minutes(n):
    return T0 + datetime.timedelta(minutes=n)


def write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return streams.source(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)


def test_idle_runs_leave_the_state_and_survive_a_restart(spark, tmp_path):
    path, out = f"{tmp_path}/events", f"{tmp_path}/stream"
    rows = [(f"u{u}", 1000 * u + i, minutes(600 * u + 10 * i), s) for u in range(8) for i, s in enumerate(["queued", "running", "complete"])]
    for u in range(4):
        write(spark, [r for r in rows if r[0] == f"u{u}"], path)
    progress = []
    with stateful.rocksdb(spark):
        run = lambda: streams.to_table(stateful.idle_runs(stream(spark, path), "user", "0 seconds", 60 * 60_000_000), out, "append", progress=progress)
        first = {r.key: (r.state, r.n_events) for r in run().collect()}
        for u in range(4, 8):
            write(spark, [r for r in rows if r[0] == f"u{u}"], path)
        write(spark, [("u4", 1, minutes(9000), "failed"), ("end", 2, minutes(99999), "failed")], path)
        runs = [(r.key, r.began_at, r.ended_at, r.state, r.n_events) for r in run().collect()]
    assert first == {f"u{u}": ("COMPLETE", 3) for u in range(3)}  # u3 may still go on
    want = [(f"u{u}", minutes(600 * u), minutes(600 * u + 20), "COMPLETE", 3) for u in range(8)] + [("u4", minutes(9000), minutes(9000), "FAILED", 1)]
    assert sorted(runs) == sorted(want)
    assert max(op.numRowsTotal for p in progress for op in p.stateOperators) <= 4  # not the eight users that ever were


def test_visits_pass_again_after_the_delay_or_by_force(spark, tmp_path):
    path = f"{tmp_path}/visits"
    rows = [("a", 1, 0, None), ("a", 2, 30, None), ("a", 3, 59, "contradiction_check"), ("a", 4, 61, "whatever"), ("a", 5, 118, None), ("a", 6, 119, None), ("b", 7, 119, None), ("b", 8, 119, None)]
    schema = "key string, visit_id long, visited_at timestamp, force_reason string"
    for part in (rows[:2], rows[2:5], rows[5:]):
        spark.createDataFrame([(k, i, minutes(m), f) for k, i, m, f in part], schema).coalesce(1).write.mode("append").parquet(path)
    with stateful.rocksdb(spark):
        got = streams.to_table(stateful.gated_visits(stream(spark, path), ["key"], "1 minute", 60 * 60_000_000), f"{tmp_path}/out", "append")
    old = "already_visited_for_task"
    assert sorted(tuple(r) for r in got.collect()) == [(1, True, "new_source"), (2, False, old), (3, True, "contradiction_check"), (4, False, old), (5, False, old), (6, True, "new_source"), (7, True, "new_source"), (8, False, old)]


def shard(spark):
    rows = [("run-1", 0, 2, 3, {"ok": 5, "blocked": 1, "error": 0, "empty": 0}, {"200": 5, "403": 1}, {"attempts-1": 6}, 6, 30, 50),
            ("run-1", 1, 1, 2, {"ok": 4, "blocked": 0, "error": 1}, {"200": 4}, {"attempts-1": 5, "x": None}, 5, 40, 90),
            ("run-2", 0, 1, 1, {"ok": 3}, None, {}, 0, None, None), ("run-3", 0, 1, 1, None, None, None, 0, None, None)]
    maps = "status_counts map<string,int>, http_status_counts map<string,int>, diagnostic_counts map<string,int>"
    return spark.createDataFrame(rows, f"run string, shard int, selected_targets int, cycles int, {maps}, measured int, median_ms int, p95_ms int")


def test_scorecards_of_runs(spark):
    targets = spark.createDataFrame([("run-1", "blocked"), ("run-1", "healthy"), ("run-1", "healthy"), ("run-2", "healthy")], "run string, health string")
    contracts = spark.createDataFrame([("run-1", 14, 14, 0), ("run-2", 14, 14, 0)], "run string, queries int, passed int, failed int")
    got = {r.run: r for r in shards.run_scorecards(shard(spark), targets, contracts, ["run"]).collect()}
    a, b, c = got["run-1"], got["run-2"], got["run-3"]
    assert (a.shards, a.selected_targets, a.cycles, a.observations) == ([0, 1], 3, 5, 11)
    assert (a.usable_rate, a.operational_rate, a.error_rate, a.pass_rate) == (0.818182, 0.090909, 0.090909, 1.0)
    assert a.status_counts == {"ok": 9, "blocked": 1, "error": 1, "empty": 0} and a.http_status_counts == {"200": 9, "403": 1} and a.diagnostic_counts == {"attempts-1": 11, "x": 0}
    assert a.health_class_counts == {"blocked": 1, "healthy": 2} and a.p95_ms == 90 and a.median_ms == pytest.approx(34.545)
    assert (a.execution, a.contract, a.clean, a.overall) == ("PASS", "PASS", "FAIL", "WARN")
    assert (b.execution, b.contract, b.clean, b.overall, b.median_ms) == ("PASS", "PASS", "PASS", "PASS", None)
    assert (c.execution, c.contract, c.overall, c.usable_rate) == ("FAIL", "FAIL", "WARN", None)


def test_small_sketches_are_exact_and_merge(spark):
    rows = spark.createDataFrame([("a", i % 3, i) for i in range(301)] + [("b", 0, None)], "k string, shard int, v long")
    merged = shards.merged_sketches(shards.sketches(rows, ["k", "shard"], "v"), ["k"])
    got = shards.sketch_quantiles(merged, ["k"], {"low": 0.0, "mid": 0.5, "top": 1.0}).collect()
    assert [(r.k, r.n, r.low, r.top) for r in got] == [("a", 301, 0, 300)] and abs(got[0].mid - 150) <= 2


@pytest.mark.parametrize("url, canonical", [
    ("http://a:99999999999/x", None), ("http://a:65536/", None), ("http://a:65535/", "http://a:65535/"), ("http://a:00080/x", "http://a/x"), ("http://a:0/x", "http://a/x"), ("http://a:x/", None),
    ("http://:80/", None), ("http:///x", None), ("https://[::1]:443/", "https://::1/"), ("http://[::1/", None), ("http://u:p@h:81/", "http://h:81/"), ("http://a:-1/", None), ("", None), (None, None), ("http://a:٣/", None),
])
def test_canonical_urls_take_any_text(spark, url, canonical):
    row = spark.createDataFrame([(url,)], "u string").select(U.canonical_url(F.col("u")).alias("c"), U.safe_url(F.col("u")).alias("s"), U.target_key(F.col("u")).alias("k")).first()
    assert row.c == canonical and (row.k is None) == (canonical is None)
    assert row.s.url is None or row.s.reason is None


def test_paired_changes_without_the_first_document(spark, monkeypatch):
    monkeypatch.setattr(claims, "files", lambda s, d: s.createDataFrame([(2, "s/fr/d2.py")], "doc_id long, path string"))
    rows = {r.group: r.problem for r in claims.paired_changes(spark, "").collect()}
    assert rows["none"] == "no_match" and len(rows) == 4


def test_small_helpers(spark):
    one = lambda v, f: spark.createDataFrame([(v,)], "v string").select(f(F.col("v")).alias("x")).first().x
    assert one("a  Token = abc\n-----BEGIN PRIVATE KEY-----x\n-----END PRIVATE KEY----- b", text.redact) == "a Token = [REDACTED] [REDACTED] b"
    assert len(one("x" * 5000, text.redact)) == 1200
    states = ['{"ui_state":"Running"}', '{"state":null,"status":"success"}', '{"run":{"status":"failed"}}', '{"run":{"state":"odd"}}', "[1]", "no", None]
    assert [one(v, ledger.backend_state) for v in states] == ["RUNNING", "COMPLETE", "FAILED", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    assert [one(v, payload.media_problem) for v in ("application/json", " APPLICATION/json ; q=1", "text/json", None)] == ["", "", "unsupported media type", "unsupported media type"]
    rows = spark.createDataFrame([("t", "u", 1, "a"), ("t", "u", 3, "b"), ("t", "v", 2, "c")], "task_id string, url string, seq int, x string")
    assert sorted(r.x for r in ledger.latest_ledger_rows(rows).collect()) == ["b", "c"]
    found = spark.createDataFrame([("b", 1, "k"), ("a", 2, "k"), ("a", 2, "j")], "document string, line int, kind string")
    assert [tuple(r) for r in inventory.ordered_findings(found).collect()] == [("a", 2, "j"), ("a", 2, "k"), ("b", 1, "k")]
    nested = spark.sql("select array(named_struct('a', 1, 'b', 'x', 'c', 2.0), named_struct('a', null, 'b', 'y', 'c', 3.0)) as l")
    assert [tuple(r) for r in files.project_items(nested, "l", ["b", "a"]).collect()] == [("x", 1), ("y", None)]
    contract = [("task_id", "required", None), ("lost", "required", None), ("seq", "min", 1)]
    assert contracts.contract_columns(rows, contract) == {"missing": ["lost"], "extra": ["url", "x"]}


def test_prefixes_of_any_number_join_by_their_lengths(spark):
    table = spark.createDataFrame([("a/", "one"), ("a/b", "two"), ("a/b", "three"), ("", "all"), (None, "x")], "prefix string, surface string")
    paths = spark.createDataFrame([("a/bc",), ("a/x",), ("z",), (None,)], "p string")
    got = {r.p: (r.prefix, r.surface, r.ambiguous) for r in audit.longest_prefix(paths, "p", table).collect()}
    assert got == {"a/bc": ("a/b", "three", True), "a/x": ("a/", "one", False), "z": ("", "all", False)}
