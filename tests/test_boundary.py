"""Scans of a public surface, numbered lines, artifacts, and JSON documents, on small made rows."""

import hashlib
import json

import pytest

from brindle.operators import audit, public_scan
from brindle.sources import artifacts, files

RULES = public_scan.private_rules("inner.core", "vault/inner", "acme/vault")


def scan(spark, rows, **more):
    df = spark.createDataFrame(rows, "path string, text string, rule string").drop("rule").selectExpr("*", "1 as rule", "'x' as message")
    return sorted((r.path, r.rule) for r in public_scan.private_findings(df, "path", "text", RULES, **more).collect())


def test_private_references_count_where_they_do_harm(spark):
    sha = "0123456789" * 4
    rows = [
        ("src/a.py", "from inner.core.x import y"), ("src/b.py", "from innerXcore.x import y"), ("src/c.py", "refrom inner.core.x"), ("src/d.py", "../vault/inner/run"), ("src/e.py", "myvault/inner/run"),
        ("src\\f.py", f"acme/vault@{sha}"), ("src/g.py", "acme/vault@0123"), ("docs/h.md", "import inner.core.x"), ("x/tests/i.py", f"acme/vault@{sha}"), ("j_test.py", "import inner.core.x"),
        (".github/workflows/k.yml", "run: node x/vault/inner/a.js"), (".github/workflows/l.yml", "run: node \n x/vault/inner/a.js"), ("m.sh", "python vault/inner/a"), ("n.sh", "import inner.core.x"),
        ("own.py", "MARK api_key = '" + "a" * 24 + "' import inner.core.x"), ("o.py", "MARK api_key = '" + "a" * 24 + "'"), (None, "import inner.core.x"), ("p.py", None), ("q.py", ""), ("src/a.py", "import inner.core.z"),
    ]
    got = scan(spark, [(*r, None) for r in rows], markers=["MARK"], approved=["n.sh"], own=["own.py"])
    ref = "private-reference"
    assert got == sorted([("", ref), ("src/a.py", ref), ("src/d.py", ref), ("src/f.py", "private-revision"), (".github/workflows/k.yml", "workflow-private-execution"), ("m.sh", ref), ("o.py", "private-marker"), ("o.py", "credential-literal")])
    assert scan(spark, []) == []


def test_surface_findings_and_their_fingerprints(spark):
    names = [(f"p{i}/Same.py", "") for i in range(12)] + [("two/pair.py", ""), ("one/pair.py", "")]
    flows = [(f".github/workflows/{n}.yml", t) for n, t in [("a_b-v1-v2", "uses: x/y@v1\r\n  - uses: z@" + "a" * 40 + "\nuses: q@main # c"), ("a-b3", "uses: none"), ("c", None)]]
    called = [("src/x.ts", "openrouter.ai and api.groq.com"), ("src/provider_runtime/x.ts", "openrouter.ai"), ("src/x.md", "openrouter.ai"), ("k.json", "ghp_" + "a" * 20), ("k.txt", "ghp_" + "a" * 20), (None, "openrouter.ai")]
    rows = spark.createDataFrame(names + flows + called + called[:1], "path string, text string").selectExpr("*", "'s' as severity", "1 as kind")
    got = public_scan.surface_findings(rows, "path", "text", ["k.txt", 'no"ne'])
    found = {(r.kind, r.path, tuple(r.evidence)): r for r in got.collect()}
    flow = ".github/workflows/"
    assert set(found) == {
        ("missing_required_file", 'no"ne', ()), ("unpinned_action", flow + "a_b-v1-v2.yml", (flow + "a_b-v1-v2.yml:1",)), ("unpinned_action", flow + "a_b-v1-v2.yml", (flow + "a_b-v1-v2.yml:3",)),
        ("direct_provider_endpoint", "src/x.ts", ("openrouter.ai",)), ("direct_provider_endpoint", "src/x.ts", ("api.groq.com",)), ("secret_like_literal", "k.json", ("k.json",)),
        ("duplicate_filename_cluster", "p0/Same.py", tuple(sorted(f"p{i}/Same.py" for i in range(12))[:8])), ("workflow_overlap_cluster", flow + "a-b3.yml", (flow + "a-b3.yml", flow + "a_b-v1-v2.yml")),
    }
    for r in found.values():
        row = json.dumps({"severity": r.severity, "kind": r.kind, "path": r.path, "message": r.message}, separators=(",", ":"), ensure_ascii=False)
        assert r.fingerprint == hashlib.sha256(row.encode()).hexdigest()[:16]
    assert public_scan.surface_findings(rows.limit(0), "path", "text").count() == 0


@pytest.mark.parametrize("size", [64, 100_000])
def test_lines_are_numbered_across_splits(spark, tmp_path, size):
    texts = {"a.txt": "".join(f"line {i}\n" * (1 + i % 2) for i in range(60)), "b.txt": "x\r\n\r\ny\rz", "c.txt": "", "d.txt": "\n\n" + "long " * 50 + "\nend\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        got = files.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = {(n, i + 1, line) for n, t in texts.items() for i, line in enumerate(t.splitlines())}
    assert {(r.file.rsplit("/", 1)[1], r.line, r.value) for r in got} == want and len(got) == len(want)


def record(**changes):
    base = {"schema": "v1", "program_id": "p1", "lane": 1, "slot": 2, "status": "completed", "research_type": "search", "topic": " t ", "measurement": {"useful_findings": 1}, "findings": [{"claim": "c"}]}
    return json.dumps(base | changes)


def test_artifact_records_and_errors(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.jsonl").write_text("\n".join([record(), "", "not json", record(lane=0), record(schema="v2"), record(program_id="p2", findings=[]), record(program_id=" p1 ", slot=9)]))
    (tmp_path / "a" / "2.jsonl").write_text("\n".join([record(), record(program_id="p3", topic="")]))
    good, bad = artifacts.artifact_records(spark, str(tmp_path / "a"), "v1", lane=1)
    name = lambda f: f.rsplit("/", 1)[1]
    assert sorted((name(r.file), r.line, r.program_id, r.topic, r.finding_count) for r in good.collect()) == [("1.jsonl", 1, "p1", "t", 1), ("1.jsonl", 6, "p2", "t", 0), ("2.jsonl", 1, "p1", "t", 1)]
    errors = {(name(r.file), r.line, r.error) for r in bad.collect()}
    assert {("1.jsonl", 3, "not_an_object"), ("1.jsonl", 4, "bad_lane"), ("1.jsonl", 5, "other_schema"), ("1.jsonl", 7, "bad_slot"), ("2.jsonl", 2, "blank:topic")} <= errors
    assert {e[:2] for e in errors} == {("1.jsonl", 3), ("1.jsonl", 4), ("1.jsonl", 5), ("1.jsonl", 7), ("2.jsonl", 2)}
    good, bad = artifacts.artifact_records(spark, str(tmp_path / "a"), "v1", whole=True)
    assert good.count() == 2 and {(name(r.file), r.line) for r in bad.where("error = 'repeated_program'").collect()} == {("1.jsonl", 4), ("2.jsonl", 1)}


def test_targets_in_all_their_forms(spark):
    docs = [
        (1, '["HTTP://A.example", {"url": "http://a.example/", "name": "late"}, {"site": "http://b.example/x", "label": "B"}, 7, null, ["http://c.example"]]'),
        (2, '{"targets": [{"url": 5, "site": "http://c.example"}, {"url": "", "site": "http://d.example", "name": 0, "label": 12}], "sites": ["http://e.example"]}'),
        (3, '{"sites": ["http://e.example:99999999999/", {"name": "none"}, {"url": "http://f.example", "name": null}]}'),
        (4, '{"targets": null, "sites": ["http://g.example"]}'), (5, '{"other": []}'), (6, "broken ["), (7, None), (8, ""), (9, "[]"),
    ]
    rows = spark.createDataFrame([(*d, "x") for d in docs], "id int, doc string, url string")
    got = {r.url: (r.label, r.n_named, r.target) for r in artifacts.target_rows(rows, "id", "doc").collect()}
    key = lambda u: hashlib.sha256(u.encode()).hexdigest()
    want = {"http://a.example/": ("", 2), "http://b.example/x": ("B", 1), "http://d.example/": ("12", 1), "http://f.example/": ("", 1)}
    assert {u: v[:2] for u, v in got.items()} == want and all(v[2] == key(u) for u, v in got.items())
    assert artifacts.target_rows(rows.limit(0), "id", "doc").count() == 0


def test_corpora_keep_rows_with_id_and_query(spark):
    docs = [(1, '[{"id": 1, "query": "a"}, {"id": 0, "query": "b"}, {"id": "x"}, 5, {"id": "y", "query": ["q"]}]'), (2, '{"queries": [{"id": true, "query": "c", "more": {"z": 1}}]}'), (3, '{"queries": {}}'), (4, "x"), (5, None)]
    rows = spark.createDataFrame(docs, "key int, doc string")
    got = sorted((r.key, r.place, r.id, r.query) for r in artifacts.corpus_rows(rows, "key", "doc").collect())
    assert got == [(1, 0, "1", "a"), (1, 4, "y", '["q"]'), (2, 0, "true", "c")]


def test_probes_against_a_registry(spark):
    materials = spark.createDataFrame([("a", ["x"]), ("b", []), ("c", None), ("b", None)], "material string, items array<string>")
    probes = spark.createDataFrame([(1, ["a"], ["one#1"]), (2, ["a", "b", "z", "z"], ["one#", "two#1", "#1", "one#1#2", "one"]), (3, [], None), (4, ["c", None], [None, "one#12"])], "probe int, materials array<string>, targets array<string>")
    got = sorted((r.probe, r.item or "", r.problem) for r in audit.probe_findings(probes, materials, ["one"]).collect())
    assert got == sorted([(2, "b", "empty_material"), (2, "z", "unknown_material"), (2, "one#", "bad_target"), (2, "two#1", "bad_target"), (2, "#1", "bad_target"), (2, "one#1#2", "bad_target"), (2, "one", "bad_target"),
        (3, "", "no_materials"), (3, "", "no_targets"), (4, "c", "empty_material"), (4, "", "unknown_material"), (4, "", "bad_target")])
