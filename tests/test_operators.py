"""Golden rows of the operators that the queries show only in part."""

import json

import pytest
from brindle.functions import text as X
from brindle.functions import urls as U
from brindle.operators import audit, catalog, evaluation, ledger, payload, telemetry
from brindle.sources import files
from brindle.streaming import streams
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("value, label", [("status: 2", "In Stock"), ("sold out", "Out of Stock"), ("x" * 100, "x" * 80), (None, "Unknown"), ("", "Unknown"), ("unavailable", "In Stock"), ("partially out of stock", "Out of Stock"), ("Stock = 0", "Out of Stock"), ("pre-book", "Pre-Book")])
def test_stock(spark, value, label):
    assert column(spark, [value], X.normalize_stock) == [label]


def test_gtin(spark):
    values = ["ean13: 4006381333931", "4006381333931", "12345678901234", "11111111", "4006381333930", "no", None, "UPC # 036000291452"]
    assert column(spark, values, X.normalize_gtin) == ["04006381333931", "04006381333931", "", "", "", "", "", "00036000291452"]


def test_text_beyond_ascii(spark):
    assert column(spark, ["A&amp;B – C  d ", "ﬁ", None], X.clean_text) == ["A&B - C d", "fi", ""]
    assert column(spark, ["STRASSE ẞ", "Asus  "], X.normalize_brand) == ["strasse ss", "asus"]
    assert column(spark, ["Gaming Laptop", "in-ear monitor", "Replacement Tips", "curved gaming-monitor 27", ""], X.normalize_category) == ["laptop", "iem", "other", "monitor", ""]
    assert column(spark, [" N/A ", "ab c", "MODEL_1"], X.normalize_mpn) == ["", "ABC", "MODEL-1"]


@pytest.mark.parametrize("host, ok", [("example.com", True), ("10.1.2.3", False), ("8.8.8.8", True), ("localhost", False), ("a.local", False), ("0x7f.1", False), ("192.168.0.1", False), ("2001:4860:4860::8888", True), ("::1", False), ("64:ff9b::7f00:1", False), ("168.63.129.16", False), ("203.0.113.9", False)])
def test_hosts(spark, host, ok):
    assert column(spark, [host], lambda v: U.safe_host(v, v6=True)) == [ok]


def test_canonical_url(spark):
    values = ["HTTPS://Ex.COM:443/a?b#c", "http://x", "ftp://x/", "http://x:8080/?", None, "/rel"]
    assert column(spark, values, U.canonical_url) == ["https://ex.com/a?b", "http://x/", None, "http://x:8080/", None, None]
    assert column(spark, ["HTTP://A.com/x//#f", "rel/"], U.url_key) == ["http://a.com/x", "rel"]


def test_first_and_last_seen(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], "k string, n int")
    assert {(r.k, r.n) for r in catalog.first_seen(rows, ["k"], ["n"]).collect()} == {("a", 1), ("b", 5)}
    assert {(r.k, r.n) for r in catalog.first_seen(rows, ["k"], ["n"], last=True).collect()} == {("a", 2), ("b", 5)}


def test_map_product_of_offers_and_images(spark):
    raw = spark.createDataFrame([(1, "T", [("s", "12.5", "EUR", "sold out")], ["", "u1", "u2"])], "id int, title string, offers array<struct<seller_id:string,price:string,currency:string,availability:string>>, images array<string>")
    r = catalog.map_product(raw, ["id"]).first()
    assert (r.title, r.price, r.stock, r.images, r.offers[0].availability) == ("T", "12.5", "Out of Stock", ["u1", "u2"], "Out of Stock")
    got = raw.select(catalog.image_provenance(F.col("images"), F.lit("images"), F.lit(None).cast("string")).alias("p")).first().p
    assert [x["index"] for x in got] == [0, 1, 2]
    pairs = spark.createDataFrame([([("a", "1"), ("b", None), ("a", "2")],)], "p array<struct<name:string,value:string>>")
    assert pairs.select(catalog.normalize_specs(F.col("p")).alias("m")).first().m == {"a": "2"}


def test_percentile_rule(spark):
    rows = spark.createDataFrame([("a", v) for v in (5, 1, 1, 9)] + [("b", None)], "k string, v int")
    assert telemetry.exact_percentiles(rows, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect() == [("a", 1, 5)]


def test_scorecard_of_two_shards(spark):
    shards = spark.createDataFrame([(8, 7, 1, 0, 0, 0, 100, 400), (3, 2, 0, 0, 1, 0, 200, 300)], "observations long, n_ok long, n_blocked long, n_resource_limited long, n_error long, n_empty long, median_ms long, p95_ms long")
    r = telemetry.scorecard(shards).first()
    assert (r.observations, r.usable_rate, r.blocked_rate, r.error_rate, r.p95_ms, r.overall) == (11, 0.818182, 0.090909, 0.090909, 400, "WARN")
    assert telemetry.scorecard(shards.limit(0)).first().usable_rate is None


def test_rules_quarantine_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (-1, ""), (None, "b")], "n int, s string")
    good, bad = evaluation.quarantine(rows, {"n": F.col("n") >= 0, "s": F.trim("s") != ""})
    assert good.count() == 1 and sorted(map(str, (r.errors for r in bad.collect()))) == ["['n', 's']", "['n']"]
    with pytest.raises(Exception):
        evaluation.quarantine(rows, {"n": F.col("n") >= 0}, strict=True)[0].collect()


def test_payload_bounds(spark):
    deep = "{" + '"a":{' * 33 + "}" * 33 + "}"
    wide = json.dumps({str(i): i for i in range(1025)})
    values = ['{"a":1}', "[1]", "{", None, deep, wide, json.dumps({"a": "x" * 140000}), json.dumps({"a": "x" * (1 << 20)})]
    assert column(spark, values, payload.payload_problem) == ["", "root is not an object", "invalid json", "missing", "too deep", "too many items", "string too long", "too large"]


def test_long_lifecycle_in_batch_equals_the_stream_rule(spark):
    raw = ["new", "queued", "running", "nonsense", "Streaming", "complete", "running"] * 40
    rows = spark.createDataFrame([("k", i, s) for i, s in enumerate(raw)] + [("m", 0, None)], "k string, i int, s string")
    state = None
    for s in raw:
        state = streams.next_state(state, s)
    got = {r.k: (r.state, r.n_events) for r in ledger.fold_lifecycle(rows, "k", ["i"], "s").collect()}
    assert got == {"k": (state, 280), "m": ("UNKNOWN", 1)}


def test_frames_of_odd_results(spark):
    rows = spark.createDataFrame([("a", "COMPLETE", None, 1, 2), (" ", "COMPLETE", "x", None, None), ("b", "BLOCKED", "x", None, None), ("c", "failed", "y" * 300, None, None)], "response_id string, result_state string, text string, input_tokens int, output_tokens int")
    got = ledger.frame_events(rows)
    assert {r.response_id: r.n for r in got.groupBy("response_id").agg(F.count("*").alias("n")).collect()} == {"a": 3, "c": 4}
    back = {r.response_id: r for r in ledger.reassemble(got.withColumn("text", F.when(F.col("seq") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))).collect()}
    assert not back["c"].intact and back["c"].status == "failed"


def test_files(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1, "s": "a"}\n\n[1]\nnot json\n{"id": 1}\n')
    schema = StructType().add("id", LongType()).add("s", StringType())
    good, bad = files.read_jsonl(spark, str(tmp_path / "x.jsonl"), schema)
    assert (good.count(), bad.count()) == (2, 2) and files.duplicate_keys(good, "id").first()["count"] == 2
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "doc.json").write_text('{"queries": [{"id": 1, "s": "q"}, {"s": "no id"}]}')
    assert files.read_documents(spark, str(tmp_path / "a" / "doc.json"), schema, "queries").count() == 1
    assert files.read_tree(spark, str(tmp_path), "doc.json", StructType().add("queries", ArrayType(StructType().add("id", LongType())))).count() == 1
    found = {r.path.rsplit("/", 1)[1]: r for r in files.inventory(spark, str(tmp_path)).collect()}
    assert found["doc.json"].extension == ".json" and found["doc.json"].bytes == 50
    (tmp_path / "keep.tsv").write_text("backup/a\t1\n\nbackup/b\t2\n")
    assert files.read_keep_keys(spark, str(tmp_path / "keep.tsv"), "backup/").count() == 2
    with pytest.raises(Exception):
        files.read_keep_keys(spark, str(tmp_path / "keep.tsv"), "other/").collect()
    files.append_receipts(good.withColumns({"run_id": F.lit("r"), "shard": F.lit(0)}), str(tmp_path / "out"))
    files.write_report(good, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2 and spark.read.json(str(tmp_path / "report")).columns == ["id", "s"]


def test_similar_classes_and_links_hold_every_pair(spark):
    words = [(1, "a b", "x"), (2, "b a", "x"), (3, "a c", "x"), (7, "a c", "y"), (8, "q", "z"), (9, "r", "w"), (11, "r", "w"), (13, None, None), (14, "a b", "y"), (15, "b a a", "x")]
    rows = spark.createDataFrame([(i, n and n.split(), t and t.split()) for i, n, t in words], "id long, names array<string>, types array<string>")
    sets = {i: (set((n or "").split()), set((t or "").split())) for i, n, t in words}
    score = lambda a, b: sum(len(x & y) / len(x | y) if x | y else 0.0 for x, y in zip(sets[a], sets[b], strict=True)) / 2
    want = {(a, b) for a in sets for b in sets if a < b and score(a, b) >= 0.2}
    links = {r.id: r for r in audit.similar_links(rows, ["names", "types"], 0.2).collect()}
    assert {i: r.n_links for i, r in links.items()} == {i: sum(i in p for p in want) for i in sets}
    pairs = audit.similar_classes(rows, ["names", "types"], 0.2).collect()
    found = {(r.left_id, r.right_id) for r in pairs}
    whole = {(a, b) for a in sets for b in sets if a < b and tuple(sorted((links[a].class_id, links[b].class_id))) in found}
    assert whole == want and len(found) == len(pairs)
    assert all(round(score(r.left_id, r.right_id), 6) == r.score for r in pairs)


def test_lines_that_differ_late_are_no_conflict(spark, tmp_path):
    from brindle.plans import corpus

    same = "keep the records of every single visit for a year"
    texts = [(1, f"{same}\n{same} and more"), (2, f"{same}\n{same} or less")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus.conflicting_whole_lines(spark, str(tmp_path)).collect()
    assert sorted((r.doc, r.line, r.subject) for r in found) == [(1, 1, same), (2, 1, same)]


def test_rules_of_a_public_surface_are_found(spark, tmp_path):
    from brindle.plans import corpus

    hits = ["ghp_" + "a1" * 12, "https://x.y.workers.dev/a", "Cloudflare account ID: " + "0a" * 16, "deployment ID: 0123abcd-" + "0a-" * 9 + "b" * 9, "'d1_counts': { count: 4", "GROQ_API_KEY"]
    spark.createDataFrame(list(enumerate([*hits, "nothing"])), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc: r.severity for r in corpus.public_disclosure(spark, str(tmp_path)).collect()}
    assert found == dict.fromkeys(range(6), "high")
    assert {r.verdict: r.n_docs for r in corpus.public_summary(spark, str(tmp_path)).collect()} == {"blocked": 6, "clean": 1}

def test_domains_and_their_fields(spark):
    from brindle.functions import domains as D

    def detect(text, category=""):
        return spark.range(1).select(D.detect_domains(F.lit(text), F.lit(category))).first()[0]

    def fields(text, names, device=None):
        return spark.range(1).select(D.domain_fields(F.lit(text), F.array(*[F.lit(n) for n in names]), device and F.lit(device))).first()[0]

    related = lambda *names: spark.range(1).select(D.related_domains(F.array(*[F.lit(n) for n in names]))).first()[0]
    assert detect("gaming keyboard and monitor", "keyboard") == ["keyboard", "display"] and detect("nothing relevant") == []
    assert related("computer") == ["display", "storage"] and related("computer", "display") == ["storage"] and related("unknown") == []
    keyboard = fields("tkl pbt hot-swap prebuilt 1.25 kg 3000 mah 3-pin knob gasket abs 1000 hz bluetooth hall effect", ["keyboard"])
    assert keyboard == {
        "layout": "75%", "keycap_profile": "PBT", "hotswap": "Yes", "assembly": "Prebuilt", "weight": "1250g", "battery": "3000 mAh", "pins": "3-pin", "knob_support": "Yes",
        "mount_style": "Gasket", "case_material": "Abs", "polling_rate": "1000 Hz", "connection_type": "Bluetooth", "keyboardproduct_type": "Hall Effect Keyboard",
    }
    mouse = fields("bamf 3.0 68 g 2000 mah 26k dpi bluetooth omron palm", ["mouse"])
    assert (mouse["tracking_method"], mouse["weight"], mouse["battery"], mouse["maximum_dpi"]) == ("PAW3950", "68g", "2000 mAh", "26000")
    assert (mouse["connection_type"], mouse["switch_type"], mouse["grip_type"]) == ("Wireless BT", "Omron Mechanical", "Palm")
    assert fields("27 inch monitor", ["display"]) == {} and fields("27 inch monitor 165 hz", ["display"]) == {"refresh_rate": "165 Hz"}
    assert fields("mousepad very fast textured very soft 4 mm", ["mousepad"]) == {"mousepad_speed": "Very fast", "mousepad_texture": "Textured", "mousepad_firmness": "Very soft", "thickness_mm": "4mm"}
    assert fields("ipi haze 6369g haze x1", ["mouse"])["weight"] == "69g" and fields("ipi haze 6369g standard", ["mouse"])["weight"] == "63g"
    both = fields("1 kg 1000 hz", ["keyboard", "mouse"], "TKL 1 kg 1000 Hz")
    assert (both["layout"], both["weight"], both["polling_rate"]) == ("75%", "1000g", "1000 Hz")
    assert fields("16000 DPI wired", ["mouse"])["maximum_dpi"] == "16000" and fields("paw3395 wired", ["mouse"])["tracking_method"] == "paw3395"
    assert fields("6369g generic mouse", ["mouse"])["weight"] == "6369g" and fields("mouse", ["mouse"]) == {} and fields(None, ["mouse"]) == {}


def test_numbered_lines_and_reports_in_order(spark, tmp_path):
    (tmp_path / "n.jsonl").write_text('{"id": 1}\n\n[2]\n{"id": 1}\n{"id": null}\n{"id": 3')
    schema = StructType().add("id", LongType())
    good, bad = files.read_numbered_jsonl(spark, str(tmp_path / "n.jsonl"), schema, "id")
    assert sorted((r.line, r.id) for r in good.collect()) == [(1, 1), (5, None)]
    assert sorted((r.line, r.error) for r in bad.collect()) == [(3, "bad_json"), (4, "repeated_key"), (6, "bad_json")]
    nested = spark.sql("select named_struct('z', 1, 'a', array(named_struct('y', 2, 'b', map('q', 1, 'c', 2)))) as w, 1 as b, cast(null as struct<k:int>) as n")
    files.write_report(nested, str(tmp_path / "r"))
    text = [r.value for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert text == ['{"b":1,"n":null,"w":{"a":[{"b":{"c":2,"q":1},"y":2}],"z":1}}']
