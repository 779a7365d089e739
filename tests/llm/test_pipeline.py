import collections
import random

import corpus_pipeline
import pytest
from brindle.llm import queries

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_clean_documents_and_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == names, name
    after = {r.doc_id: r.text for r in docs.collect()}
    assert set(after) <= set(before) and len(after) > 0.4 * len(before)
    assert all(len(t) <= len(before[i]) for i, t in after.items() if t is not None)
    assert len(set(after.values())) == len(after)


def test_run_packs_what_is_left(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 0 and "sequence_id" in out.columns


ODD = "doc_id long, text string, lang string, source string, n_chars long, g string, place int, spans int"


def test_stages_take_nulls_repeats_and_empty_tables(spark):
    r = random.Random(21)
    prose = lambda n: " ".join(f"w{r.randint(0, 4000)}" for _ in range(n))
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").where("length(text) > 100").first().text
    passage, copy = prose(70), prose(120)
    texts = [(None, None), (None, ""), (None, f"{prose(30)} {item}"), (1, copy), (1, copy), (2, copy + " more"), (3, f"{passage} {prose(20)}"), (3, prose(40)), (4, f"{prose(9)} {passage}"), (5, None), (6, f"so {item}"), (7, prose(60)), (None, f"{prose(5)} {passage}"), (8, "x" * 300000)]
    docs = spark.createDataFrame([(i, t, None if i == 7 else "en", "s", 0, "g", 1, 2) for i, t in texts], ODD).repartition(3)
    steps = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == [c.split()[0] for c in ODD.split(", ")], name
        steps[name] = sorted(((x.doc_id, x.text) for x in docs.collect()), key=repr)
    ids = {name: collections.Counter(i for i, _ in rows) for name, rows in steps.items()}
    assert ids["toxicity"] == collections.Counter(i for i, _ in texts)
    assert ids["ngram_jaccard"][1] == 1 and 2 not in ids["ngram_jaccard"] and ids["ngram_jaccard"][3] == 2 and ids["ngram_jaccard"][None] == 4
    cut = dict(x for x in steps["substring_dedup"] if x[0] in (4, 7, 8))
    assert len(cut[4].split()) == 9 and len(cut[7].split()) == 60 and len(cut[8]) == 300000
    assert sum(passage in (t or "") for _, t in steps["substring_dedup"]) == 1
    assert ids["decontamination"] == ids["substring_dedup"] - collections.Counter([None, 6])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert pieces.select("doc_id").distinct().count() == len(ids["decontamination"])
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SMALL).count() == 0


@pytest.mark.parametrize("n", range(1, 14))
def test_each_operator_has_one_query(n):
    assert len([q for q in queries.QUERIES if q.startswith(f"op{n}_")]) == 1
