"""Every operator on small tables: brute force, nulls, empty tables, repeated rows, clashing column names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from brindle.llm import components, decontamination, lm_scoring, ngram_jaccard, packing, quality_rules, substring_dedup, token_counts, tool_calls, toxicity, warc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, g string, id long, s double, h1 long, part long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randint(0, vocabulary)}{'abc'[r.randint(0, 2)]}" for _ in range(n))


def documents(seed=1, n=60):
    """Texts with nulls, empties, exact and near copies, a very long one, and a passage that some share."""
    r = random.Random(seed)
    texts = [None, "", "  \n", "one", "one two", "ONE two", "a\x0bb c d"]
    texts += [prose(r, r.randint(5, 120)) for _ in range(n)]
    base = prose(r, 200)
    texts += [base, base, base.upper()]
    words = base.split()
    for i in range(12):
        w = list(words)
        for _ in range(i % 4 + 1):
            w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    shared = prose(r, 70)
    texts += [f"{prose(r, 40)} {shared} {prose(r, 30)}" for _ in range(3)] + [prose(r, 6000), "the " * 300, "x" * 20000]
    return list(enumerate(texts, 1))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), 7, "g", 9, 0.5, 1, 2) for i, t in documents()]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, key):
    return {r[key]: r for r in df.collect()}


def backoff_by_hand(texts, least):
    """(n_words, log score, words that fell back) by id of (id, text) rows; each row is scored by the counts of the others."""
    texts = [(i, WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))) for i, t in texts]
    grams = lambda w: collections.Counter(g for n in (1, 2, 3) for g in zip(*[w[i:] for i in range(n)]))
    every = sum((grams(w) for _, w in texts), collections.Counter())
    total = sum(len(w) for _, w in texts)
    out = collections.defaultdict(lambda: [0, 0.0, 0])
    for d, w in texts:
        own = grams(w)
        c = lambda g: every[g] - own[g]  # noqa: B023, E731
        out[d][0] += len(w)
        for i in range(len(w)):
            deep = min(3, i + 1)
            for n in range(deep, 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1 or c(g) >= least:
                    out[d][1] += math.log(0.4) * (deep - n) + math.log(max(c(g), 1) / (max(total - len(w), 1) if n == 1 else c(g[:-1])))
                    out[d][2] += n < deep
                    break
    return out


def same_scores(got, want):
    assert set(got) == set(want)
    for d, (n, score, backed) in want.items():
        assert got[d].n_words == n and got[d].log_score == pytest.approx(score, rel=1e-9, abs=1e-9) and got[d].n_backed == backed
        assert (got[d].mean_log_score is None) == (not n)


@pytest.mark.parametrize("least,top", [(1, 250_000), (2, 20)])
def test_lm_scores(docs, none, least, top):
    got = rows(lm_scoring.stupid_backoff(docs, passes=2, least_count=least, top_words=top), "doc_id")
    want = backoff_by_hand(documents(), least)
    same_scores(got, want)
    share = sum(w[2] for w in want.values()) / sum(w[0] for w in want.values())
    assert 0.1 < share < 1  # back-off happens
    assert lm_scoring.stupid_backoff(none, passes=2, least_count=least).count() == 0


@pytest.mark.parametrize("least", [1, 3])
def test_lm_scores_with_hot_n_grams_null_and_repeated_ids(spark, least):
    r = random.Random(3)
    made = [(i % 40, "of the " * r.randint(0, 40) + prose(r, r.randint(0, 25), 30) + " of the end" * (i % 3)) for i in range(120)] + [(None, "of the one"), (None, "a lone"), (-(1 << 63), "of the"), (77, "of the")]
    got = rows(lm_scoring.stupid_backoff(spark.createDataFrame(made, "doc_id long, text string").repartition(6), passes=2, least_count=least), "doc_id")
    assert None in got
    same_scores(got, backoff_by_hand(made, least))


def test_lm_scores_of_a_text_alone(spark):
    made = [(1, "b b b a b b b")]  # no other text: counts of 0
    same_scores(rows(lm_scoring.stupid_backoff(spark.createDataFrame(made, "doc_id long, text string"), passes=1), "doc_id"), backoff_by_hand(made, 1))


def test_lm_scores_read_each_text_once(spark, docs):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    once = docs.select("doc_id", "text").mapInArrow(seen, "doc_id long, text string")
    same_scores(rows(lm_scoring.stupid_backoff(once, passes=2), "doc_id"), backoff_by_hand(documents(), 1))
    assert read.value == len(documents())


@pytest.mark.parametrize("size", [1, 3000])
def test_lm_scores_of_many_chunks(docs, size):
    same_scores(rows(lm_scoring.stupid_backoff(docs, passes=2, chunk_bytes=size), "doc_id"), backoff_by_hand(documents(), 1))


def test_lm_n_grams_are_sent_once_a_chunk(spark):
    made = [(i, "of the " * 300 + f"w{i}") for i in range(8)]
    chunks = lm_scoring.chunked(spark.createDataFrame(made, "doc_id long, text string").repartition(2), 1 << 20).cache()
    assert chunks.count() == 2
    sent = [np.frombuffer(r.grams, np.uint64) for turn in range(2) for r in lm_scoring.chunk_grams(chunks, turn, 4, 8).collect()]
    # two words, two bigrams and two trigrams of all texts; a word, a bigram and a trigram of each
    assert sum(map(len, sent)) == 2 * 6 + 8 * 3 and all((x[1:] > x[:-1]).all() for x in sent)


def test_token_counts(docs, none):
    got = rows(token_counts.count_tokens(docs.union(docs), BPE, limit=50), "doc_id")
    lib = Tokenizer.from_file(BPE)
    for i, t in documents():
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 50)
    assert token_counts.count_tokens(docs.union(docs), BPE).count() == 2 * docs.count()
    assert token_counts.count_tokens(none, BPE).count() == 0


def linked(texts):
    sets = {}
    for i, t in texts:
        w = WORDS.findall((t or "").lower())
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_jaccard_join(spark, docs, none):
    got = rows(ngram_jaccard.ngram_jaccard_join(docs), "doc_id")
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == linked(documents())
    assert ngram_jaccard.ngram_jaccard_join(none).count() == 0
    extra = docs.union(spark.createDataFrame([(None, "one two", "", "", 1, 1, "", 1, 0.0, 1, 1)], DOCS)).union(docs.limit(0))
    lost = [r for r in ngram_jaccard.ngram_jaccard_join(extra).collect() if r.doc_id is None]
    assert [(r.n_shingles, r.component_id) for r in lost] == [(1, None)]


def test_jaccard_join_of_a_large_group_of_near_copies(spark):
    r = random.Random(9)
    base = prose(r, 150, 5000).split()
    texts = []
    for i in range(400):
        w = list(base)
        for _ in range(r.randint(1, 4)):
            w[r.randrange(len(w))] = f"new{r.randint(0, 10**6)}"
        texts.append((i, " ".join(w)))
    got = rows(ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(texts, "doc_id long, text string")), "doc_id")
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == linked(texts)


def test_components_of_chains_stars_and_self_links(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 300)] + [(7, 7), (500, 501), (501, 500), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(300)}, 500: 500, 501: 500}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_toxicity(spark, none):
    r = random.Random(4)
    made = [(i, prose(r, 50) + (" scoundrel villain" if i % 7 == 0 else "")) for i in range(1200)] + [(5000, None), (5001, "")]
    labels = [(i, 1 if i % 7 == 0 else 0) for i in range(1200) if i % 2 == 0] + [(14, 1), (None, 1), (99999, 1), (3, None)]
    d, lab = spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = rows(toxicity.toxicity(d, lab), "doc_id")
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for i, x in got.items())
    wrong = [i for i, _ in made[:1200] if got[i].predicted != (i % 7 == 0)]
    assert len(wrong) < 24
    # labels of the held-out fold change nothing
    flipped = lab.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = rows(toxicity.toxicity(d, flipped), "doc_id")
    assert all(got[i].score == pytest.approx(again[i].score) for i in got)
    assert toxicity.toxicity(none, lab).count() == 0
    assert set(x.predicted for x in toxicity.toxicity(d, lab.limit(0)).collect()) == {0}
    assert toxicity.drop_toxic(d.withColumn("score", F.lit("x")), lab).columns == ["doc_id", "text", "score"]


def test_toxicity_of_null_and_repeated_rows_and_clashing_columns(spark):
    r = random.Random(14)
    made = [(i, prose(r, 40) + (" scoundrel villain rogue" if i % 5 == 0 else "")) for i in range(600)]
    odd = [(None, "scoundrel villain rogue"), (None, None), (3, made[3][1]), (10, made[10][1]), (10, "calm"), (900, ""), (901, "villain rogue scoundrel " * 20000)]
    d = spark.createDataFrame([(i, t, 0, 0.5, "k") for i, t in made + odd], "doc_id long, text string, toxic int, score double, kind string")
    lab = spark.createDataFrame([(i, int(i % 5 == 0), "x") for i in range(0, 600, 2)] + [(10, 0, "y"), (None, None, None)], "doc_id long, toxic int, text string")
    got = toxicity.toxicity(d, lab).collect()
    assert len(got) == len(made + odd) and all(0 <= x.score <= 1 for x in got)
    by = collections.defaultdict(list)
    for x in got:
        by[x.doc_id].append(x.predicted)
    assert sorted(by[None]) == [0, 1] and sorted(by[10]) == [0, 1, 1] and by[3] == [0, 0] and by[900] == [0] and by[901] == [1]
    kept = toxicity.drop_toxic(d, lab)
    assert kept.columns == d.columns and kept.count() == sum(not x.predicted for x in got)


def test_counts_joins_and_rules_of_null_and_repeated_ids(spark):
    copy = prose(random.Random(15), 60)
    made = [(None, copy), (None, None), (5, copy), (5, copy), (5, "other words here now"), (9, copy + " x"), (2, "a b")]
    d = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in made], "doc_id long, text string, n long, n_words int, digest int")
    counts = collections.Counter((x.doc_id, x.n_tokens > 0) for x in token_counts.count_tokens(d, BPE).collect())
    assert counts == {(None, True): 1, (None, False): 1, (5, True): 3, (9, True): 1, (2, True): 1}
    links = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in ngram_jaccard.ngram_jaccard_join(d).collect()), key=repr)
    n = len({tuple(copy.split()[k : k + 4]) for k in range(57)})
    assert links == sorted([(None, n, None), (None, 0, None), (5, n, 5), (5, n, 5), (5, 1, 5), (9, n + 1, 5), (2, 1, 2)], key=repr)
    rules = quality_rules.quality_rules(d, spark.createDataFrame([(5, 1), (5, 0), (None, 1)], "doc_id long, quality int")).collect()
    assert collections.Counter((x.doc_id, x.n_words) for x in rules) == {(None, 60): 1, (None, 0): 1, (5, 60): 2, (5, 4): 1, (9, 61): 1, (2, 2): 1}


SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", True), "note": ("string", False)}}


def test_tool_calls_with_ties_and_long_texts(spark):
    calls = [("c", 1, "a", "search", '{"query":"z","limit":1}', []), ("c", 1, "a", "search", '{"query":"b","limit":1}', []), ("c", 2, "b", "search", '{"query":"%s","limit":1}' % ("y" * 200000), ["a", "a"])]
    results = [("c", 3, "a", "second"), ("c", 3, "a", "first"), ("c", 9, "a", "a late one"), ("c", 4, "b", "x" * 300000)]
    c = spark.createDataFrame(calls, "conv_id string, turn int, call_id string, name string, arguments string, after array<string>")
    r = spark.createDataFrame(results, "conv_id string, turn int, call_id string, content string")
    got = tool_calls.link_tool_calls(c.union(c), r, tool_calls.CHAT_TOOLS).collect()
    assert [(x.call_id, x.level, x.result_turn, x.n_results, x.errors) for x in got] == [("a", 0, 3, 3, []), ("b", 1, 4, 1, [])]
    assert got[0].json == '{"arguments":{"limit":1,"query":"b"},"conversation":"c","id":"a","name":"search","result":"first"}'
    assert len(got[1].json) > 500000


def test_tool_calls(spark):
    calls = [
        (1, 0, "x", "add", '{"b": 2.5, "a": 1}', []), (1, 1, "y", "add", '{"a": "1", "c": 0}', ["x"]), (1, 2, "z", "add", "{bad", ["y", "nowhere"]),
        (1, 3, "p", "add", '{"a":1,"b":1}', ["q"]), (1, 4, "q", "add", '{"a":1,"b":1}', ["p"]), (2, 0, "x", "sing", "{}", []), (2, 5, "x", "sing", "[1]", []), (2, 1, None, "add", None, []),
    ]
    results = [(1, 9, "x", "3.5"), (1, 8, "x", "first"), (2, 3, "gone", "?"), (2, 4, None, "?")]
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, after array<string>")
    a = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")
    got = tool_calls.link_tool_calls(c, a, SCHEMAS).collect()
    by = {(r.conv_id, r.call_id, r.kind): r for r in got}
    assert len(got) == 9
    x = by[1, "x", "linked"]
    assert (x.level, x.result_turn, x.n_results, x.errors) == (0, 8, 2, [])
    assert x.json == '{"arguments":{"a":1,"b":2.5},"conversation":1,"id":"x","name":"add","result":"first"}'
    assert by[1, "y", "no_result"].errors == ["extra:c", "missing:b", "type:a"] and by[1, "y", "no_result"].level == 1
    assert by[1, "z", "no_result"].errors == ["bad_json"] and by[1, "z", "no_result"].level == 2
    assert by[1, "p", "no_result"].level is None and by[1, "q", "no_result"].level is None
    assert by[2, "x", "no_result"].errors == ["unknown_tool"] and by[2, "gone", "no_call"].result_turn == 3
    assert (2, None, "no_result") in by and (2, None, "no_call") in by
    assert [r.level for r in got if r.conv_id == 1] == [None, None, 0, 1, 2]
    assert tool_calls.link_tool_calls(c.limit(0), a.limit(0), SCHEMAS).count() == 0


def test_calls_without_ids_and_long_chains(spark):
    calls = [(1, i, None, "add", f'{{"a":{i},"b":1}}', []) for i in range(5)] + [(None, 9, "k", "add", "{}", [])]
    chain = [(2, i, f"c{i}", "add", "{}", [f"c{i - 1}"] if i else []) for i in range(300)]
    joins = [(2, 500, "m", "add", "{}", ["c10", "c299"]), (2, 501, "n", "add", "{}", ["m"]), (2, 502, "o", "add", "{}", ["n", "c0", "lost"]), (2, 503, "p", "add", "{}", ["o", "q"]), (2, 504, "q", "add", "{}", ["p"]), (2, 505, "r", "add", "{}", ["q"])]
    c = spark.createDataFrame(calls + chain + joins, "conv_id long, turn long, call_id string, name string, arguments string, after array<string>").withColumn("level", F.lit("x"))
    a = spark.createDataFrame([(1, 7, None, "lost"), (1, 7, None, "lost"), (2, 8, "c3", "found")], "conv_id long, turn long, call_id string, content string").withColumn("kind", F.lit(1))
    got = tool_calls.link_tool_calls(c, a, SCHEMAS).collect()
    kinds = collections.Counter((r.conv_id, r.kind) for r in got)
    assert kinds == {(1, "no_result"): 5, (None, "no_result"): 1, (1, "no_call"): 2, (2, "no_result"): 305, (2, "linked"): 1}
    level = {r.call_id: r.level for r in got if r.conv_id == 2}
    assert all(level[f"c{i}"] == i for i in range(300)) and [level[x] for x in "mnopqr"] == [300, 301, 302, None, None, None]
    assert sorted(r.turn for r in got if r.conv_id == 1 and r.kind == "no_result") == [0, 1, 2, 3, 4]


def test_decontamination(spark, docs, none):
    texts = documents()
    r = random.Random(2)
    items = [(1, " ".join((texts[20][1] or "").split()[:25])), (2, "ONE two"), (3, prose(r, 30, 9999)), (4, None), (None, "one"), (10, "w1a! " + " ".join((texts[70][1] or "").split()[50:80])), (3, "x" * 20000)]
    low = str.maketrans(decontamination.UPPER, decontamination.LOWER)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    want = {}
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(10, len(v))
            for k in range(len(v) - n + 1) if v and item is not None else ():
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == v[k : k + n]:
                        hit |= set(range(at, at + n))
                        found.add(item)
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows(decontamination.decontaminate(docs, bench), "doc_id")
    assert {i: tuple(x)[1:6] for i, x in got.items()} == want
    assert sum(x.contaminated for x in got.values()) > 3
    assert decontamination.decontaminate(none, bench).count() == 0
    assert not any(x.contaminated for x in decontamination.decontaminate(docs, bench.limit(0)).collect())
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, x in want.items() if not x[4]}


def test_each_row_is_searched_by_its_own_text(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda my"
    made = [(1, item), (1, "x y"), (None, f"so {item.upper()}"), (None, None), (2, "kappa and alpha ÀÉ"), (2, "kappa and alpha ÀÉ"), (3, item), (3, item)]
    d = spark.createDataFrame(made, "doc_id long, text string")
    bench = spark.createDataFrame([("b", item), ("b", item), ("c", "À É"), ("d", "ÀÉ")], "item_id string, text string")
    got = sorted(decontamination.decontaminate(d, bench).collect(), key=repr)
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in got) == sorted([(1, 12, 12, 1), (1, 2, 0, 0), (0, 13, 12, 1), (0, 0, 0, 0), (2, 4, 1, 1), (2, 4, 1, 1), (3, 12, 12, 1), (3, 12, 12, 1)])
    kept = decontamination.drop_contaminated(d.withColumn("h", F.lit(1)), bench)
    assert kept.columns == ["doc_id", "text", "h"] and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (1, "x y")]


def test_proximity_matches_by_brute_force(spark):
    r = random.Random(11)
    text = lambda n: " ".join(f"t{r.randint(0, 40)}" for _ in range(n))
    made, items = [(i, text(r.randint(0, 60))) for i in range(40)], [(j, text(r.randint(1, 14))) for j in range(8)]
    n = collections.Counter(w for _, t in made for w in t.split())
    want = set()
    for j, item in items:
        v = item.split()
        size = min(10, len(v))
        for k in range(len(v) - size + 1):
            two = sorted((n[v[x]], x) for x in range(k, k + size))[:2]
            first, second = v[two[0][1]], v[two[-1][1]]
            if n[first] and first != second:
                for i, t in made:
                    w = t.split()
                    want |= {(i, j, a) for a, x in enumerate(w) for b, y in enumerate(w) if x == first and y == second and abs(a - b) <= 3}
    d, bench = spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    texts, _, near = decontamination.search(d, bench, within=3)
    # terms of equal counts may be taken in either order, so places are compared where counts differ
    got = {(x.doc_id, x.item_id) for x in near.join(texts, "row").collect()}
    assert want and got == {(i, j) for i, j, _ in want}


def test_substring_dedup(docs, none):
    texts = dict(documents())
    found = substring_dedup.repeated_spans(docs).collect()
    by = collections.defaultdict(list)
    for x in found:
        assert x.first_doc_id < x.doc_id and x.n_words >= 30
        by[x.doc_id].append(x)
    first, later = {}, set()
    for i, t in texts.items():
        w = (t or "").split()
        for k in range(len(w) - 50):
            if first.setdefault(tuple(w[k : k + 51]), i) != i:
                later.add(i)
    assert later <= set(by)
    clean = substring_dedup.remove_repeats(docs)
    assert clean.columns == docs.columns
    kept = rows(clean, "doc_id")
    for i, t in texts.items():
        if i not in by:
            assert kept[i].text == t
        elif i in kept:
            assert len(kept[i].text) < len(t) and kept[i].n_chars == len(kept[i].text)
    assert substring_dedup.repeated_spans(none).count() == 0 and substring_dedup.remove_repeats(none).count() == 0


def passages(texts, within):
    """Words in windows of 51 words that stand at an earlier place too, by document."""
    first, hit = {}, collections.defaultdict(set)
    for i, t in sorted(texts.items()):
        w = t.split()
        for k in range(len(w) - 50):
            doc, place = first.setdefault(tuple(w[k : k + 51]), (i, k))
            if doc < i or within and place + 51 <= k:
                hit[i] |= set(range(k, k + 51))
    return hit


def check_passages(spark, texts, within):
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    hit = collections.defaultdict(set)
    for x in substring_dedup.repeated_spans(frame, within=within).collect():
        raw = texts[x.doc_id].encode()
        mine = raw[x.start : x.stop].decode().split()
        before = len(raw[: x.start].split())
        assert x.n_words == len(mine) > 50
        assert f" {' '.join(mine)} " in f" {' '.join(texts[x.first_doc_id].split())} "
        hit[x.doc_id] |= set(range(before, before + len(mine)))
    assert hit == passages(texts, within)
    return hit


def test_each_passage_stands_whole_in_one_earlier_document(spark):
    r = random.Random(5)
    parts = [prose(r, 20) for _ in range(6)]
    texts = {i: f"{prose(r, 30)} {p} {prose(r, 30)}" for i, p in enumerate(parts, 1)} | {7: " ".join(parts), 8: f"{prose(r, 9)} {' '.join(parts)}"}
    hit = check_passages(spark, texts, False)
    assert set(hit) == {8} and len(hit[8]) == 120


def test_passages_of_short_words_are_found(spark):
    r = random.Random(6)
    short = lambda n: " ".join("".join(r.choice("abcdefgh01") for _ in range(r.randint(1, 2))) for _ in range(n))
    texts = {}
    for i in range(1, 81, 2):
        p = short(51)
        texts |= {i: f"{short(40)} {p} {short(20)}", i + 1: f"{short(15)}\n{p}  {short(33)}"}
    hit = check_passages(spark, texts, False)
    assert set(hit) == set(range(2, 81, 2))


def test_later_places_in_the_same_document(spark):
    r = random.Random(7)
    p = prose(r, 60)
    texts = {1: f"{p} {prose(r, 12)} {p} {prose(r, 5)} {p}", 2: prose(r, 90), 3: "the " * 300, 4: f"x {p}"}
    assert set(check_passages(spark, texts, False)) == {4}
    assert set(check_passages(spark, texts, True)) == {1, 3, 4}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = rows(substring_dedup.remove_repeats(frame, within=True), "doc_id")
    assert kept[1].text.count(p) == 1 and kept[4].text.split() == ["x"] and kept[2].text == texts[2]


def test_passages_with_null_and_repeated_ids(spark):
    r = random.Random(12)
    p, q = prose(r, 60), prose(r, 55)
    made = [(None, f"n {p}"), (None, "n"), (5, f"{q} tail"), (5, f"head {q}"), (5, f"head {q}"), (6, f"{p} six"), (7, prose(r, 80)), (8, None)]
    d = spark.createDataFrame([(i, t, 3, "s") for i, t in made], "doc_id long, text string, place int, __spans string")
    found = collections.Counter((x.doc_id, x.first_doc_id, x.n_words) for x in substring_dedup.repeated_spans(d).collect())
    assert found in ({(6, None, 60): 1, (5, 5, 55): 1}, {(6, None, 60): 1, (5, 5, 55): 2})
    kept = substring_dedup.remove_repeats(d)
    assert kept.columns == d.columns
    left = sorted((x.doc_id or 0, (x.text or "").split()) for x in kept.collect())
    whole = [sorted((i or 0, (t or "").split()) for i, t in rest) for rest in (
        [*made[:3], (5, "head"), (5, "head"), (6, "six"), *made[6:]], [*made[:2], (5, "tail"), *made[3:5], (6, "six"), *made[6:]])]
    assert left in whole


def test_quality_rules(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2) for i, _ in documents()] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = rows(quality_rules.quality_rules(docs, labels), "doc_id")
    for i, t in documents():
        w = WORDS.findall(t or "")
        n = collections.Counter(zip(w, w[1:], w[2:]))
        rep = len({k + j for k in range(len(w) - 2) for j in range(3) if n[tuple(w[k : k + 3])] > 1})
        assert (got[i].n_words, got[i].n_repeat_words, got[i].base_failed) == (len(w), rep, len(w) < 50 or 100 * rep > 50 * len(w))
        assert not (got[i].base_failed and got[i].kept)
    assert quality_rules.quality_rules(docs, labels.limit(0)).count() == docs.count()
    assert quality_rules.quality_rules(none, labels).count() == 0


def test_packing(spark, docs, none):
    got = packing.pack(docs, BPE, part_bytes=40000).collect()
    lib = Tokenizer.from_file(BPE)
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids + [1] for i, t in documents()}
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for x in got:
        pieces[x.doc_id].append(x)
        windows[x.sequence_id].append(x)
        part = ids[x.doc_id][x.start : x.start + x.length]
        assert len(part) == x.length > 0 and x.doc_tokens == len(ids[x.doc_id])
        assert x.ids_crc32 == zlib.crc32(b"".join(t.to_bytes(4, "little") for t in part))
    for i, all_ids in ids.items():
        at = 0
        for x in sorted(pieces[i], key=lambda x: x.start):
            assert x.start == at
            at += x.length
        assert at == len(all_ids)
    for parts in windows.values():
        at = 0
        for x in sorted(parts, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at == 2048 or at & (at - 1) == 0
    assert len(windows) > 4 and packing.pack(none, BPE).count() == 0
    shares = spark.createDataFrame([("s1", 1.0)], "source string, share double")
    assert sum(x.length for x in packing.pack(docs, BPE, targets=shares).collect()) == sum(map(len, ids.values()))


def test_packing_of_null_and_repeated_ids_and_many_sources(spark):
    r = random.Random(13)
    made = [(None, "a", "one two"), (None, "b", None), (4, "a", "x"), (4, "a", "x"), (4, None, "")]
    made += [(i + 10, f"s{i % 20}", prose(r, r.randint(50, 200))) for i in range(1500)]
    d = spark.createDataFrame(made, "doc_id long, source string, text string")
    got = packing.pack(d.repartition(4), BPE, part_bytes=250_000).collect()
    lib = Tokenizer.from_file(BPE)
    n = collections.Counter()
    for x in got:
        n[x.doc_id] += x.length
    assert n[None] == 2 + len(lib.encode("one two", add_special_tokens=False).ids) and n[4] == 3 + 2 * len(lib.encode("x", add_special_tokens=False).ids)
    # every full window, while no source is dry, has each source at half to one and a half of its share
    source = {i: s for i, s, _ in made}
    windows, total = collections.defaultdict(collections.Counter), collections.Counter()
    for x in got:
        if x.doc_id is not None and x.doc_id >= 10:
            windows[x.sequence_id][source[x.doc_id]] += x.length
            total[source[x.doc_id]] += x.length
    whole = [w for w in windows.values() if sum(w.values()) == 2048]
    even = [w for w in whole if len(w) == 20]
    assert len(even) > 0.5 * len(whole)
    part = {s: 2048 * n / sum(total.values()) for s, n in total.items()}
    assert sum(0.45 * part[s] - 2 <= w[s] for w in even for s in part) > 0.97 * len(even) * len(part)  # the last of a dry source may be less
    assert sum(w[s] <= 1.6 * part[s] + 32 for w in even for s in part) > 0.99 * len(even) * len(part)


def test_carried_debts_are_paid_over_many_windows():
    p = packing.Packer(0, 2048)
    p.source("a", 100.0, 30_000.0)
    p.source("b", 100.0, -30_000.0)
    for i in range(200):
        p.add("ab"[i % 2], i, np.zeros(1000, np.uint32), 4000)
    p.drain(100_000)
    per = collections.defaultdict(collections.Counter)
    for doc, _, n, _, _, seq, _ in p.out:
        per[seq]["ab"[doc % 2]] += n
    assert per[0] == {"a": 1536, "b": 512} and sum(p.owed.values()) == pytest.approx(0, abs=1)
    assert sum(w["a"] - w["b"] for w in per.values()) == pytest.approx(2 * 7500, abs=300)


def test_warc(spark):
    big, other = "é" * 600, "x" * 1000
    made = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "http://a/", big), (3, "http://b/", big), (4, "u", "tiny"), (5, "u", "tiny"), (6, "u", None), (7, "u", other), (None, "u", other), (9, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 60), (4, "u", "tiny"), (None, None, None), (10, "v", "y" * 300000), (10, "v", "y" * 300000)]
    pages = spark.createDataFrame([(*p, 3, "r") for p in made], "page_id long, url string, html string, payload_bytes int, type string").repartition(3)
    want, last = collections.Counter(), {}
    for i, _, h in made:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    left = {h: 1 for h in last}
    for i, _, h in sorted(made, key=lambda x: (x[0] is None, x[0])):
        raw = (h or "").encode()
        first = i == last[h or ""] and left[h or ""]  # one row of the largest page_id is the response
        left[h or ""] -= bool(first)
        again = len(raw) >= 1000 and not first
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last[h or ""] if again else None] += 1
    got = collections.Counter(tuple(x) for x in warc.archive_and_read(pages).collect())
    assert sum(got.values()) == len(made) and got == want
    assert warc.archive_and_read(pages.limit(0)).count() == 0
