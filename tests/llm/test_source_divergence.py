"""Packed counting and the source divergence audit against plain Python."""

import collections
import random
import re

import numpy as np
import pytest
from brindle.llm import source_divergence as sd
from brindle.llm.packed_terms import PackedTerms, radix_order

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, term string, n long, p long, number int, rank int, key string"


def test_radix_order_is_stable():
    r = np.random.default_rng(3)
    key = r.integers(0, 1 << 63, 5000).astype(np.uint64) >> r.integers(0, 60, 5000).astype(np.uint64)
    assert (radix_order(np.arange(5000), key) == np.argsort(key, kind="stable")).all()


def test_runs_count_terms_of_all_lengths():
    r = random.Random(6)
    pool = ["a", "ab", "b" * 8, "b" * 9, "c" * 16, "c" * 17, "d" * 32, "d" * 33, "é" * 9, "e" * 70000] + ["".join(r.choice("abé") for _ in range(r.randint(1, 40))) for _ in range(200)]
    texts = [[r.choice(pool) for _ in range(r.randint(0, 60))] for _ in range(90)]
    group = np.array([i * 7 % 5 for i in range(len(texts))])
    terms = PackedTerms()
    for half in (range(45), range(45, 90)):
        words = [w.encode() for i in half for w in texts[i]]
        edge = np.cumsum([0, *map(len, words)])
        terms.add(np.frombuffer(b"".join(words), np.uint8), edge[:-1], edge[1:], np.array([i for i in half for _ in texts[i]]))
    got = {}
    for term, g, n, docs in terms.runs(group):
        for key in zip(term.to_pylist(), g.tolist(), n.tolist(), docs.tolist(), strict=True):
            assert got.setdefault(key[:2], key[2:]) == key[2:]
    want = collections.defaultdict(lambda: [0, 0])
    for i, t in enumerate(texts):
        for w, n in collections.Counter(t).items():
            want[w, int(group[i])][0] += n
            want[w, int(group[i])][1] += 1
    assert got == {k: tuple(v) for k, v in want.items()}


def by_hand(docs, least, top=10):
    docs = [((lang or ""), (source or ""), [t.translate(UPPER) for t in TERM.findall(text or "")]) for text, lang, source in docs]
    n, seen = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    groups = sorted({(lang, s) for lang, s, _ in docs})
    for lang, s, terms in docs:
        n[lang, s].update(terms)
        n[lang].update(terms)
        seen[lang].update(set(terms))
    kept = {lang: [t for t, c in seen[lang].items() if c >= least] for lang, _ in groups}
    def shares(key, lang):
        total = sum(n[key][t] for t in kept[lang]) + 2 * len(kept[lang])
        return {t: 1 + 10**9 * (n[key][t] + 2) // total for t in kept[lang]}
    p = {g: shares(g, g[0]) for g in groups} | {lang: shares(lang, lang) for lang in kept}
    f = lambda a, b: (a - b) ** 2 // (a + b)
    out = set()
    for lang, s in groups:
        mine = p[lang, s]
        pairs = [(sum(f(mine[t], p[lang, o][t]) for t in kept[lang]), o) for x, o in groups if x == lang and o != s]
        terms = [(f(mine[t], p[lang][t]), t) for t in kept[lang] if n[lang, s][t] and mine[t] > p[lang][t]]
        for part, rows in (("pair", pairs), ("term", terms)):
            for k, (value, item) in enumerate(sorted(rows, key=lambda x: (-x[0], x[1].encode())), 1):
                if part == "pair" or k <= top:
                    out.add((lang, s, part, item, value, k))
    return out


def texts(seed=5, n=400, sources=7):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdeé") for _ in range(r.choice([1, 3, 6, 9, 14, 20]))) for _ in range(80)] + ["z" * 5000]
    out = []
    for _ in range(n):
        s = r.randrange(sources)
        words = r.choices(pool, [1 / (1 + (k * (s + 3)) % 17) for k in range(len(pool))], k=r.randint(0, 30))
        out.append((" ".join(w.upper() if r.random() < 0.2 else w for w in words) + r.choice(["", " 12-x_y", " \U0001f389日本"]), r.choice(["en", "de", None]), f"s{s}" if s else None))
    return out + [("lonely words", "xx", "only"), (None, "xx", "other"), ("", "yy", "s1"), (None, None, None)] + [("the same row", "en", "s2")] * 12


@pytest.mark.parametrize("flush,block", [(sd.FLUSH_TERMS, sd.BLOCK), (300, 3)])  # a small block makes many pairs of blocks
def test_divergences(spark, flush, block):
    docs = texts()
    df = spark.createDataFrame([(1, t, lang, s, "clash", 1, 2, 3, 4, "clash") for t, lang, s in docs], DOCS).repartition(6)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)  # terms go over the edges of batches
    try:
        rows = sd.source_divergence(df, flush=flush, block=block).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = {tuple(r) for r in rows}
    assert len(got) == len(rows) and got == by_hand(docs, sd.LEAST_DOCS)
    assert any(r[2] == "term" for r in got)


def test_empty_table_and_large_counts(spark):
    assert sd.source_divergence(spark.createDataFrame([], DOCS)).count() == 0
    pairs = [(2, 5), (10**14, 3 * 10**14 + 7), (9 * 10**15 - 1, 9 * 10**15), (10**10, 10**10)]
    rows = spark.createDataFrame(pairs, "n long, total long").select(sd.per_billion(sd.F.col("n"), sd.F.col("total")).alias("p")).collect()
    assert [r.p for r in rows] == [1 + 10**9 * a // b for a, b in pairs]
