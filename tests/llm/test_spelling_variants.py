"""Spelling variants against a plain count and a comparison of all pairs of words."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from brindle.llm import spelling_variants as sv

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, word string, n long, size int, part int, near string"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def by_hand(docs):
    n = collections.Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    form, met = {}, {}
    for w in n:
        others = [x for x in n if near(w, x)]
        met[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], met[w], n.get(form[w]))
    return out


def variants(seed=4):
    """Texts of words and misspellings of them, long words, accents, upper case, nulls and repeats."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzéßçÀ÷×ñ"
    base = ["".join(r.choice(letters) for _ in range(r.randint(4, 9))) for _ in range(60)] + ["q" * 30, "ab" * 40, "x" * 3000, "nannen", "nennan"]
    def spoilt(w):
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            i = r.randrange(len(w))
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :]])
        return w or "a"
    pool = [spoilt(r.choice(base)) for _ in range(500)] + base
    weights = [1 / (i + 1) for i in range(len(pool))]
    docs = [(i, " ".join(r.choices(pool, weights, k=120)) + r.choice(["", " Straße-ÉCOLE 12 naïve_naive", "\tthe end."])) for i in range(150)]
    return docs + [(None, "nothing nothing nothing nothing"), (3, None), (4, ""), (5, "repeated row"), (5, "repeated row"), (5, "repeated row"), (-7, "x" * 3001 + " " + "x" * 3001 + "," + "x" * 3001)]


@pytest.mark.parametrize("part_bytes", [sv.PART_BYTES, 300])
def test_words_forms_and_roots(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(sv, "PART_BYTES", part_bytes)  # a small bound splits the subtrees into many parts
    docs = variants()
    df = spark.createDataFrame([(i, t, "clash", 1, 2, 3, "clash") for i, t in docs], DOCS).repartition(5)
    rows = sv.spelling_variants(df).collect()
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in rows}
    want = by_hand(docs)
    assert len(rows) == len(got) and got == want
    assert sum(w[0] is not None for w in want.values()) > 30 and any(w[0] != w[1] for w in want.values() if w[0])
    assert "x" * 3001 in got and got["x" * 3001][3] == (1 if "x" * 3000 in got else 0)


def test_lost_letters_and_empty_tables(spark):
    docs = [(i, "withdrawal") for i in range(2000)]
    got = {x.word: x.n for x in sv.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {w: v[2] for w, v in by_hand(docs).items()} and len(got) > 1
    assert sv.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_checksums_go_on_from_a_prefix():
    r = random.Random(2)
    words = [bytes(r.randrange(256) for _ in range(r.choice([0, 1, 5, 9, 48, 49, 300]))) for _ in range(300)]
    edge = np.cumsum([0, *map(len, words)])
    data = np.frombuffer(b"".join(words), np.uint8)
    before = [zlib.crc32(f"{i}:".encode()) for i in range(len(words))]
    got = sv.checksums(data, edge[:-1], edge[1:], np.array(before, np.uint32))
    assert got.tolist() == [zlib.crc32(w, b) for w, b in zip(words, before, strict=True)]


def test_all_pairs_of_random_words_are_found():
    r = random.Random(9)
    words = sorted({"".join(r.choice("abé") for _ in range(6)) for _ in range(200)})
    trie = sv.Trie(words, np.ones(len(words), np.int64))
    own = trie.words.to_pylist()
    ones = np.ones(len(words), np.int64)
    found = {(words[a], own[b]) for q, x in trie.near(words, ones, ones) for a, b in zip(q.tolist(), x.tolist(), strict=True)}
    # the first levels aren't compared here, so pairs with different counts there are the leaves' own only
    want = {(a, b) for a in words for b in words if a < b and near(a, b)}
    assert {p for p in found if not near(*p)} == set() and found <= want
    assert {p for p in want if sorted(sv.GROUP[[ord(c) for c in p[0]]]) == sorted(sv.GROUP[[ord(c) for c in p[1]]])} <= found
