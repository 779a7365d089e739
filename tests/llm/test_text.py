"""Word spans, hashes, chunks, token counts: the parts that need no session."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brindle.llm import common, quality_rules, substring_dedup, token_counts, toxicity, warc
from brindle.llm.packing import Packer
from tokenizers import Tokenizer

BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", "a<|endoftext|>B<|startoftext|>", "ΑΣ ΌΔΟΣ", "aaaaaaaaaaa!!!!$$$", "it's I'LL we'RE 123 ４５ ²", "\x1c a\x85b", "é à ﬁ Å İ ẞ", "日本語 🎉🎉", "<|end", "'S'T'RE''ll"]


def batch(texts):
    return pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})


def random_texts(n, letters, longest=60, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(0, longest))) for _ in range(n)]


def test_word_spans_split_rows_and_white_space():
    texts = ["a b", None, "", "c\td\x0b e", "f"]
    (_, _, data, offsets) = next(common.text_slices(batch(texts)))
    s, e, row = common.word_spans(data, offsets)
    assert [(bytes(data[a:b]).decode(), r) for a, b, r in zip(s, e, row)] == [("a", 0), ("b", 0), ("c", 3), ("d", 3), ("e", 3), ("f", 4)]


def test_slices_keep_every_row_even_one_longer_than_the_limit():
    texts = ["x" * 50, "", "y", "z" * 7]
    parts = list(common.text_slices(batch(texts), limit=8))
    assert [p[:2] for p in parts][0] == (0, 1) and parts[-1][1] == 4
    assert b"".join(bytes(p[2]) for p in parts).decode() == "".join(texts)


def test_shingle_sets_match_word_tuples():
    texts = random_texts(300, "aAb \n", 40) + ["one two", "ONE  two", "one"]
    (_, _, data, offsets) = next(common.text_slices(batch(texts)))
    got = [tuple(s.tolist()) for s in common.shingle_sets(data, offsets, 4)]
    low = [t.lower().split() for t in texts]
    want = [frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset() for w in low]
    assert [len(g) for g in got] == [len(w) for w in want]
    by = {}
    for g, w in zip(got, want):
        assert by.setdefault(g, w) == w
    assert len(set(got)) == len(set(want))


def test_token_counts_and_ids_are_the_librarys():
    texts = ODD + random_texts(800, "'''srtvemld aé1!<|>\n\x1c\x85 ß")
    lib = [x.ids for x in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    table = token_counts.merge_table(BPE)
    assert token_counts.counted(texts, table, {}).tolist() == [len(x) for x in lib]
    assert [x.tolist() for x in token_counts.TokenIds(table).encode(texts)] == lib


def test_neighbouring_hits_are_taken_from_the_left():
    assert token_counts.every_other(np.array([1, 1, 1, 0, 1, 1, 0, 1], bool)).tolist() == [True, False, True, False, True, False, False, True]


def test_every_window_holds_a_chunk_of_its_own_words():
    """Chunks of equal windows are equal wherever they stand, and each window holds one whole."""
    r = random.Random(8)
    some = [hash_of(r) for _ in range(40)]
    rows = [[r.choice(some) for _ in range(n)] for n in (0, 1, 50, 51, 300)] + [[some[0]] * 200]
    shared = [hash_of(r) for _ in range(51)]
    rows += [[hash_of(r) for _ in range(k)] + shared + [hash_of(r) for _ in range(60)] for k in (0, 7, 33)]
    words = np.array([w for x in rows for w in x], np.uint64)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    cut = substring_dedup.Chunks(words, row, 51)
    assert len(cut.first) == sum(max(0, len(x) - 50) for x in rows)
    end = cut.cuts[np.searchsorted(cut.cuts, cut.chunk, "right")]
    assert (cut.chunk >= cut.first).all() and (end + substring_dedup.GEAR_WORDS <= cut.first + 51).all()
    digests, seen = cut.digests(cut.chunk), {}
    for s, c, d in zip(cut.first, cut.chunk, digests, strict=True):
        assert seen.setdefault(tuple(words[s : s + 51]), (c - s, d)) == (c - s, d)
    assert tuple(shared) in seen


def hash_of(r):
    return r.getrandbits(64)


def test_cuts_take_whole_words():
    assert substring_dedup.cut_words("aé bb cc dd", [(1, 2)]) == "aé  dd"
    assert substring_dedup.cut_words("aé bb cc dd", [(0, 2), (1, 3)]) == ""


def test_statistics_match_plain_counts():
    import collections
    import re

    texts = ["", "a\nb\r\na\na", "é b\né b\n\x0bé b"] + random_texts(400, "ab \n#é")
    (_, _, data, offsets) = next(common.text_slices(batch(texts)))
    got = quality_rules.statistics(data, offsets)[0]
    for t, row in zip(texts, got):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {i + j for i in range(len(w) - 2) for j in range(3) if n[tuple(w[i : i + 3])] > 1}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert row.tolist() == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)]


def test_trees_keep_their_constraints():
    r = np.random.default_rng(0)
    x = r.random((2000, len(quality_rules.FEATURES)))
    y = ((x[:, 2] < 0.5) ^ (r.random(2000) < 0.1)).astype(float)
    trees = quality_rules.grow(x, y, np.array(list(quality_rules.FEATURES.values())))
    base = x[:50].copy()
    scores = []
    for v in np.linspace(0, 1, 21):
        base[:, 2] = v
        scores.append(trees.scores(base))
    assert (np.diff(np.array(scores), axis=0) <= 1e-12).all()
    assert ((trees.scores(x) >= 0.5) == (x[:, 2] < 0.5)).mean() > 0.95


def test_one_class_or_no_rows_give_a_constant_score():
    for y in ([], [1.0, 1.0]):
        trees = quality_rules.grow(np.zeros((len(y), len(quality_rules.FEATURES))), np.array(y), np.array(list(quality_rules.FEATURES.values())))
        assert trees.scores(np.zeros((2, len(quality_rules.FEATURES)))).tolist() == pytest.approx([0.999, 0.999])


def test_positive_unlabelled_fit_finds_toxic_texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    text = lambda bad: " ".join([word() for _ in range(60)] + (["scoundrel"] * 2 if bad else []))
    rows = pa.table({"text": [text(True) for _ in range(150)] + [text(i % 9 == 0) for i in range(900)], "kind": [1] * 150 + [0] * 900})
    model = toxicity.fit(rows, 0.11)
    check = [text(i % 2 == 0) for i in range(200)]
    (_, _, data, offsets) = next(common.text_slices(batch(check)))
    got = model.scores(data, offsets) >= toxicity.THRESHOLD
    assert (got == np.array([i % 2 == 0 for i in range(200)])).mean() > 0.97


def test_no_toxic_example_scores_nothing():
    model = toxicity.fit(pa.table({"text": pa.array([], pa.string()), "kind": pa.array([], pa.int32())}), 0.1)
    (_, _, data, offsets) = next(common.text_slices(batch(["anything", ""])))
    assert (model.scores(data, offsets) < 1e-6).all()


def test_packer_fills_windows_to_the_shares_and_leaves_no_padding():
    p = Packer(0, 2048)
    p.source("a", 0.75, 0.0)
    p.source("b", 0.25, 0.0)
    for i in range(60):
        p.add("a" if i % 4 else "b", i, np.arange(700, dtype=np.uint32))
    p.finish()
    per = {}
    for doc, _, n, _, _, seq, _ in p.out:
        per.setdefault(seq, {}).setdefault("a" if doc % 4 else "b", []).append(n)
    sizes = {seq: sum(map(sum, x.values())) for seq, x in per.items()}
    assert sum(sizes.values()) == 60 * 700
    assert all(s == 2048 or s & (s - 1) == 0 for s in sizes.values())
    full = [x for seq, x in per.items() if sizes[seq] == 2048]
    assert all(abs(sum(x.get("b", [])) - 512) <= 256 for x in full[:15])


def test_damaged_archives_are_refused():
    whole = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <x>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert len(list(warc.parse(whole * 2))) == 2
    for bad in (whole[:-3], whole.replace(b": 3", b": 9"), b"junk" + whole):
        with pytest.raises(RuntimeError):
            list(warc.parse(bad))
