"""Stupid-backoff language-model scores, computed as joins of n-grams with count tables.

A text is scored by what all other texts hold: an n-gram's count is that of the
corpus less the text's own occurrences (leave one out), so what only this text
says isn't in its model, and its words fall back to lower orders.

Texts are dealt to chunks of a few megabytes, written once. Each chunk gives its
distinct words, bigrams and trigrams with their counts, as sorted hashes, cut
into parts of the hash range: an n-gram is sent once a chunk, not once a place,
so none is frequent enough to make a part uneven. The rows of a part are summed
up to its count table, of n-grams that two texts have, as others can never be
found; the tables are joined to the chunks' n-grams by part, and the counts go
back to the chunks by a second join. With the counts of all orders at hand each
place is scored at the highest order that is found, where the text is.

The hash range and then the chunks are worked off in a fixed number of passes,
which bounds the shuffle space in use at any time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import LOWER, MUL, SLICE_BYTES, drop_dir, gram_hashes, mix, release, span_hashes, text_slices, word_spans, work_dir, written

ALPHA = 0.4
#: N-grams of two and three words are in a text's model from this count in other texts on.
LEAST_COUNT = 1
#: Passes over the hash range of n-grams, and over the chunks for their scores; the numbers don't depend on the data.
PASSES, SCORE_PASSES = 5, 3
#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: A row counts as so many bytes at least, so that a chunk's rows are bounded too.
ROW_BYTES = 64
#: Parquet looks at the size of a row group after so many rows already.
FEW_LARGE_ROWS = {"parquet.block.size.row.check.min": "8"}
#: Words of the corpus for each part of a pass.
PART_WORDS = 500_000


class Grams:
    """N-grams of a chunk's rows: ``h`` and ``row`` hold its words, then the bigrams that end at ``pairs``, then the trigrams that end at ``triples``.

    ``place`` is a word's number in its row, ``size`` the number of words of each row.
    """

    def __init__(self, texts: pa.Array):
        parts = [[], [], [], [], [], []]
        for a, _, data, offsets in text_slices(pa.RecordBatch.from_arrays([texts], names=["text"])):
            data = LOWER[data]
            starts, ends, row = word_spans(data, offsets)
            h1 = span_hashes(data, starts, ends)
            edges = np.searchsorted(row, np.arange(len(offsets)))
            place = np.arange(len(h1)) - edges[:-1][row]
            for part, x in zip(parts, (h1, gram_hashes(h1, 2)[place[1:] > 0], gram_hashes(h1, 3)[place[2:] > 1], row + a, place, np.diff(edges)), strict=True):
                part.append(x)
        whole = lambda k, kind: np.concatenate([np.zeros(0, kind), *parts[k]])
        row, self.place, self.size = (whole(k, np.int64) for k in (3, 4, 5))
        self.pairs, self.triples = np.flatnonzero(self.place > 0), np.flatnonzero(self.place > 1)
        self.h = np.concatenate([whole(k, np.uint64) for k in range(3)])
        self.row = np.concatenate([row, row[self.pairs], row[self.triples]])


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each first of equal values, how many there are)."""
    first = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])[: len(sorted_values)])
    return first, np.diff(np.append(first, len(sorted_values)))


def own_counts(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How often each place's value occurs in its row."""
    key = mix(h + row.astype(np.uint64) * MUL)
    order = np.argsort(key)
    _, n = runs(key[order])
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(n, n)
    return out


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of hashes, so sorted hashes lie in the order of their parts."""
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def blobs(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of the values between two edges each."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64) * values.itemsize), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def values(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def chunked(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """(chunk, doc_ids, texts, n_words): a row for about ``chunk_bytes`` of rows that follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size, words = TaskContext.get().partitionId() << 32, [], 0, 0

        def row() -> pa.RecordBatch:
            lists = [pa.concat_arrays(x) for x in zip(*held, strict=True)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
            return pa.RecordBatch.from_arrays([pa.array([chunk]), *lists, pa.array([words])], names=["chunk", "doc_ids", "texts", "n_words"])

        for batch in batches:
            for a, b, data, offsets in text_slices(batch, limit=min(chunk_bytes, SLICE_BYTES)):
                more = len(data) + ROW_BYTES * (b - a)
                if size and size + more > chunk_bytes:
                    yield row()
                    chunk, held, size, words = chunk + 1, [], 0, 0
                held.append([c.slice(a, b - a) for c in batch.columns])
                size, words = size + more, words + len(word_spans(data, offsets)[0])
        if held:
            yield row()

    return docs.mapInArrow(run, "chunk long, doc_ids array<long>, texts array<string>, n_words long")


def chunk_grams(chunks: DataFrame, turn: int, each: int, parts: int) -> DataFrame:
    """(part, chunk, grams, seen): the distinct n-grams of every chunk in the ``each`` parts of a turn.

    ``grams`` are sorted hashes; ``seen`` is twice the count in the chunk, and
    one more where several of its texts have the n-gram.
    """

    def of(chunk: int, texts: pa.Array) -> pa.RecordBatch:
        g = Grams(texts)
        at = np.flatnonzero(part_of(g.h, parts) // np.uint64(each) == turn)
        at = at[np.argsort(g.h[at])]
        h, row = g.h[at], g.row[at]
        first, n = runs(h)
        several = np.maximum.reduceat(row, first) > np.minimum.reduceat(row, first) if len(h) else np.zeros(0, bool)
        h = h[first]
        edges = np.searchsorted(part_of(h, parts), np.arange(turn * each, (turn + 1) * each + 1).astype(np.uint64))
        there = np.flatnonzero(np.diff(edges))
        edges = np.append(edges[there], len(h))
        return pa.RecordBatch.from_arrays([pa.array(turn * each + there), pa.array(np.full(len(there), chunk)), blobs(h, edges), blobs((2 * n + several).astype(np.uint32), edges)], names=["part", "chunk", "grams", "seen"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, texts in zip(batch["chunk"].to_pylist(), batch["texts"], strict=True):
                yield of(chunk, texts.values)

    return chunks.select("chunk", "texts").mapInArrow(run, "part long, chunk long, grams binary, seen binary")


def count_tables(grams: DataFrame) -> DataFrame:
    """(part, held, n): of each part the n-grams that more than one text has, sorted, and their counts in the corpus."""

    def run(table: pa.Table) -> pa.Table:
        h, seen = np.concatenate(values(table["grams"], np.uint64)), np.concatenate(values(table["seen"], np.uint32)).astype(np.int64)
        order = np.argsort(h)
        h, seen = h[order], seen[order]
        first, chunks = runs(h)
        keep = (chunks > 1) | (seen[first] & 1 > 0)  # of one chunk only: what it says itself
        return pa.table([table["part"].slice(0, 1), pa.array([h[first][keep].tobytes()], pa.binary()), pa.array([np.add.reduceat(seen >> 1, first)[keep].tobytes()], pa.binary())], names=["part", "held", "n"])

    return grams.groupBy("part").applyInArrow(run, "part long, held binary, n binary")


def looked_up(grams: DataFrame, tables: DataFrame) -> DataFrame:
    """(chunk, part, counts): the corpus's count of each n-gram of ``grams``, in their order; 0 for those in no table.

    The counts of a row are numbers of as many bytes as the largest needs.
    """

    def run(asked: pa.Table, table: pa.Table) -> pa.Table:
        (held,), (n,) = values(table["held"], np.uint64), values(table["n"], np.int64)
        out = []
        for h in values(asked["grams"], np.uint64):
            c = np.zeros(len(h), np.int64)
            if len(held):
                at = np.minimum(np.searchsorted(held, h), len(held) - 1)
                c = np.where(held[at] == h, n[at], 0)
            out.append(c.astype(np.min_scalar_type(c.max())).tobytes())
        return pa.table([asked["chunk"], asked["part"], pa.array(out, pa.binary())], names=["chunk", "part", "counts"])

    return grams.groupBy("part").cogroup(tables.groupBy("part")).applyInArrow(run, "chunk long, part long, counts binary")


def scored(chunks: DataFrame, counts: DataFrame, parts: int, total: int, alpha: float, least: int) -> DataFrame:
    """(doc_id, n_words, score, backed) of every row: its words' scores summed up, and how many of them fell back."""

    def run(chunk: pa.Table, counts: pa.Table) -> pa.Table:
        g = Grams(chunk["texts"][0].values)
        order = np.argsort(g.h)
        h = g.h[order]
        first, n = runs(h)
        part = counts["part"].to_numpy()
        there, sizes = runs(part_of(h[first], parts))
        by_part = np.argsort(part)
        assert len(part) == len(there) and (part[by_part] == part_of(h[first[there]], parts)).all()
        found = [np.zeros(0, np.int64)]
        for k, size in zip(by_part.tolist(), sizes.tolist(), strict=True):
            data = counts["counts"][k].as_buffer()
            found.append(np.frombuffer(data, f"u{data.size // size}").astype(np.int64))
        others = np.empty(len(h), np.int64)
        others[order] = np.repeat(np.concatenate(found), n)
        at = np.flatnonzero(others)
        others[at] -= own_counts(g.h[at], g.row[at])
        words, pairs = len(g.place), len(g.place) + len(g.pairs)
        one, two, three = others[:words], np.zeros(words, np.int64), others[pairs:]
        two[g.pairs] = others[words:pairs]
        step, row = np.log(alpha), g.row[:words]
        score = np.log(np.maximum(one, 1)) - np.log(np.maximum(total - g.size[row], 1)) + step * np.minimum(g.place, 2)
        backed = np.minimum(g.place, 1)
        at = g.pairs[two[g.pairs] >= least]
        score[at] = np.log(two[at]) - np.log(one[at - 1]) + step * (g.place[at] > 1)
        backed[at] = g.place[at] > 1
        at, three = g.triples[three >= least], three[three >= least]
        score[at] = np.log(three) - np.log(two[at - 1])
        backed[at] = 0
        rows = len(g.size)
        return pa.table([chunk["doc_ids"][0].values, pa.array(g.size.astype(np.int64)), pa.array(np.bincount(row, score, rows).astype(float)), pa.array(np.bincount(row, backed, rows).astype(np.int64))], names=["doc_id", "n_words", "score", "backed"])

    texts = chunks.select("chunk", "doc_ids", "texts")
    return texts.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(run, "doc_id long, n_words long, score double, backed long")


def stupid_backoff(docs: DataFrame, alpha: float = ALPHA, least_count: int = LEAST_COUNT, passes: int = PASSES, top_words: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, log_score (natural, summed over words), mean_log_score and n_backed of every document.

    A text's model counts the words, bigrams and trigrams of all other rows of
    ``docs`` (A-Z lower-cased, words by ASCII white space). A word scores
    c(n-gram) / c(words before) at the highest order whose n-gram has a count
    of at least ``least_count``, times ``alpha`` for each order it had to fall
    back, from the highest order that its place in the text allows; single
    words score c(word) / all words, where a count of 0 is taken as 1.
    ``n_backed`` is the number of words that fell back. Counts go by 64-bit
    hashes.

    A text that is null or has no words has n_words 0, log_score 0 and a null
    mean. Rows that repeat a doc_id are texts of their own, which add up to one
    result row, and a null doc_id is an id like any other; so copies of a text
    are in each other's model. Whole texts are read, however long, once from
    ``docs``; an empty table gives no rows. Other columns are not read.
    ``top_words`` is taken for older callers and has no effect.
    """
    spark = docs.sparkSession
    base = work_dir(spark)
    chunks = written(chunked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), chunk_bytes), f"{base}/chunks", compression="zstd", **FEW_LARGE_ROWS)
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    each = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // (passes * PART_WORDS))
    counts = None
    for turn in range(passes):
        grams = chunk_grams(chunks, turn, each, passes * each)
        part = written(looked_up(grams, count_tables(grams)), f"{base}/counts{turn}")
        counts = part if counts is None else counts.unionByName(part)
        grams = part = None
        release(spark)
    rows = None
    for turn in range(SCORE_PASSES):
        mine = F.pmod(F.hash("chunk"), F.lit(SCORE_PASSES)) == turn
        part = written(scored(chunks.where(mine), counts.where(mine), passes * each, total, alpha, least_count), f"{base}/rows{turn}")
        rows = part if rows is None else rows.unionByName(part)
        release(spark)
    for name in ("chunks", *(f"counts{t}" for t in range(passes))):
        drop_dir(spark, f"{base}/{name}")
    release(spark)
    out = rows.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("score").alias("log_score"), F.sum("backed").alias("n_backed"))
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return out.select("doc_id", "n_words", "log_score", mean.alias("mean_log_score"), "n_backed")
