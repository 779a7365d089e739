"""Quality rules: boosted trees over document statistics.

One numpy pass makes the statistics of whole texts. Trees are grown on
histograms of a bounded labelled sample with monotonic constraints (more
symbols, repeated lines or repeated words never raise a score) and flattened
into node arrays; scoring walks all rows of a batch down each tree at once.
The operator is a scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import MUL, gram_hashes, lut, mix, span_hashes, text_slices, word_spans

#: Bound of the labelled sample that the trees are grown on, in texts.
MAX_LABELLED = 12000
TREES, DEPTH, BINS, RATE, LEAST = 60, 3, 48, 0.2, 20
#: Texts with a score below this go.
KEEP_FROM = 0.5

#: The base counts, and the ratios that the trees see with their constraint: -1 never raises the score.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = {"words": 0, "word_length": 0, "symbol_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1, "distinct_ratio": 0, "words_per_line": 0,
    "ended_lines": 1, "upper_ratio": 0, "digit_ratio": 0, "other_ratio": 0}

SYMBOLS = lut(*[(ord(c), ord(c)) for c in "#*$%&|<>"])
NEWLINE = lut((0x0A, 0x0A))
UPPER, DIGIT = lut((0x41, 0x5A)), lut((0x30, 0x39))
LETTER = lut((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
ENDS = lut(*[(ord(c), ord(c)) for c in ".!?:;"])
TAIL_BYTE = lut((0x80, 0xBF))


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base counts, tree features) of each row."""
    rows = len(offsets) - 1
    starts, ends, row = word_spans(data, offsets)
    tally = lambda where, weights=None: np.bincount(where, weights, minlength=rows).astype(np.int64)
    of = lambda table: np.add.reduceat(np.append(table[data], False).astype(np.int64), np.minimum(offsets[:-1], len(data))) * (np.diff(offsets) > 0) if rows else np.zeros(0, np.int64)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~TAIL_BYTE[data], out=points[1:])
    n_words, word_chars = tally(row), tally(row, points[ends] - points[starts])
    # words in three-word windows that their row has twice or more
    h = span_hashes(data, starts, ends)
    covered = np.zeros(len(row), bool)
    distinct = np.zeros(rows, np.int64)
    if len(row):
        distinct = tally(row[np.unique(mix(h + row.astype(np.uint64) * MUL), return_index=True)[1]])
    if len(row) >= 3:
        g = gram_hashes(h, 3)
        at = np.flatnonzero(row[2:] == row[:-2])
        _, inverse, n = np.unique(mix(g[at] + row[at].astype(np.uint64) * MUL), return_inverse=True, return_counts=True)
        again = at[n[inverse] > 1]
        for j in range(3):
            covered[again + j] = True
    # lines with a word
    ls, le, lrow = word_spans(data, offsets, NEWLINE)
    held = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le, lrow = ls[held], le[held], lrow[held]
    lines = tally(lrow)
    once = np.unique(mix(span_hashes(data, ls, le) + lrow.astype(np.uint64) * MUL), return_index=True)[1]
    dup_lines = lines - tally(lrow[once])
    last = ends[np.searchsorted(starts, le) - 1] - 1 if len(le) else np.zeros(0, np.int64)
    ended = tally(lrow[ENDS[data[last]]]) if len(le) else np.zeros(rows, np.int64)
    repeat_words = tally(row[covered])
    counts = np.stack((n_words, word_chars, of(SYMBOLS), dup_lines, repeat_words), axis=1)
    w, c, ln = np.maximum(n_words, 1), np.maximum(word_chars, 1), np.maximum(lines, 1)
    features = np.stack((np.log1p(n_words), word_chars / w, counts[:, 2] / c, dup_lines / ln, repeat_words / w, distinct / w, n_words / ln,
        ended / ln, of(UPPER) / c, of(DIGIT) / c, 1 - np.minimum(of(LETTER & ~TAIL_BYTE), c) / c), axis=1)
    return counts, features


@dataclass
class Trees:
    """Node arrays of all trees: feature (-1: leaf), threshold, left child (right is next), value; roots by tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                f = self.feature[node]
                inner = f >= 0
                go = x[rows, np.maximum(f, 0)] > self.threshold[node]
                node = np.where(inner, self.left[node] + go, node)
            z += self.value[node]
        return 1 / (1 + np.exp(-z))


def grow(x: np.ndarray, y: np.ndarray, constraint: np.ndarray) -> Trees:
    """Boosted trees with logistic loss; with one class only, a constant score."""
    nodes: list[list[float]] = []
    share = float(np.clip(y.mean(), 1e-3, 0.999)) if len(y) else 0.999
    bias = float(np.log(share / (1 - share)))
    roots = []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1)
        z = np.full(len(y), bias)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            roots.append(len(nodes))
            nodes.append([])
            plant(nodes, roots[-1], np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-6), binned, cuts, constraint, -np.inf, np.inf, DEPTH, z)
    a = np.array(nodes).reshape(-1, 4)
    return Trees(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3], np.array(roots, int), bias)


def plant(nodes, at, rows, g, h, binned, cuts, constraint, low, high, depth, z) -> None:
    """Grow one node and what is below it; values stay between ``low`` and ``high`` so that constraints hold across levels."""
    value = lambda gs, hs: np.clip(-RATE * gs / (hs + 1.0), low, high)
    best = (1e-6, None)
    gt, ht = g[rows].sum(), h[rows].sum()
    if depth and len(rows) >= 2 * LEAST:
        for f in range(binned.shape[1]):
            m = len(cuts[f]) + 1
            b = binned[rows, f]
            gl, hl, nl = (np.cumsum(np.bincount(b, w, minlength=m))[:-1] for w in (g[rows], h[rows], None))
            if not len(gl):
                continue
            ok = (nl >= LEAST) & (len(rows) - nl >= LEAST)
            ok &= constraint[f] * (value(gt - gl, ht - hl) - value(gl, hl)) >= 0
            gain = np.where(ok, gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1), 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, k, gl[k], hl[k]))
    if best[1] is None:
        v = float(value(gt, ht))
        nodes[at] = [-1, 0.0, 0, v]
        z[rows] += v
        return
    f, k, gl, hl = best[1]
    left = len(nodes)
    nodes += [[], []]
    nodes[at] = [f, float(cuts[f][k]), left, 0.0]
    goes = binned[rows, f] > k
    mid = float((value(gl, hl) + value(gt - gl, ht - hl)) / 2)
    bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[int(constraint[f])]
    plant(nodes, left, rows[~goes], g, h, binned, cuts, constraint, *bounds[0], depth - 1, z)
    plant(nodes, left + 1, rows[goes], g, h, binned, cuts, constraint, *bounds[1], depth - 1, z)


def train(docs: DataFrame, labels: DataFrame) -> Trees:
    """Grow trees on at most MAX_LABELLED labelled texts, picked by a hash of their ids."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch):
                x = statistics(data, offsets)[1]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)], names=["x", "quality", "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", F.col("quality").cast("long").alias("quality"), "doc_id").mapInArrow(run, f"x array<double>, quality long, doc_id {kind}")
    # of rows that repeat a doc_id that with the smallest statistics counts, so the bound holds for texts too
    rows = texts.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("x")).select("x.*").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T)  # rows come in any order; sums of floats must not depend on it
    return grow(x[order], rows["quality"].to_numpy(float)[order], np.array(list(FEATURES.values())))


def score_quality(docs: DataFrame, trees: Trees, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and score of every row of ``docs`` (doc_id, text).

    base_failed: under 50 words, or more than half of the words lie in
    three-word windows that occur at least twice in the text. kept is false for
    those, else score >= ``keep_from``. A null text has no words. Whole texts
    are read whatever their length; rows stay one for one, equal texts score
    alike; an empty table gives no rows. Other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch):
                counts, x = statistics(data, offsets)
                score = held.value.scores(x)
                failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c) for c in counts.T.copy()), pa.array(failed),
                    pa.array(~failed & (score >= keep_from)), pa.array(score)], names=["doc_id", *COUNTS, "base_failed", "kept", "score"])

    longs = ", ".join(f"{c} long" for c in COUNTS)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {longs}, base_failed boolean, kept boolean, score double")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Grow the trees on ``labels`` (doc_id, quality) and judge every document."""
    return score_quality(docs, train(docs, labels))
