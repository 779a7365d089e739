"""Toxicity by non-negative positive-unlabelled learning.

A text's features are the whole words and the byte runs inside words that it
has, each once. Of all hashed features those that tell confirmed toxic texts
from unlabelled ones best are kept, and a logistic model over them is fitted
in numpy under the non-negative class-prior-corrected risk

    prior * R(P, +1) + max(0, R(U, -1) - prior * R(P, -1)).

The fit sees a bounded sample; scoring is one scan of whole texts without a
shuffle, and the model that goes to the tasks has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import LOWER, list_array, lut, mix, span_hashes, text_slices, word_spans, work_dir, written

#: Bounds of the sample that the model is fitted on, in texts.
MAX_POSITIVE = 3000
MAX_UNLABELLED = 6000
#: Hash slots of features, and how many of them the model keeps.
SLOT_BITS = 20
KEPT_FEATURES = 400
#: A feature is looked at from this number of texts on.
LEAST_TEXTS = 3
#: Lengths in bytes of the runs inside words.
RUNS = (5, 7)
#: A text is toxic from this score on.
THRESHOLD = 0.3

#: Everything but ASCII letters, digits and the bytes of other letters ends a word.
NOT_WORD = ~(lut((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)))


@dataclass
class ToxicModel:
    """slot: feature number + 1 of each hash slot, 0 for none; weight by feature; bias."""

    slot: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, feature = self.present(data, offsets)
        z = np.bincount(row, self.weight[feature], minlength=len(offsets) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def present(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) of the model's features that each row has, each once."""
        found = [np.zeros(0, np.int64)]
        for row, slot in hashed(data, offsets):
            f = self.slot[slot]
            hit = np.flatnonzero(f)
            found.append(row[hit].astype(np.int64) * (KEPT_FEATURES + 1) + f[hit])
        both = np.unique(np.concatenate(found))
        return both // (KEPT_FEATURES + 1), both % (KEPT_FEATURES + 1) - 1


def hashed(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, slot) of whole words, then of the byte runs of each length."""
    data = LOWER[data]
    starts, ends, row = word_spans(data, offsets, NOT_WORD)
    shift = np.uint64(64 - SLOT_BITS)
    yield row, (span_hashes(data, starts, ends) >> shift).view(np.int64)
    size = ends - starts
    for n in RUNS:
        m = np.maximum(size - n + 1, 0)
        first = np.repeat(starts - np.cumsum(m) + m, m) + np.arange(m.sum())
        yield np.repeat(row, m), (mix(span_hashes(data, first, first + n) + np.uint64(n)) >> shift).view(np.int64)


def held_out(id_col: str = "doc_id") -> F.Column:
    """The fold that no label is learnt from; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(kind: 1 toxic, 0 unlabelled; slots: the hashed features of a text) of the bounded sample, and the share of toxic labels.

    Features are extracted where the texts are; of rows that repeat a doc_id
    that with the smallest features is taken.
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    learn = known.where(~held_out() & F.col("toxic").isNotNull())
    prior = learn.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    some = lambda rows, n: rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    toxic = some(learn.where("toxic = 1"), MAX_POSITIVE).withColumn("kind", F.lit(1))
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out()).distinct()
    rest = some(ids.join(known.select("doc_id"), "doc_id", "left_anti"), MAX_UNLABELLED).withColumn("kind", F.lit(0))
    picked = F.broadcast(toxic.unionByName(rest))  # at most MAX_POSITIVE + MAX_UNLABELLED ids
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch):
                slots = list_array(slots_of(data, offsets), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), slots], names=["doc_id", "kind", "slots"])

    rows = docs.select("doc_id", "text").join(picked, "doc_id").select("doc_id", "text", "kind").mapInArrow(run, f"doc_id {kind}, kind int, slots array<int>")
    # arrays compare, so of repeated ids the same text is taken each time
    return rows.groupBy("doc_id").agg(F.min(F.struct("kind", "slots")).alias("x")).select("x.*"), prior


def slots_of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Distinct slots of each row."""
    both = np.unique(np.concatenate([row.astype(np.int64) << SLOT_BITS | slot for row, slot in hashed(data, offsets)]))
    cuts = np.searchsorted(both >> SLOT_BITS, np.arange(1, len(offsets) - 1))
    return np.split((both & ((1 << SLOT_BITS) - 1)).astype(np.int32), cuts)


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> ToxicModel:
    """Fit on confirmed toxic texts and unlabelled ones outside the held-out fold.

    ``prior`` is the share of toxic texts; by default that of the labelled rows
    outside the fold. Without a toxic example the model scores every text 0.
    What comes to the driver is bounded: a count for each hash slot, and for
    each text of the sample which of the kept features it has.
    """
    rows, share = sample(docs, labels)
    rows = written(rows, f"{work_dir(docs.sparkSession)}/sample")
    n = dict(rows.groupBy("kind").agg(F.count("*")).collect())
    of = lambda k: F.count_if(F.col("kind") == k).alias(f"in_{k}")
    counts = rows.select("kind", F.explode("slots").alias("slot")).groupBy("slot").agg(of(1), of(0)).where(F.col("in_0") + F.col("in_1") >= LEAST_TEXTS).toPandas()
    in_p, in_u = (counts[c].to_numpy(np.int64) for c in ("in_1", "in_0"))
    best = counts["slot"].to_numpy(np.int64)[chosen(in_p, in_u, n.get(1, 0), n.get(0, 0))]
    kept = F.array_intersect("slots", F.lit([int(x) for x in best]).cast("array<int>"))
    table = rows.select("kind", kept.alias("slots")).toArrow()
    return fit_slots(table.column("kind").to_numpy(), [np.array(x, np.int64) for x in table.column("slots").to_pylist()], best, share if prior is None else prior)


def fit(rows: pa.Table, prior: float) -> ToxicModel:
    """Fit on a local table (text, kind)."""
    slots: list[np.ndarray] = []
    for batch in rows.to_batches():
        for _, _, data, offsets in text_slices(batch):
            slots += slots_of(data, offsets)
    kind = rows.column(1).to_numpy()
    counts = [np.bincount(np.concatenate([s for s, k in zip(slots, kind, strict=True) if k == c] or [np.zeros(0, np.int64)]), minlength=1 << SLOT_BITS) for c in (1, 0)]
    seen = np.flatnonzero(counts[0] + counts[1] >= LEAST_TEXTS)
    best = seen[chosen(counts[0][seen], counts[1][seen], int((kind == 1).sum()), int((kind == 0).sum()))]
    return fit_slots(kind, slots, best, prior)


def chosen(in_p: np.ndarray, in_u: np.ndarray, p: int, u: int) -> np.ndarray:
    """Places of the features that the model keeps, the most telling first."""
    if not p or not len(in_p):
        return np.zeros(0, np.int64)
    gain = evidence(in_p, in_u, p, u)
    # as many features as are looked at may stand out by chance; what doesn't stand out more is noise
    order = np.argsort(-gain, kind="stable")[:KEPT_FEATURES]
    return order[gain[order] >= max(1.0, np.log(len(gain)))]


def fit_slots(kind: np.ndarray, slots: list[np.ndarray], best: np.ndarray, prior: float) -> ToxicModel:
    """The model over the features ``best``, of texts given by their slots."""
    slot = np.zeros(1 << SLOT_BITS, np.int16)
    slot[best] = np.arange(1, len(best) + 1)
    if not (kind == 1).any():
        return ToxicModel(slot * 0, np.zeros(1), -40.0)
    row = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    feature = slot[np.concatenate(slots)].astype(np.int64) if len(row) else np.zeros(0, np.int64)
    hit = feature > 0
    weight, bias = descend(row[hit], feature[hit] - 1, kind == 1, prior)
    return ToxicModel(slot, weight, bias)


def evidence(in_p: np.ndarray, in_u: np.ndarray, p: int, u: int) -> np.ndarray:
    """Log-likelihood ratio of different rates of a feature in ``p`` toxic and ``u`` unlabelled texts against one common rate."""
    n, share = in_p + in_u, p / (p + u)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(in_p > 0, in_p * np.log(in_p / (n * share)), 0) + np.where(in_u > 0, in_u * np.log(in_u / (n * (1 - share))), 0)
    return np.nan_to_num(ratio)


def descend(row: np.ndarray, feature: np.ndarray, positive: np.ndarray, prior: float, rounds: int = 300, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias under the non-negative risk with logistic loss, by full-batch Adam steps.

    The fewer toxic texts there are, the more the weights are held back. The
    bias is set last, so that the unlabelled texts' mean score is the prior.
    """
    n, p = len(positive), max(1, int(positive.sum()))
    u = max(1, n - p)
    prior, l2 = min(max(prior, 1e-3), 0.999), 0.1 / p
    theta = np.zeros(KEPT_FEATURES + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        z = np.bincount(row, theta[feature], minlength=n) + theta[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        loss_neg = np.logaddexp(0, z)
        negative = loss_neg[~positive].sum() / u - prior * loss_neg[positive].sum() / p
        g = np.zeros(n)
        g[positive] = prior * (s[positive] - 1) / p
        if negative >= 0:
            g[positive] -= prior * s[positive] / p
            g[~positive] = s[~positive] / u
        # the part below zero is overfitting: it counts as zero
        grad = np.append(np.bincount(feature, g[row], minlength=KEPT_FEATURES), g.sum())
        grad[:-1] += l2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    z = np.bincount(row, theta[feature], minlength=n)[~positive]
    low, high = -40.0, 40.0
    for _ in range(60 if len(z) else 0):
        middle = (low + high) / 2
        low, high = (middle, high) if (1 / (1 + np.exp(-np.clip(z + middle, -40, 40)))).mean() < prior else (low, middle)
    return theta[:-1].copy(), low if len(z) else float(theta[-1])


def score_toxicity(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= ``threshold``) of every row.

    Only the text is an input of the score. A null text scores as an empty one.
    Every row keeps its place: repeated ids or texts give repeated results, a
    null id keeps its row outside the held-out fold. Texts are read whole; an
    empty table gives no rows. Other columns aren't read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(held.value.scores(data, offsets))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Train on the labels outside the held-out fold and score every document."""
    return score_toxicity(docs, train(docs, labels), threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Those rows of ``docs``, with all their columns, that score below ``threshold``.

    Each row goes by its own text, whatever its id; a null or empty text scores
    as an empty one, and null ids stay as far as their texts do.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch):
                yield batch.slice(a, b - a).filter(pa.array(held.value.scores(data, offsets) < threshold))

    return docs.mapInArrow(run, docs.schema)
