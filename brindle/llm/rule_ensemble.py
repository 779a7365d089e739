"""Quality by a sparse rule ensemble.

Boosted trees are grown over document statistics of a bounded labelled sample.
Every path from a root to a node is a rule, a conjunction of bounds on
statistics; a lasso-penalised logistic regression keeps few of the rules. What
is kept is compiled into Spark column expressions, so that a model can be read,
and a score is arithmetic of the query itself. The statistics are one numpy
pass over the texts; there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import text_slices
from brindle.llm.quality_rules import FEATURES, Trees, grow, statistics

#: Bound of the labelled sample that trees and weights are fitted on, in texts.
MAX_LABELLED = 12000
#: Rules that hold for less than this share of the sample, or for more than the rest, are no candidates.
LEAST_SUPPORT = 0.005
#: Penalties that are tried, as parts of the smallest one that leaves no rule; a fold of the sample decides.
PENALTIES = np.geomspace(0.5, 0.002, 12)
FOLDS = 4
#: A text is good from this score on.
THRESHOLD = 0.3

NAMES = list(FEATURES)
Condition = tuple[str, str, float]  # statistic, "<=" or ">", bound


@dataclass(frozen=True)
class Rule:
    """All ``conditions`` hold."""

    conditions: tuple[Condition, ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, op, bound in self.conditions:
            value = x[:, NAMES.index(name)]
            out &= value <= bound if op == "<=" else value > bound
        return out

    def column(self) -> Column:
        out = None
        for name, op, bound in self.conditions:
            one = F.col(name) <= F.lit(bound) if op == "<=" else F.col(name) > F.lit(bound)
            out = one if out is None else out & one
        return out

    def __str__(self) -> str:
        return " and ".join(f"{name} {op} {bound:.6g}" for name, op, bound in self.conditions)


@dataclass(frozen=True)
class RuleModel:
    """Rules with their weights, and a bias; a text's score is the logistic function of the sum of what holds."""

    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def column(self) -> Column:
        """The score, as an expression over the columns of the statistics."""
        z = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            z = z + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    def fired(self) -> Column:
        """How many rules hold."""
        n = F.lit(0)
        for rule in self.rules:
            n = n + rule.column().cast("int")
        return n

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            z += weight * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def lines(self) -> list[str]:
        """The model in words, the heaviest rule first."""
        order = np.argsort(-np.abs(self.weights), kind="stable") if self.rules else []
        return [f"{self.weights[i]:+.4f} if {self.rules[i]}" for i in order]


def paths(trees: Trees) -> list[Rule]:
    """A rule for every node below a root; of bounds on one statistic in one direction the tightest."""
    out: dict[Rule, None] = {}

    def go(node: int, bounds: dict[tuple[str, str], float]) -> None:
        if bounds:
            out[Rule(tuple((name, op, bound) for (name, op), bound in sorted(bounds.items())))] = None
        if trees.feature[node] >= 0:
            name, bound = NAMES[trees.feature[node]], float(trees.threshold[node])
            left = int(trees.left[node])
            go(left, bounds | {(name, "<="): min(bound, bounds.get((name, "<="), np.inf))})
            go(left + 1, bounds | {(name, ">"): max(bound, bounds.get((name, ">"), -np.inf))})

    for root in trees.roots:
        go(int(root), {})
    return list(out)


def candidates(rules: list[Rule], x: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """Rules that hold for neither too few nor too many texts, one (the shortest) for each set of texts, and where they hold."""
    best: dict[bytes, tuple[int, Rule, np.ndarray]] = {}
    for rule in rules:
        held = rule.holds(x)
        if LEAST_SUPPORT <= held.mean() <= 1 - LEAST_SUPPORT:
            key = np.packbits(held if held[0] else ~held).tobytes()  # a rule and its opposite say the same
            if key not in best or len(rule.conditions) < best[key][0]:
                best[key] = (len(rule.conditions), rule, held)
    kept = list(best.values())
    return [k[1] for k in kept], np.stack([k[2] for k in kept], axis=1).astype(float) if kept else np.zeros((len(x), 0))


def lasso(held: np.ndarray, y: np.ndarray, penalty: float, weights: np.ndarray | None = None, bias: float = 0.0, rounds: int = 400, close: float = 1e-7) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise mean logistic loss + penalty * sum of |weights|, by accelerated proximal steps."""
    n, m = held.shape
    w = np.zeros(m) if weights is None else weights.copy()
    both = np.column_stack((held, np.ones(n)))
    size = np.linalg.norm(both, 2) ** 2 / (4 * n) + 1e-12  # bounds the curvature
    theta = np.append(w, bias)
    ahead, pace = theta.copy(), 1.0
    for _ in range(rounds):
        grad = both.T @ (1 / (1 + np.exp(-np.clip(both @ ahead, -40, 40))) - y) / n
        new = ahead - grad / size
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - penalty / size, 0)
        if (ahead - new) @ (new - theta) > 0:  # overshot: start the momentum again
            pace = 1.0
        next_pace = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        ahead = new + (pace - 1) / next_pace * (new - theta)
        moved, theta, pace = np.abs(new - theta).max(), new, next_pace
        if moved < close:
            break
    return theta[:m], float(theta[m])


def loss(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z) - y * z


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Rules of trees over ``x`` with lasso weights for ``y``.

    The penalty is the largest whose loss on a fold that wasn't fitted is within
    one standard error of the best one's. One class only gives a constant score
    near it; no texts give 0.5.
    """
    share = float(np.clip(y.mean(), 1e-3, 0.999)) if len(y) else 0.5
    none = RuleModel((), (), float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return none
    rules, held = candidates(paths(grow(x, y, np.zeros(len(NAMES), int))), x)
    if not rules:
        return none
    most = np.abs(held.T @ (y - y.mean())).max() / len(y)
    penalty = most * PENALTIES[-1]
    test = np.arange(len(y)) % FOLDS == 0
    if 0 < y[~test].sum() < (~test).sum() and test.any():
        w, b, found = None, none.bias, []
        for part in PENALTIES:
            w, b = lasso(held[~test], y[~test], most * part, w, b)
            found.append(loss(held[test] @ w + b, y[test]))
        mean = np.array([f.mean() for f in found])
        best = int(mean.argmin())
        penalty = most * PENALTIES[int(np.flatnonzero(mean <= mean[best] + found[best].std() / np.sqrt(test.sum()))[0])]
    w, b = lasso(held, y, penalty, rounds=3000)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(tuple(rules[i] for i in kept), tuple(float(w[i]) for i in kept), b)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that no label is learnt from; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, the statistics NAMES) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch):
                x = statistics(data, offsets)[1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c) for c in x.T.copy())], names=["doc_id", *NAMES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} double" for c in NAMES))


def train(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> RuleModel:
    """Fit on at most ``bound`` labelled texts outside the held-out fold, picked by a hash of their ids.

    A repeated label counts once, as the smallest; of texts that repeat a
    doc_id that with the smallest statistics counts. Only statistics of the
    picked texts come to the driver.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)  # few enough to be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi")
    least = with_statistics(texts).groupBy("doc_id").agg(F.min(F.struct(*NAMES)).alias("s"))
    rows = least.join(F.broadcast(picked), "doc_id").select("doc_id", "s.*", "quality").toPandas().sort_values("doc_id")
    return fit(rows[NAMES].to_numpy(float), (rows["quality"] == 1).to_numpy(float))


def score_rules(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= ``threshold``) and n_rules (rules that hold) of every row.

    Only the text is an input of a score. A null text scores as an empty one.
    Rows stay one for one: repeated ids or texts give repeated results, a null
    id keeps its row outside the held-out fold. Texts are read whole; other
    columns are not read; an empty table gives no rows.
    """
    scored = with_statistics(docs).withColumns({"score": model.column(), "n_rules": model.fired()})
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_rules")


def rule_ensemble(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Fit rules to the labels outside the held-out fold and score every document."""
    return score_rules(docs, train(docs, labels), threshold)
