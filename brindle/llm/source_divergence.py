"""Audit of how far the sources of a language differ in their terms.

Terms are counted in the tasks by ``PackedTerms`` (short terms as numbers that
are radix-sorted and run-counted, long ones in byte-sorted buckets), then by
one shuffle on (lang, term), which serves the sum per source as well as the
document frequency that decides which terms are kept. Divergences between
sources are sums over terms: each task takes the terms of one hash bucket and
two blocks of sources, and only sums of pairs of sources leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import LOWER, drop_dir, hot_join, lut, text_slices, word_spans, work_dir, written
from brindle.llm.packed_terms import PackedTerms

#: A language keeps terms that at least so many of its documents have.
LEAST_DOCS = 10
#: Terms of a group that the audit lists.
TOP_TERMS = 10
#: Occurrences that a task holds before it counts them.
FLUSH_TERMS = 3_000_000
#: Hash buckets of terms, and sources in a block, of the work on pairs.
BUCKETS, BLOCK = 64, 256
#: Terms that are compared at once.
STEP = 2048

#: Everything but ASCII letters and the bytes of other characters ends a term.
NOT_TERM = ~lut((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
COUNTS = "lang string, source string, term string, n long, n_docs long"
PAIRS = "lang string, source string, item string, value long, rest long, kept long"


def group_counts(docs: DataFrame, flush: int) -> DataFrame:
    """Occurrences and documents of each (lang, source, term), partly summed: a row for each ``flush`` terms of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            names = [pa.array([k[i] for k in groups], pa.string()) for i in (0, 1)]
            for term, group, n, n_docs in terms.runs(np.array(of, np.int64)):
                at = pa.array(group)
                yield pa.RecordBatch.from_arrays([names[0].take(at), names[1].take(at), term, pa.array(n), pa.array(n_docs)], names=["lang", "source", "term", "n", "n_docs"])

        terms, groups, of = PackedTerms(), {}, []
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for a, b, data, offsets in text_slices(batch):
                data = LOWER[data]
                starts, ends, row = word_spans(data, offsets, NOT_TERM)
                terms.add(data, starts, ends, row + len(of))
                of += [groups.setdefault(k, len(groups)) for k in keys[a:b]]
                if terms.size >= flush:
                    yield from out()
                    terms, groups, of = PackedTerms(), {}, []
        yield from out()

    return docs.mapInArrow(run, COUNTS)


def per_billion(n: Column, total: Column) -> Column:
    """1 + floor(10^9 * n / total) for 0 <= n <= total < 2^53, by long division in steps of three digits, so that nothing overflows."""
    out, rest = F.lit(1).cast("long"), n
    for scale in (1_000_000, 1_000, 1):
        out = out + div(rest * 1000, total) * scale
        rest = (rest * 1000) % total
    return out


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    return div((p - q) * (p - q), p + q)


def kept_terms(docs: DataFrame, least_docs: int, flush: int = FLUSH_TERMS) -> DataFrame:
    """(lang, term, source, n, lang_n, first): counts of kept terms; ``first`` marks one row a term of the language."""
    # the shuffle on (lang, term) serves the grouping and the window
    counts = group_counts(docs, flush).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    term = Window.partitionBy("lang", "term")
    return (
        counts.withColumns({"lang_n": F.sum("n").over(term), "lang_docs": F.sum("n_docs").over(term), "first": (F.min("source").over(term) == F.col("source")).cast("int")})
        .where(F.col("lang_docs") >= least_docs)
        .drop("n_docs", "lang_docs")
    )


def groups_of(docs: DataFrame, kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, lang, source, size, mass, kept, lang_mass, number, blocks) of every (lang, source) of ``docs``.

    ``size`` is the group's number of kept terms with a count, ``kept`` its
    language's number of kept terms, ``mass`` and ``lang_mass`` are N + 2 * V
    of the group and of the language, ``number`` counts the sources of the
    language from 0, ``blocks`` is the number of its blocks.
    """
    some = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("size"), F.sum("first").alias("first"))
    every = docs.select("lang", "source").distinct().join(some, ["lang", "source"], "left")
    lang = Window.partitionBy("lang")
    whole = lambda c: F.coalesce(F.sum(c).over(lang), F.lit(0))
    every = every.withColumns({"kept": whole("first"), "lang_total": whole("total"), "number": F.row_number().over(lang.orderBy("source")) - 1, "sources": F.count("*").over(lang)})
    return every.select(group_key().alias("key"), "lang", "source", F.coalesce("size", F.lit(0)).alias("size"), (F.coalesce("total", F.lit(0)) + 2 * F.col("kept")).alias("mass"),
        "kept", (F.col("lang_total") + 2 * F.col("kept")).alias("lang_mass"), "number", F.ceil(F.col("sources") / block).cast("int").alias("blocks"))


def group_key() -> Column:
    """One string a (lang, source), different for each."""
    return F.concat(F.length("lang").cast("string"), F.lit(":"), F.col("lang"), F.col("source"))


def pair_sums(placed: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """Divergence of every two sources of a language, summed over all kept terms.

    A row goes to each pair of blocks that its source's block is in. In a task
    the counts of some terms are a matrix of terms by sources, filled with the
    share of a count of 0 (``none``); terms that a task doesn't see have count 0
    in both sources, and are added by their number.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    own = div(F.col("number"), F.lit(block)).cast("int")
    ends = [F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")]
    zero = F.when(F.col("mass") > 0, per_billion(F.lit(2).cast("long"), F.col("mass"))).otherwise(F.lit(1)).cast("long")
    rows = placed.select("lang", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket"), own.alias("own"), other, "term", "number", F.lit(None).cast("string").alias("source"), "p", F.lit(0).cast("long").alias("kept"))
    # every source is told to every task of its blocks, before the terms
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("bucket"), own.alias("own"), "blocks", "number", "source", zero.alias("p"), "kept")
    heads = heads.select("lang", "bucket", "own", other, F.lit(None).cast("string").alias("term"), "number", "source", "p", "kept")
    keys = ["lang", "low", "high", "bucket"]
    rows = rows.unionByName(heads).select("lang", *ends, "bucket", "term", "number", "source", "p", "kept").repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_first("term"), "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, task, rest = None, None, None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = (pa.concat_tables([rest, t]) if rest is not None else t).combine_chunks()
            if not t.num_rows:
                continue
            column = lambda name: t.column(name).combine_chunks()  # noqa: B023, E731
            edge, new = np.ones(t.num_rows, bool), np.ones(t.num_rows, bool)
            edge[1:] = np.any([pc.not_equal(column(k)[1:], column(k)[:-1]).to_numpy(zero_copy_only=False) for k in keys], axis=0)
            term = column("term")
            new[1:] = edge[1:] | ~pc.fill_null(pc.equal(term[1:], term[:-1]), False).to_numpy(zero_copy_only=False)
            upto, rest = t.num_rows, None
            if term[-1].is_valid:  # the last term may go on in the next batch
                upto = int(np.flatnonzero(new)[-1])
                rest = t.slice(upto)
            number, p, kept = (column(c).to_numpy() for c in ("number", "p", "kept"))
            head = term.is_null().to_numpy(zero_copy_only=False)
            cuts = [*np.flatnonzero(edge[:upto]).tolist(), upto]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(t.column(k)[a].as_py() for k in keys)
                if key != now:
                    if task is not None:
                        yield from task.sums()
                    now, task = key, PairTask(*key[:3], block)
                h, r = a + np.flatnonzero(head[a:b]), a + np.flatnonzero(~head[a:b])
                task.sources(number[h], column("source").take(pa.array(h)).to_pylist(), p[h], kept[h])
                task.terms(np.cumsum(new[r]) - 1, number[r], p[r])
        if rest is not None:
            key = tuple(rest.column(k)[0].as_py() for k in keys)
            if key != now:  # every task of terms has its sources before them, and these aren't held back
                raise RuntimeError("terms came before their sources")
            task.terms(np.zeros(rest.num_rows, np.int64), rest.column("number").to_numpy(), rest.column("p").to_numpy())
        if task is not None:
            yield from task.sums()

    sums = rows.mapInArrow(run, PAIRS)
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.max("rest").alias("rest"), F.max("kept").alias("kept"))
    return sums.select("lang", "source", "item", (F.col("value") + F.col("kept") * F.col("rest")).alias("value"))


class PairTask:
    """Sums over some terms for the pairs of sources of one block, or of two different blocks."""

    def __init__(self, lang: str, low: int, high: int, block: int):
        self.lang, self.across, self.edge = lang, low != high, high * block
        self.number, self.name, self.zero = np.zeros(0, np.int64), [], np.zeros(0, np.int64)
        self.kept, self.seen, self.total = 0, 0, None

    def sources(self, number: np.ndarray, name: list[str], zero: np.ndarray, kept: np.ndarray) -> None:
        """Sources by rising number, with their share of a count of 0 and their language's number of kept terms."""
        if len(number):
            self.number, self.name, self.zero, self.kept = np.append(self.number, number), self.name + name, np.append(self.zero, zero), int(kept.max())

    def others(self, i: int) -> int:
        """From this place on are the partners of source ``i``."""
        return int(np.searchsorted(self.number, self.edge)) if self.across else i + 1

    def terms(self, term: np.ndarray, number: np.ndarray, p: np.ndarray) -> None:
        """Rows (term, source, share) of whole terms; ``term`` counts from 0."""
        if not len(term):
            return
        n = len(self.number)
        if self.total is None:
            self.total = np.zeros((n, n), np.int64)
        place = np.searchsorted(self.number, number)
        first = n if not self.across else self.others(0)
        for a in range(0, int(term[-1]) + 1, STEP):
            lo, hi = np.searchsorted(term, (a, a + STEP))
            share = np.tile(self.zero[:, None], (1, int(term[hi - 1]) - a + 1))
            share[place[lo:hi], term[lo:hi] - a] = p[lo:hi]
            self.seen += share.shape[1]
            for i in range(first):
                x, y = share[i], share[self.others(i) :]
                self.total[i, self.others(i) :] += ((y - x) ** 2 // (y + x)).sum(axis=1)

    def sums(self) -> Iterator[pa.RecordBatch]:
        n = len(self.number)
        rest = (self.zero[:, None] - self.zero) ** 2 // (self.zero[:, None] + self.zero)
        i, j = np.triu_indices(n, 1)
        if self.across:
            two = (self.number[i] < self.edge) & (self.number[j] >= self.edge)
            i, j = i[two], j[two]
        if not len(i):
            return
        names, rest = pa.array(self.name, pa.string()), rest[i, j]
        value = (0 if self.total is None else self.total[i, j]) - self.seen * rest
        for a, b in ((i, j), (j, i)):
            yield pa.RecordBatch.from_arrays([pa.array([self.lang] * len(a), pa.string()), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(value), pa.array(rest), pa.array(np.full(len(a), self.kept, np.int64))],
                names=["lang", "source", "item", "value", "rest", "kept"])


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, flush: int = FLUSH_TERMS, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others of its language, and by which terms.

    A language keeps the terms of at least ``least_docs`` of its rows. A group
    (lang, source), or a whole language, with N occurrences of the V kept terms
    gives each p = 1 + floor(10^9 * (count + 2) / (N + 2 * V)); two shares
    differ by floor((p - q)^2 / (p + q)). Part ``pair``: every other source of
    the language, with the sum over all kept terms, 0 where there are none.
    Part ``term``: the ``top`` kept terms that the group has with a higher share
    than the language. A task counts ``flush`` occurrences at once; pairs are
    made by ``block`` sources. Ranks go by falling value, ties by the item's bytes.

    Null text, lang and source are empty strings. Every row is a document,
    whatever its doc_id, which is not read; repeated rows count as often as
    they occur. Texts are read whole. Other columns are not read; an empty
    table gives no rows. All arithmetic is exact, for up to 2^53 occurrences.
    """
    spark = docs.sparkSession
    base = work_dir(spark)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = written(kept_terms(docs, least_docs, flush), f"{base}/kept")
    groups = written(groups_of(docs, kept, block), f"{base}/groups")
    keyed = kept.withColumn("key", group_key()).drop("lang", "source")
    placed = hot_join(keyed, groups, "key", "size")
    placed = placed.select("lang", "source", "term", "number", "blocks", "lang_mass", "lang_n", per_billion(F.col("n") + 2, F.col("mass")).alias("p"))
    rank = lambda: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    more = placed.withColumn("q", per_billion(F.col("lang_n") + 2, F.col("lang_mass"))).where("p > q")
    terms = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value")).withColumn("rank", rank()).where(F.col("rank") <= top)
    sums = written(pair_sums(placed, groups, block), f"{base}/pairs")
    terms = written(terms, f"{base}/terms")
    for name in ("kept", "groups"):
        drop_dir(spark, f"{base}/{name}")
    pairs = sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank())
    return pairs.unionByName(terms)
