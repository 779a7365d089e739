"""Substring deduplication by content-defined chunking with a gear rolling hash.

A text's words are cut into chunks of varying length: a chunk begins where the
gear hash of the next words is the smallest of a neighbourhood. Cuts depend on
the words around them only, so words inserted before a passage shift it but
don't change its chunks. Chunks meet by digest over the whole corpus. Where a
chunk stands at several places, the windows of 51 words around it meet by
digest too, and windows that follow each other here and in an earlier document
are a repeated passage.

Any 51 words in a row hold a whole chunk that depends on them alone, so no
passage of over 50 words is missed, and the windows decide exactly: none is
made up, save by a collision of 96-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import MUL, SPACE, _spans, drop_dir, hot_join, mix, release, small, span_hashes, text_slices, word_spans, work_dir, written

#: Words of the shortest repeated passage: over 50.
LEAST_WORDS = 51
#: Words in the gear hash.
GEAR_WORDS = 16
#: Hash ranges of windows that are joined one after another, so that only one's rows are on disk.
PASSES = 4
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def gear(value: np.ndarray) -> np.ndarray:
    """Rolling gear hash of the GEAR_WORDS values from each place on, each shifted by how far it is from the last."""
    h, span = value, 1
    while span < GEAR_WORDS:
        h = h[:-span] * np.uint64(1 << span) + h[span:]
        span *= 2
    return np.append(h, np.full(len(value) - len(h), TOP))


def window_min(h: np.ndarray, n: int) -> np.ndarray:
    """Minimum of the n values from each place on."""
    span, m = 1, h
    while span * 2 <= n:
        m = np.minimum(m, np.append(m[span:], np.full(span, TOP)))
        span *= 2
    rest = n - span
    return np.minimum(m, np.append(m[rest:], np.full(rest, TOP))) if rest else m


class Chunks:
    """Chunks of the words (hashes) of several rows; ``row`` is each word's row.

    ``first``: windows of ``least_words`` words of one row, by their first word.
    ``chunk``: the first word of the chunk that each window holds. A window's
    first cut is the last of the smallest gear hashes that begin early in it,
    and the chunk goes on to the next cut; both depend on the window's words
    only, as 2 * reach + GEAR_WORDS words are no more than the window has.
    """

    def __init__(self, words: np.ndarray, row: np.ndarray, least_words: int):
        self.words, self.least_words = words, least_words
        self.reach = (least_words + 1 - GEAR_WORDS) // 2
        if self.reach < 1:
            raise ValueError(f"passages have {GEAR_WORDS + 1} words at least")
        need = self.reach + GEAR_WORDS - 1
        self.first = self.chunk = self.cuts = np.zeros(0, np.int64)
        if len(words) < least_words:
            return
        h = gear(words)
        n = len(words) - need + 1
        least = window_min(h, self.reach)[:n]
        at = np.zeros(n, np.int64)
        for d in range(self.reach):
            at[h[d : d + n] == least] = d
        whole = row[:n] == row[need - 1 :]
        cut = np.arange(n) + at
        marked = np.zeros(len(words), bool)
        marked[cut[whole]] = True
        self.cuts = np.flatnonzero(marked)
        self.first = np.flatnonzero(row[: len(words) - least_words + 1] == row[least_words - 1 :])
        self.chunk = cut[self.first]

    def digests(self, chunk: np.ndarray) -> np.ndarray:
        """Hash of each chunk's words and those in the gear hash of its end."""
        end = self.cuts[np.searchsorted(self.cuts, chunk, "right")]
        return _spans(self.words, chunk, end + GEAR_WORDS)

    def windows(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of each window, of 64 and 32 bits."""
        other = _spans(mix(self.words + MUL), first, first + self.least_words)
        return _spans(self.words, first, first + self.least_words), (other >> np.uint64(32)).astype(np.uint32)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, tie and text: rows that repeat a doc_id, or have none, are told apart by a hash of their texts; tie is 0 for others."""
    unique = docs.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("n")).where("n > 1 or __id is null").select("__id", F.lit(True).alias("__twice"))
    both = docs.select("doc_id", "text").join(small(unique), F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return both.select("doc_id", F.when(F.col("__twice"), text_hash()).otherwise(F.lit(0)).cast("long").alias("tie"), "text")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def beside(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """``left`` with the columns of ``right``, which has each doc_id (null too) and tie once."""
    r = right.withColumnsRenamed({"doc_id": "__id", "tie": "__tie"})
    return left.join(r, left["doc_id"].eqNullSafe(r["__id"]) & (left["tie"] == r["__tie"]), how).drop("__id", "__tie")


def taken(batch: pa.RecordBatch, a: int, b: int, row: np.ndarray) -> list[pa.Array]:
    return [batch.column(i).slice(a, b - a).take(pa.array(row)) for i in (0, 1)]


def chunk_table(docs: DataFrame, least_words: int) -> DataFrame:
    """(digest, doc_id, tie, place) of every chunk that a window holds; place is the number of its first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch):
                first, last, row = word_spans(data, offsets, SPACE)
                cut = Chunks(span_hashes(data, first, last), row, least_words)
                chunk = np.unique(cut.chunk)
                place = chunk - np.searchsorted(row, row[chunk])
                yield pa.RecordBatch.from_arrays([pa.array(cut.digests(chunk).view(np.int64)), *taken(batch, a, b, row[chunk]),
                    pa.array(place.astype(np.int32))], names=["digest", "doc_id", "tie", "place"])

    return docs.mapInArrow(run, "digest long, doc_id long, tie long, place int")


def window_table(docs: DataFrame, least_words: int) -> DataFrame:
    """(digest, more, doc_id, tie, place) of the windows whose chunk is in ``places``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
            for a, b, data, offsets in text_slices(batch):
                first, last, row = word_spans(data, offsets, SPACE)
                cut = Chunks(span_hashes(data, first, last), row, least_words)
                begin = np.searchsorted(row, np.arange(b - a))
                known = np.zeros(len(first) + 1, bool)
                size = ends[a + 1 : b + 1] - ends[a:b]
                known[np.minimum(flat[ends[a] : ends[b]] + np.repeat(begin, size), len(first))] = True
                windows = cut.first[known[cut.chunk]]
                digest, more = cut.windows(windows)
                place = windows - begin[row[windows]]
                yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), pa.array(more.view(np.int32)), *taken(batch, a, b, row[windows]),
                    pa.array(place.astype(np.int32))], names=["digest", "more", "doc_id", "tie", "place"])

    return docs.select("doc_id", "tie", "text", "places").mapInArrow(run, "digest long, more int, doc_id long, tie long, place int")


def passages(docs: DataFrame, least_words: int, within: bool) -> DataFrame:
    """(doc_id, tie, first_word, n_words, first_doc_id, n_docs) of the repeated passages of ``keyed`` documents."""
    spark = docs.sparkSession
    base = work_dir(spark)
    # windows are hashed one by one only where their chunk stands at several places
    table = written(chunk_table(docs, least_words), f"{base}/chunks")
    shared = written(table.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), f"{base}/shared")
    places = written(hot_join(table, shared, "digest", "n").groupBy("doc_id", "tie").agg(F.collect_list("place").alias("places")), f"{base}/places")
    drop_dir(spark, f"{base}/chunks")
    del table, shared
    release(spark)
    windows = written(window_table(beside(docs, places, "inner"), least_words), f"{base}/windows")
    del places
    release(spark)
    later_doc = F.struct("doc_id", "tie") > F.struct(F.col("first_doc_id").alias("doc_id"), F.col("first_tie").alias("tie"))
    later_place = F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("tie") == F.col("first_tie")) & (F.col("place") >= F.col("first_place") + least_words)
    again = later_doc | later_place if within else later_doc
    columns = ["doc_id", "tie", "place", "first_doc_id", "first_tie", (F.col("first_place") - F.col("place")).alias("shift"), "n"]
    for i in range(PASSES):
        part = windows.where(F.pmod("digest", F.lit(PASSES)) == i)
        source = part.groupBy("digest", "more").agg(F.min(F.struct("doc_id", "tie", "place")).alias("first"), F.count("*").alias("n")).where("n > 1")
        source = written(source.select("digest", F.col("more").alias("more2"), F.col("first.doc_id").alias("first_doc_id"),
            F.col("first.tie").alias("first_tie"), F.col("first.place").alias("first_place"), "n"), f"{base}/source{i}")
        later = hot_join(part, source, "digest", "n").where("more = more2").where(again).select(*columns)
        later = written(later, f"{base}/later/pass={i}")
        drop_dir(spark, f"{base}/source{i}")
        del part, source
        release(spark)
    drop_dir(spark, f"{base}/windows")
    later = spark.read.schema(later.schema).parquet(*[f"{base}/later/pass={i}" for i in range(PASSES)])
    # windows that follow each other here and in their source are one passage
    row = Window.partitionBy("doc_id", "tie").orderBy("first_doc_id", "first_tie", "shift", "place")
    before = lambda c: F.lag(c).over(row)
    follows = before("first_doc_id").eqNullSafe(F.col("first_doc_id")) & (before("first_tie") == F.col("first_tie")) & (before("shift") == F.col("shift")) & (F.col("place") - before("place") <= 1)
    runs = later.withColumn("fresh", F.coalesce((~follows).cast("int"), F.lit(1))).withColumn("run", F.sum("fresh").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy("doc_id", "tie", "run").agg(F.min("place").alias("first_word"),
        (F.max("place") - F.min("place") + least_words).cast("long").alias("n_words"), F.min("first_doc_id").alias("first_doc_id"),
        F.max("n").alias("n_docs"))
    return found.drop("run")


def repeated_spans(docs: DataFrame, least_words: int = LEAST_WORDS, within: bool = False) -> DataFrame:
    """(doc_id, start, stop, n_words, first_doc_id, n_docs) of passages of ``least_words`` words or more that an earlier document has too.

    Every window of ``least_words`` words that stands in an earlier document is
    in a passage, and each passage stands word for word in document
    first_doc_id, the smallest that has its windows; passages with different
    sources may overlap. White space between words doesn't count. start and
    stop are byte places in the document's UTF-8 text, n_docs is how many
    places of the corpus a window of the passage has at most. The document with
    the smallest id keeps its passage and isn't listed for it. With ``within``
    later places in the same document count too, if they don't overlap the
    first; first_doc_id is then the document itself.

    Rows that repeat a doc_id are documents of their own, ordered by a hash of
    their texts; those that repeat its text too count as one. A null doc_id
    comes before all others. Null and empty texts have no passages, long ones
    are read whole, an empty table gives no rows. Other columns are not read.
    """
    docs = keyed(docs)
    spans = passages(docs, least_words, within).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("first_word", "n_words", "first_doc_id", "n_docs")).alias("spans"))
    spans = written(spans, f"{work_dir(docs.sparkSession)}/spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch):
                first, last, row = word_spans(data, offsets, SPACE)
                lists = batch.column(3).slice(a, b - a)
                span, of = lists.flatten(), np.repeat(np.arange(b - a), lists.value_lengths().to_numpy(zero_copy_only=False))
                word, size, source, n = (span.field(i) for i in range(4))
                at = word.to_numpy(zero_copy_only=False) + np.searchsorted(row, of)
                start, stop = first[at] - offsets[of], last[at + size.to_numpy(zero_copy_only=False) - 1] - offsets[of]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(of)), pa.array(start), pa.array(stop), size, source,
                    n], names=["doc_id", "start", "stop", "n_words", "first_doc_id", "n_docs"])

    hit = beside(docs, spans, "inner").select("doc_id", "tie", "text", "spans")
    return hit.mapInArrow(run, "doc_id long, start long, stop long, n_words long, first_doc_id long, n_docs long")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` (first word, number of words) and what lies between them."""
    raw = np.frombuffer(text.encode(), np.uint8)
    first, last, _ = word_spans(raw, np.array([0, len(raw)]))
    keep = np.ones(len(raw), bool)
    for word, size in spans:
        keep[first[word] : last[word + size - 1]] = False
    return raw[keep].tobytes().decode()


def remove_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, within: bool = False) -> DataFrame:
    """``docs`` without the repeated passages of all but their first document, or with ``within`` of all but their first place.

    All columns stay; n_chars, where there is one, follows the text. A document
    that has no word left goes; one that had none before stays as it is. Each
    row is cut by its own text, also where it repeats a doc_id or has none; a
    row that repeats the text too is cut like it, and stays.
    """
    names, schema = docs.columns, docs.schema
    tied = keyed(docs)
    spans = passages(tied, least_words, within).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("first_word", "n_words")).alias("spans"))
    free = max([*names, "_"], key=len) + "_"  # longer than any name in use
    spans = spans.select(*[F.col(c).alias(free + c) for c in ("doc_id", "tie", "spans")])
    spans = written(spans, f"{work_dir(docs.sparkSession)}/spans")
    # tie is 0 where no other row has the doc_id
    mine = F.col("doc_id").eqNullSafe(F.col(free + "doc_id")) & ((F.col(free + "tie") == 0) | (F.col(free + "tie") == text_hash()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, _ in text_slices(batch):
                part = batch.slice(a, b - a)
                texts, cuts = part.column(names.index("text")).to_pylist(), part.column(len(names)).to_pylist()
                hit = [i for i, x in enumerate(cuts) if x]
                for i in hit:
                    texts[i] = cut_words(texts[i], [(x["first_word"], x["n_words"]) for x in cuts[i]])
                columns = {n: part.column(i) for i, n in enumerate(names)}
                columns["text"] = pa.array(texts, part.column(names.index("text")).type)
                if "n_chars" in columns and hit:
                    counts = columns["n_chars"].to_pylist()
                    for i in hit:
                        counts[i] = len(texts[i])
                    columns["n_chars"] = pa.array(counts, columns["n_chars"].type)
                stays = pa.array([not x or bool(t.strip()) for x, t in zip(cuts, texts, strict=True)])
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=names).filter(stays)

    return docs.join(spans, mine, "left").select(*names, free + "spans").mapInArrow(run, schema)
