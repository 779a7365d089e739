"""N-gram Jaccard join: classes of texts whose shingle sets overlap.

The product of the document-by-shingle matrix with its transpose is taken in
blocks of the shingles' hash range, and only where the bounds leave a chance:

1. One scan makes each document's shingle set. Equal sets fall together by
   digest; the smallest id stands for them from there on.
2. Of each representative only the few rarest shingles are indexed, with their
   places: two sets that pass the threshold must share one of those, so early
   in both that enough is left behind it. "Rare" is any common order; it is by
   counts of frequent shingles, then by hash.
3. In each posting list, documents meet two hubs. Documents already in one
   component need no further comparison, so lists of thousands of near copies
   cost a few rows a document instead of all pairs.
4. What the bounds leave of documents in different components is compared
   pair by pair, so no link is lost.

Each comparison multiplies blocks of member rows with blocks of partner rows
as sparse matrices in numpy. Overlaps of the first hash block are counted
first; the bound of the sizes then discards most pairs, and the overlaps of
the other blocks are added for the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import arrow_rows, drop_dir, hot_join, list_array, release, shingle_sets, small, text_slices, work_dir, written
from brindle.llm.components import components

#: How many of the most frequent shingles the common order knows. They only steer the order; none is left out.
FREQUENT = 1 << 18
#: A shingle may be frequent if it is in so many documents among so many shingles counted at once.
LEAST_COUNT, COUNTED = 4, 3_000_000
#: Rounds with hubs before what is left is compared; those after the first are for lists of more documents than LONG.
HUB_ROUNDS, LONG = 2, 24
#: Shingles of a block of pairs.
BLOCK_GRAMS = 400_000
#: The first block of the product has one in so many hashes, the second one all others.
BLOCKS = 8
MASK = 0x5DEECE66D1234567


def frequent_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes sorted, counts) of at most FREQUENT shingles that many documents share."""

    def often(parts: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        keep = n >= LEAST_COUNT
        return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(n[keep])], names=["h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for _, _, data, offsets in text_slices(batch):
                parts += shingle_sets(data, offsets, k)
                size += sum(map(len, parts[1 - len(offsets) :]))
                if size >= COUNTED:
                    yield often(parts)
                    parts, size = [], 0
        if parts:
            yield often(parts)

    top = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()
    h, n = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any partner at the threshold."""
    return max(1, -(-percent * n // 100))


def signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, digest of the set, its rarest shingles in order (prefix), and those of the first hash block (part)."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = frequent.value
        for batch in batches:
            for a, b, data, offsets in text_slices(batch):
                sets = shingle_sets(data, offsets, k)
                prefixes = []
                for s in sets:
                    p = len(s) - least_overlap(len(s), percent) + 1 if len(s) else 0
                    if len(known) and p:
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        n = np.where(known[at] == s, counts[at], 0)
                        rare = s[n == 0]
                        if len(rare) < p:
                            often = n > 0
                            rare = np.concatenate((rare, s[often][np.argsort(n[often], kind="stable")]))
                        s = rare
                    prefixes.append(s[:p])
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                parts = [s[s % np.uint64(BLOCKS) == 0] for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests,
                    pa.binary()), list_array(prefixes, pa.int64()), list_array(parts, pa.int64())], names=["doc_id", "n", "digest", "prefix", "part"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, prefix array<long>, part array<long>")


def other_blocks(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, n, s): size of each set in ``ids``, and its shingles outside the first hash block."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch):
                whole = shingle_sets(data, offsets, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(s) for s in whole], pa.int64()),
                    list_array([s[s % np.uint64(BLOCKS) != 0] for s in whole], pa.int64())], names=["id", "n", "s"])

    return docs.select("doc_id", "text").join(small(ids), "doc_id", "left_semi").mapInArrow(sets, "id long, n long, s array<long>")


PAIR = "a long, b long, shared long, seen_a long, seen_b long"


def accumulate(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """``pairs`` with the overlap of one more block of ``rows`` (id, n, s) added, without those that can't reach the threshold any more.

    ``pairs`` is a written table (a, b, shared, seen_a, seen_b): shingles that a
    pair shared, and that either set had, in the blocks before. What moves is a
    row for each pair with the block's row of its ``a``; few documents should be
    a ``b``.
    """

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(np.diff(batch.column(2).offsets.to_numpy()) + np.diff(batch.column(5).offsets.to_numpy()))
            cuts = np.flatnonzero(np.diff(ends // BLOCK_GRAMS, prepend=-1))
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows], strict=True):
                part = batch.slice(lo, hi - lo)
                shared, seen_a, seen_b = block_product(part.column(2), part.column(3), part.column(5))
                shared, seen_a, seen_b = (x + part.column(i).to_numpy() for i, x in ((6, shared), (7, seen_a), (8, seen_b)))
                n_a, n_b = part.column(1).to_numpy(), part.column(4).to_numpy()
                most = shared + np.minimum(n_a - seen_a, n_b - seen_b)
                keep = pa.array(100 * most >= percent * (n_a + n_b - most))
                out = [part.column(0), part.column(3), pa.array(shared), pa.array(seen_a), pa.array(seen_b)]
                yield pa.RecordBatch.from_arrays([x.filter(keep) for x in out], names=["a", "b", "shared", "seen_a", "seen_b"])

    left, right = (rows.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}")) for x in "ab")
    both = left.join(small(pairs), "a").join(right.hint("merge"), "b").select("a", "na", "sa", "b", "nb", "sb", "shared", "seen_a", "seen_b")
    return both.mapInArrow(product, PAIR)


def block_product(rows_a: pa.ListArray, b: pa.Array, rows_b: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of the sparse product A x B^T of one block at the rows' own pairs, and the sizes of both rows.

    A partner that occurs in many rows of the block is one row of B.
    """
    _, first, which = np.unique(b.to_numpy(), return_index=True, return_inverse=True)
    b_rows = rows_b.take(pa.array(first))
    size_a, size_b = (np.diff(x.offsets.to_numpy()) for x in (rows_a, b_rows))
    col_b = b_rows.flatten().to_numpy()
    row_b = np.repeat(np.arange(len(first)), size_b)
    order = np.argsort(col_b, kind="stable")
    col_b, row_b = col_b[order], row_b[order]
    col_a = rows_a.flatten().to_numpy()
    row_a = np.repeat(np.arange(len(rows_a)), size_a)
    lo, hi = np.searchsorted(col_b, col_a, "left"), np.searchsorted(col_b, col_a, "right")
    n = hi - lo
    left = np.repeat(row_a, n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    shared = np.bincount(left[row_b[at] == which[left]], minlength=len(rows_a))
    return shared, size_a.astype(np.int64), size_b[which].astype(np.int64)


def can_link(n: str, i: str, n2: str, i2: str, percent: int) -> F.Column:
    """The bound of sizes and places: sets of ``n`` and ``n2`` shingles whose first common one, in the common order, is their ``i``-th and ``i2``-th.

    At most the shingles from there on are shared, and a link needs a
    ``percent``-th of the union. It bounds the sizes' ratio too.
    """
    most = F.least(F.col(n) - F.col(i), F.col(n2) - F.col(i2))
    return most * (100 + percent) >= (F.col(n) + F.col(n2)) * percent


def linked(pairs: DataFrame, sigs: DataFrame, docs: DataFrame, k: int, percent: int, path: str) -> DataFrame:
    """Those of ``pairs`` (a, b) that link: the product's two blocks, one after the other."""
    spark = docs.sparkSession
    pairs = written(pairs.select("a", "b", *[F.lit(0).cast("long").alias(x) for x in ("shared", "seen_a", "seen_b")]), f"{path}-pairs")
    with arrow_rows(spark, 500):
        like = written(accumulate(pairs, sigs.select(F.col("doc_id").alias("id"), "n", F.col("part").alias("s")), percent), f"{path}-like")
        ids = like.select(F.col("a").alias("doc_id")).union(like.select(F.col("b").alias("doc_id"))).distinct()
        rest = written(other_blocks(docs, ids, k), f"{path}-rest")
        found = written(accumulate(like, rest, percent), f"{path}-links")
    drop_dir(spark, f"{path}-pairs")
    drop_dir(spark, f"{path}-rest")
    return found


def ngram_jaccard_join(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id for every row of ``docs`` (doc_id, text).

    Two documents are linked when 100 * shared >= percent * union of their sets
    of ``k``-word shingles (A-Z lower-cased, words by ASCII white space; with
    fewer words the whole sequence is the one shingle). class_id is the
    smallest id with an equal set, component_id the smallest reachable id.
    Texts that are null or without words have no shingles and link with
    nothing. Very long texts are taken whole. Rows that repeat a doc_id are one
    node of the links, and each keeps its row; a null doc_id keeps its row with
    null class and component. Ties and extra columns change nothing; other
    columns are not read. Sets are compared by 64-bit hashes of their shingles.
    Only components are returned: links inside a component are evaluated as far
    as it takes to join it, so neither pairs nor a document's number of links
    can be had.
    """
    spark = docs.sparkSession
    base = work_dir(spark)
    sigs = written(signatures(docs, k, percent), f"{base}/sigs")
    full = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    classes = sigs.where(full).groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members"))
    classes = written(classes, f"{base}/classes")
    lists = posting_lists(sigs, classes, base, percent)
    release(spark)
    links, labels = None, None
    for turn in range(HUB_ROUNDS + 1):
        mine = labelled(lists, labels, f"{base}/lists{turn}")
        if turn == HUB_ROUNDS:
            pairs = remaining_pairs(mine, percent)
        else:
            pairs = written(hub_pairs(mine, MASK * (2 * turn + 1), percent, f"{base}/hubs{turn}", LONG if turn else 1), f"{base}/met{turn}")
            if turn and pairs.isEmpty():
                continue
        found = linked(pairs, sigs, docs, k, percent, f"{base}/{turn}")
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        release(spark)
    named = classes.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component_id", F.coalesce("component", "class_id"))
    named = written(named.select("digest", "class_id", "component_id", "members"), f"{base}/named")
    linked_rows = hot_join(sigs.where(full).select("digest", "doc_id", "n"), named, "digest", "members")
    alone = sigs.where(~F.coalesce(full, F.lit(False))).select("doc_id", "n")
    return linked_rows.select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id").unionByName(alone.select("doc_id",
        F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("class_id"), F.col("doc_id").alias("component_id")))


def posting_lists(sigs: DataFrame, classes: DataFrame, base: str, percent: int) -> DataFrame:
    """(g, id, n, i): the indexed shingles that at least two representatives have, and which of the set's rarest they are.

    Of two sets that link, the smaller has the first common shingle among its
    100 - 200 * percent / (100 + percent) percent rarest; lists where none has it there are left out.
    """
    reps = sigs.join(classes.select("digest", F.col("class_id").alias("doc_id")), ["digest", "doc_id"], "left_semi")
    grams = reps.select(F.col("doc_id").alias("id"), "n", F.posexplode("prefix").alias("i", "g"))
    early = F.max(((F.col("n") - F.col("i")) * (100 + percent) >= F.col("n") * 2 * percent).cast("int"))
    shared = written(grams.groupBy("g").agg(F.count("*").alias("size"), early.alias("early")).where("size > 1 and early = 1").drop("early"), f"{base}/shared")
    return written(hot_join(grams, shared, "g", "size").select("g", "id", "n", "i"), f"{base}/lists")


def labelled(lists: DataFrame, labels: DataFrame | None, path: str) -> DataFrame:
    """Lists with each document's component so far, without those whose documents are all in one."""
    if labels is None:
        return lists.withColumn("c", F.col("id"))
    mine = lists.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    mine = written(mine, f"{path}-all")
    opened = mine.groupBy("g").agg(F.count("*").alias("size"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("g", "size")
    return written(hot_join(mine, written(opened, f"{path}-open"), "g", "size").drop("size"), path)


def hub_pairs(lists: DataFrame, mask: int, percent: int, path: str, longer_than: int) -> DataFrame:
    """(a, b): documents of each list of over ``longer_than`` with its hubs of another component.

    One hub is the document with the fewest rarer shingles: the plainest copy of
    a group of near copies. The other is the one whose id comes first after
    flipping a fixed set of its bits, so it is the same in every list that has
    it, and other bits give another hub.
    """
    flipped = F.col("id").bitwiseXOR(F.lit(mask % (1 << 62)))
    hub = lambda *by: F.min(F.struct(*[x.alias(f"k{j}") for j, x in enumerate(by)], F.col("id").alias("b"), F.col("n").alias("n2"), F.col("i").alias("i2"), F.col("c").alias("c2")))
    pick = lambda x: F.struct(f"{x}.b", f"{x}.n2", f"{x}.i2", f"{x}.c2")
    hubs = lists.groupBy("g").agg(F.count("*").alias("size"), hub(F.col("i"), flipped).alias("first"), hub(flipped).alias("second")).where(F.col("size") > longer_than)
    hubs = written(hubs.select("g", "size", F.array_distinct(F.array(pick("first"), pick("second"))).alias("hubs")), path)
    met = hot_join(lists, hubs, "g", "size").select("id", "n", "i", "c", F.explode("hubs").alias("h")).select("id", "n", "i", "c", "h.*").where("c <> c2")
    return met.where(can_link("n", "i", "n2", "i2", percent)).select(F.col("id").alias("a"), "b").distinct()


def remaining_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): documents of different components that share a list and can link by sizes and places."""
    met = lists.join(lists.withColumnsRenamed({"id": "id2", "n": "n2", "i": "i2", "c": "c2"}), "g")
    met = met.where((F.col("id") < F.col("id2")) & (F.col("c") != F.col("c2")) & can_link("n", "i", "n2", "i2", percent))
    return met.select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()
