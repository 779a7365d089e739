"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

One scan of the documents writes the index: for every place of a document that
holds a term of the benchmark a posting (row, place, term), and a closing
posting a row with its number of words. All that follows reads the index:

1. Postings are counted by term; the two rarest terms of every window of an
   item are the window's anchors.
2. The postings of the rarest terms, shifted by the terms' places in the item,
   are intersected with those of the second terms: where both lists hold a row
   and shift, the item may lie there. The second list is read only in rows that
   the first one names.
3. The item's other terms are looked up at that shift. Runs of a window's
   length are exact phrase matches; anchors that are near each other, in
   whatever order, are proximity matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import drop_dir, small, work_dir, written

#: Words in a window; a shorter item is one window as a whole.
WINDOW = 10
#: Words that a window's two rarest terms may be apart in a proximity match.
WITHIN = 10
#: Words are runs of digits, letters and all that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters beyond ASCII that lower() might change; a text without them can take lower(), which is faster than translate().
CASED = r"[[\p{Lu}\p{Lt}\p{Cn}Ⅰ-ⅯⒶ-Ⓩ]&&[^A-Z]]"
#: Number of the term that closes a row's postings. No word is empty, so the empty string stands for it.
CLOSING, CLOSING_TERM = -1, ""


def words_of(text: str) -> Column:
    """Words of a text with A-Z in lower case; none for null."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lowered = F.when(whole.rlike(CASED), F.translate(whole, UPPER, LOWER)).otherwise(F.lower(whole))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def items_of(benchmark: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """(key, item_id, size, place, t) of items with words, and (term, t); the key tells texts of the same id apart."""
    items = benchmark.where("item_id is not null").select("item_id", words_of("text").alias("words")).where(F.size("words") > 0).distinct()
    items = items.withColumn("key", F.monotonically_increasing_id())
    items = written(items.select("key", "item_id", F.size("words").alias("size"), F.posexplode("words").alias("place", "term")), f"{base}/items")
    terms = written(items.select("term").distinct().select("term", F.monotonically_increasing_id().alias("t")), f"{base}/terms")
    return items.join(terms, "term").drop("term"), terms


def index(docs: DataFrame, terms: DataFrame, path: str) -> DataFrame:
    """The written postings (row, at, t) of ``terms``; a row's closing posting has its doc_id and its number of words as ``at``."""
    closing = terms.sparkSession.createDataFrame([(CLOSING_TERM, CLOSING)], "term string, t long")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(words_of("text"), F.array(F.lit(CLOSING_TERM))).alias("words"))
    seen = rows.select("row", "doc_id", F.posexplode("words").alias("at", "term")).join(small(terms.unionByName(closing)), "term")
    return written(seen.select("row", "at", "t", F.when(F.col("t") == CLOSING, F.col("doc_id")).alias("doc_id")), path)


def anchors_of(items: DataFrame, postings: DataFrame, window: int) -> DataFrame:
    """(anchor, key, p1, t1, p2, t2): the two rarest terms of each window and their places in the item."""
    counts = postings.where(F.col("t") != CLOSING).groupBy("t").agg(F.count("*").alias("n"))
    placed = items.join(counts, "t", "left")
    low = F.greatest(F.lit(0), F.col("place") - (window - 1))
    high = F.greatest(F.lit(0), F.least(F.col("place"), F.col("size") - window))
    windows = placed.where(low <= high).withColumn("first", F.explode(F.sequence(low, high))).groupBy("key", "first")
    two = windows.agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "t"))), 1, 2).alias("two"))
    first, second = F.col("two")[0], F.coalesce(F.get("two", F.lit(1)), F.col("two")[0])
    # a window with a term that no document has can't occur
    both = two.where(first["n"] > 0).select("key", first["place"].alias("p1"), first["t"].alias("t1"), second["place"].alias("p2"), second["t"].alias("t2")).distinct()
    return both.withColumn("anchor", F.monotonically_increasing_id())


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, within: int = WITHIN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, phrases, near), from one index.

    texts: row, doc_id, n_words of every row of ``docs``. phrases: (row, item_id,
    place, item_place) of each document word inside an occurrence of a window.
    near: (row, item_id, place): proximity matches, places of a window's rarest
    term with its second rarest, another one, at most ``within`` words away.
    """
    base = work_dir(docs.sparkSession)
    items, terms = items_of(benchmark, base)
    postings = index(docs, terms, f"{base}/index")
    texts = postings.where(F.col("t") == CLOSING).select("row", "doc_id", F.col("at").cast("long").alias("n_words"))
    postings = postings.select("row", "at", "t")
    anchors = written(anchors_of(items, postings, window), f"{base}/anchors")
    rare = postings.join(small(anchors.withColumnRenamed("t1", "t")), "t").select("row", "anchor", "key", "p1", "p2", "t2", "at", (F.col("at") - F.col("p1")).alias("shift"))
    rare = written(rare, f"{base}/rare")
    # the postings of rows that hold a rarest term; all further lists are read from there
    held = written(rare.select("row").distinct(), f"{base}/rows")
    lists = written(postings.join(small(held, 1_000_000), "row", "left_semi"), f"{base}/lists")
    second = rare.select("row", "anchor", "t2", "p2").distinct().join(lists.withColumnRenamed("t", "t2"), ["row", "t2"])
    second = written(second.select("row", "anchor", "at", (F.col("at") - F.col("p2")).alias("shift")), f"{base}/second")
    # both lists, shifted: several anchors of an item may find the same place
    spots = rare.join(second.select("row", "anchor", "shift"), ["row", "anchor", "shift"], "left_semi").select("row", "key", "shift").distinct()
    there = spots.join(small(items), "key").select("row", "key", "shift", "item_id", "size", F.col("place").alias("item_place"), (F.col("shift") + F.col("place")).alias("at"), "t")
    same = there.join(lists, ["row", "at", "t"])
    spot = ["row", "key", "shift"]
    island = F.col("item_place") - F.row_number().over(Window.partitionBy(*spot).orderBy("item_place"))
    same = same.withColumn("island", island).withColumn("run", F.count("*").over(Window.partitionBy(*spot, "island")))
    phrases = same.where(F.col("run") >= F.least(F.lit(window), F.col("size"))).select("row", "item_id", F.col("at").alias("place"), "item_place").distinct()
    # nearest place of the second term before and after each of the first: one walk over both lists, no pairs
    other = rare.join(anchors.where("t1 <> t2").select("anchor"), "anchor", "left_semi")
    walk = other.select("row", "anchor", "key", "at", F.lit(None).cast("int").alias("at2")).unionByName(second.select("row", "anchor",
        F.lit(None).cast("long").alias("key"), "at", F.col("at").alias("at2")))
    by = Window.partitionBy("row", "anchor").orderBy("at")
    before = F.last("at2", True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("at2", True).over(by.rowsBetween(0, Window.unboundedFollowing))
    close = (F.col("at") - F.col("before") <= within) | (F.col("after") - F.col("at") <= within)
    ids = items.select("key", "item_id").distinct()
    near = walk.withColumns({"before": before, "after": after}).where(F.col("key").isNotNull() & close).select("row", "key",
        F.col("at").alias("place")).join(small(ids), "key").select("row", "item_id", "place").distinct()
    drop_dir(docs.sparkSession, f"{base}/rows")
    return texts, phrases, near


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, within: int = WITHIN) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near of every row of ``docs`` (doc_id, text).

    n_hit counts words inside any occurrence of a window of ``benchmark``
    (item_id, text): ``window`` consecutive words of an item, or all words of a
    shorter one. items_sha256 is the digest of the ids of items with
    occurrences, sorted as strings and joined by commas (of '' for none). n_near
    counts the items with a proximity match: the two rarest terms of one of
    their windows at most ``within`` words apart, in any order. Null or empty
    texts have no words. Whole texts are read. Each row is judged by its own
    text, also where it repeats a doc_id or has none. Items with a null id
    aren't searched; equal rows of an item count once; both tables may be empty.
    Other columns are not read.
    """
    texts, phrases, near = search(docs, benchmark, window, within)
    by_row = phrases.groupBy("row").agg(F.count_distinct("place").alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    by_row = by_row.join(near.groupBy("row").agg(F.count_distinct("item_id").alias("n_near")), "row", "full")
    out = texts.join(written(by_row, f"{work_dir(docs.sparkSession)}/hits"), "row", "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items,
        ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Those rows of ``docs``, with all their columns, that hold no window of an item.

    Each row is judged by its own text: a row goes if one with its doc_id, null
    or not, and its text is contaminated. Rows may repeat.
    """
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    texts, phrases, _ = search(docs.select(F.struct("doc_id", text_hash.alias("h")).alias("doc_id"), "text"), benchmark, window)
    bad = texts.join(phrases.select("row").distinct(), "row").select(F.col("doc_id.doc_id").alias("__id"), F.col("doc_id.h").alias("__h")).distinct()
    bad = small(written(bad, f"{work_dir(docs.sparkSession)}/bad"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__id"]) & (text_hash == bad["__h"]), "left_anti")
