"""Near copies between two collections by MinHash signatures: bands find candidates, the sets decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.urls import let
from brindle.operators.work import work_folder, written

#: Words of a shingle; a pair is near from this Jaccard similarity on.
WORDS, NEAR = 5, 0.8
#: Bands of a signature and its values in a band: at similarity 0.8 a pair shares a band with probability 0.985, at 0.9 with 0.9999.
BANDS, ROWS = 8, 4


def shingle_set(text: Column, words: int = WORDS) -> Column:
    """Sorted distinct 64-bit hashes of the ``words``-word shingles of a lower-cased text; of fewer words their whole sequence, of none nothing."""
    none = F.array().cast("array<bigint>")

    def grams(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - (words - 1)), lambda i: F.xxhash64(F.array_join(F.slice(w, i, words), " ")))
        return F.when(F.size(w) >= words, many).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(none)

    # the words are worked out once, not once a shingle
    return F.sort_array(F.array_distinct(let(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != ""), grams)))


def classes(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(id, h1, h2, s): the shingle set of each row that has words, and 128 bits that name it."""
    # exploded, so that a set is made once and not again for each use of it
    rows = docs.select(F.col(doc).alias("id"), F.explode(F.array(shingle_set(F.col(text)))).alias("s")).where(F.size("s") > 0)
    return rows.select("id", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(1), "s").alias("h2"), "s")


def signed(docs: DataFrame, doc: str, text: str, n: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(h1, h2, rep, n, bands) of each class of equal sets: smallest id, number of rows, and (band, hash) structs of its MinHash signature.

    A signature is the smallest of the set's values under each of ``n * rows``
    hash functions, which are plain aggregates of the exploded sets: they run in
    compiled code and are merged before the shuffle.
    """
    one = classes(docs, doc, text).select("id", "h1", "h2", F.posexplode("s").alias("i", "x"))
    least = [F.min(F.xxhash64("x", F.lit(k))).alias(f"m{k}") for k in range(n * rows)]
    found = one.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count_if(F.col("i") == 0).alias("n"), *least)
    made = [F.struct(F.lit(b).alias("band"), F.xxhash64(*[f"m{b * rows + r}" for r in range(rows)]).alias("h")) for b in range(n)]
    return found.select("h1", "h2", "rep", "n", F.array(*made).alias("bands"))


def near_classes(left: DataFrame, right: DataFrame, doc: str, text: str, at_least: float = NEAR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Near copies of ``left`` rows among ``right`` rows.

    Gives (left_rep, right_rep, similarity, n_left, n_right), and (id, rep) of
    both sides: rows with equal shingle sets are one class, named by its
    smallest id, so copies meet once. Candidates share a band of their
    signatures; the similarity is that of the whole sets. A pair at exactly
    ``at_least`` is missed with probability 0.015, at 0.9 with 0.0001. Null and
    empty texts are near nothing.

    What is written of a class is its signature only. The sets, which are larger
    than the texts, are made again for one row of each class that has a candidate.
    """
    path = work_folder(left.sparkSession, "minhash")
    found, members = {}, {}
    for name, docs in (("left", left), ("right", right)):
        found[name] = written(signed(docs, doc, text), f"{path}/{name}-classes")
        members[name] = classes(docs, doc, text).select("id", "h1", "h2").join(found[name].select("h1", "h2", "rep"), ["h1", "h2"]).select("id", "rep")
    keyed = lambda name: F.struct("h1", "h2").alias(name)
    banded = lambda name: found[name].select(keyed(name), F.explode("bands").alias("b")).select(name, "b.*")
    pairs = written(banded("left").join(banded("right"), ["band", "h"]).select("left", "right").distinct(), f"{path}/pairs")

    def sets(name: str, docs: DataFrame) -> DataFrame:
        wanted = found[name].select(keyed(name), "rep", "n").join(pairs.select(name).distinct(), name, "left_semi")
        texts = docs.select(F.col(doc).alias("rep"), F.col(text).alias("text")).join(wanted.select("rep").distinct(), "rep", "left_semi")
        made = classes(texts, "rep", "text").select(keyed(name), F.col("id").alias("rep"), "s").join(wanted, [name, "rep"]).dropDuplicates([name])
        return written(made.select(name, F.col("rep").alias(f"{name}_rep"), F.col("n").alias(f"n_{name}"), F.col("s").alias(f"{name}_s")), f"{path}/{name}-sets")

    both = pairs.join(sets("left", left), "left").join(sets("right", right), "right").withColumn("shared", F.size(F.array_intersect("left_s", "right_s")))
    similarity = F.col("shared") / (F.size("left_s") + F.size("right_s") - F.col("shared"))
    near = both.withColumn("similarity", similarity).where(F.col("similarity") >= at_least)
    return near.select("left_rep", "right_rep", F.round("similarity", 6).alias("similarity"), "n_left", "n_right"), members["left"], members["right"]
