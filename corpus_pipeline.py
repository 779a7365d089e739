"""The corpus pipeline: STAGES applied to documents, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents, and further ones that
docs has. Null ids and texts, repeated rows and empty tables are allowed in
all stages; how each treats them is said where the stage or its operator is.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import small, table, work_dir, written
from brindle.llm.decontamination import drop_contaminated
from brindle.llm.ngram_jaccard import ngram_jaccard_join
from brindle.llm.packing import pack
from brindle.llm.queries import WORD_BPE
from brindle.llm.substring_dedup import remove_repeats
from brindle.llm.toxicity import drop_toxic


def one_of_each(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of ``docs`` that stand for their component in ``classes`` (doc_id, component_id): the rows with its smallest id.

    Of rows that repeat an id and a text one stays; rows that repeat an id with
    another text are one document of the join and stay or go together. Rows
    with a null id stay, as they are in no component.
    """
    spark = docs.sparkSession
    gone = written(classes.where("doc_id <> component_id").select("doc_id").distinct(), f"{work_dir(spark)}/dropped")
    twice = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), f"{work_dir(spark)}/twice")
    kept = docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    if twice.isEmpty():
        return kept
    again = kept.join(small(twice), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(small(twice), "doc_id", "left_anti").select(*docs.columns).unionByName(again)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go, each row by its own text; null and empty texts score as empty ones."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that with the smallest id stays."""
    return one_of_each(docs, ngram_jaccard_join(docs))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages stay at their first place only; a document of nothing else goes."""
    return remove_repeats(docs, within=True)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go, each row by its own text."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows of what is left."""
    return pack(docs, public_tokenizers.path(WORD_BPE))


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can't express the learnt score, nor the token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents after all stages."""
    docs = table(spark, sf_dir, "documents")
    base = work_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
