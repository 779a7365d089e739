"""Payload bounds and shared passages."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from brindle.operators.work import work_folder, written

#: Passages of items, of 20 bytes each, that are broadcast at most.
FEW_PASSAGES = 250_000
MAX_BYTES, MAX_DEPTH, MAX_ITEMS, MAX_STRING = 1 << 20, 32, 1024, 131072


def _measure(text: str) -> str | None:
    """What of a payload is too deep, too wide or too long; its nodes are visited without recursion."""
    todo = [(json.loads(text), 1)]
    while todo:
        node, depth = todo.pop()
        if isinstance(node, str) and len(node) > MAX_STRING:
            return "string too long"
        if isinstance(node, dict | list):
            if depth > MAX_DEPTH:
                return "too deep"
            if len(node) > MAX_ITEMS:
                return "too many items"
            children = node.values() if isinstance(node, dict) else node
            todo += [(x, depth + 1) for x in children]
    return None


@F.pandas_udf(StringType())
def _inner_bounds(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else _measure(x))


def payload_problem(payload: Column) -> Column:
    """'' for a good payload, else its first problem: size, syntax, root, then the inner bounds.

    Only objects that could break an inner bound reach the Arrow function.
    """
    value = F.try_parse_json(payload)
    big = F.octet_length(payload) > MAX_BYTES
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    opened = F.length(payload) - F.length(F.translate(payload, "{[", ""))
    suspect = ~big & is_object & ((opened > MAX_DEPTH) | (F.length(payload) > 2 * MAX_ITEMS))
    inner = _inner_bounds(F.when(suspect, payload))
    return F.when(payload.isNull(), "missing").when(big, "too large").when(value.isNull(), "invalid json").when(~is_object, "root is not an object").otherwise(F.coalesce(inner, F.lit("")))


def media_problem(media_type: Column) -> Column:
    """unsupported media type for all but JSON, with or without parameters; '' for it."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(media_type, F.lit("")), ";", 1)))
    return F.when(kind == "application/json", "").otherwise("unsupported media type")


def check_payloads(rows: DataFrame, key: str, payload: str, media_type: str | None = None) -> DataFrame:
    """(key, problem) of each payload; where there is a ``media_type`` column another type than JSON is the first problem."""
    problem = payload_problem(F.col(payload))
    if media_type is not None:
        problem = F.coalesce(F.nullif(media_problem(F.col(media_type)), F.lit("")), problem)
    return rows.select(key, problem.alias("problem"))


def shared_passages(docs: DataFrame, items: DataFrame, doc: str, item: str, n: int) -> DataFrame:
    """(doc, item, n_shared): distinct passages of ``n`` blank-separated words that both texts have."""

    def passages(df: DataFrame, key: str) -> DataFrame:
        words = df.select(key, F.split(F.coalesce("text", F.lit("")), " ").alias("w")).where(F.size("w") >= n)
        at = words.select(key, "w", F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("i"))
        gram = [F.get("w", F.col("i") + j) for j in range(n)]
        return at.select(key, F.xxhash64(*gram).alias("g"), F.hash(*gram).alias("g2"))

    # two hashes stand for a passage, 96 bits together; few passages of items go to the documents, many meet them by a shuffle
    wanted = written(passages(items, item).distinct(), work_folder(items.sparkSession, "passages"))
    if wanted.count() <= FEW_PASSAGES:
        wanted = F.broadcast(wanted)
    return passages(docs, doc).join(wanted, ["g", "g2"]).distinct().groupBy(doc, item).agg(F.count("*").alias("n_shared"))
