"""What a fetched page is: title, JSON-LD blocks, product hints, and a status by its HTTP answer.

Pages are read by expressions where these are enough; those with comments,
more than one title, markup in a title, or JSON-LD go through a tokenizer of
tags in an Arrow function.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from brindle.operators.telemetry import PRODUCT_HINTS

#: Characters of a title.
TITLE = 300
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style)\b(?P<attributes>[^>]*)>(?P<body>.*?)(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)title\b[^>]*>|</?[A-Za-z][^>]*>|<[!?][^>]*>", re.I | re.S)
TYPE = re.compile(r"""(?:^|[\s"'/])type\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def tokens_of(page: str) -> tuple[str, int]:
    """(title, number of JSON-LD blocks that aren't blank): comments, scripts and styles are no text, and tags in a title are left out of it."""
    parts, blocks, inside, at = [], 0, False, 0
    for tag in TOKEN.finditer(page):
        if inside:
            parts.append(page[at : tag.start()])
        at = tag.end()
        raw = tag["raw"]
        if raw is not None:
            kind = TYPE.search(tag["attributes"])
            named = next((x for x in kind.groups() if x is not None), "") if kind else ""
            blocks += raw.lower() == "script" and html.unescape(named).lower() == "application/ld+json" and bool(tag["body"].strip())
        elif tag["close"] is not None:
            inside = not tag["close"]
    if inside:
        parts.append(page[at:])
    return " ".join(" ".join(html.unescape(p) for p in parts).split())[:TITLE], blocks


@F.pandas_udf(StructType([StructField("title", StringType()), StructField("blocks", IntegerType())]))
def _tokens(pages: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if p is None else tokens_of(p) for p in pages]
    return pd.DataFrame(rows, columns=["title", "blocks"])


def page_status(http: Column, text: Column, hints: Column, blocks: Column) -> Column:
    """blocked, resource_limited, error, ok or empty, by the HTTP answer first."""
    return (
        F.when(http.isin(401, 403), "blocked")
        .when(http == 429, "resource_limited")
        .when(http >= 400, "error")
        .when(F.regexp_replace(text, r"(?U)\s+", "") == "", "empty")
        .when((hints > 0) | (blocks > 0), "ok")
        .otherwise("empty")
    )


def page_structure(pages: DataFrame) -> DataFrame:
    """page_id, title, jsonld_blocks, product_hints, n_bytes and status of pages (page_id, html, http_status); a null page is empty, a null answer 200."""
    text = F.coalesce("html", F.lit(""))
    hints = sum((F.regexp_count(F.lower(text), F.lit(h)) for h in PRODUCT_HINTS), F.lit(0))
    # lazy runs of any character are loops in Java, also in very long pages
    shown = F.regexp_replace(text, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    plain = F.regexp_extract(shown, r"(?is)<title[^>]*>([^<&]*)</title\s*>", 1)
    titles = F.regexp_count(shown, F.lit("(?i)<title"))
    # what the expressions can't tell: an odd title, JSON-LD of whatever kind, what isn't closed
    odd = (titles > 1) | ((titles == 1) & ~shown.rlike(r"(?is)<title[^>]*>[^<&]*</title\s*>")) | text.rlike(r"(?i)ld\+json|type\s*=[^>]*&") | shown.rlike(r"(?i)<!--|<(script|style)\b")
    t = pages.withColumns({"text": text, "hints": hints, "plain": plain, "odd": odd}).withColumn("token", _tokens(F.when(F.col("odd"), F.col("text"))))
    title = F.when(F.col("odd"), F.col("token.title")).otherwise(F.left(F.trim(F.regexp_replace("plain", r"(?U)\s+", " ")), F.lit(TITLE)))
    blocks = F.when(F.col("odd"), F.col("token.blocks")).otherwise(0)
    status = page_status(F.coalesce("http_status", F.lit(200)), F.col("text"), F.col("hints"), blocks)
    return t.select("page_id", title.alias("title"), blocks.alias("jsonld_blocks"), F.col("hints").alias("product_hints"), F.octet_length("text").cast("long").alias("n_bytes"), status.alias("status"))
