"""Column expressions that clean names, identifiers and stock labels."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from brindle.functions.tables import BRAND_ALIASES, CATEGORY_ALIASES, CATEGORY_TAGS, STOCK_RULES, TITLE_STOP_WORDS

DASHES = "‐‑‒–—−"


@F.pandas_udf(StringType())
def _unescape_nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", html.unescape(x)))


@F.pandas_udf(StringType())
def _casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else x.casefold())


def _where(value: Column, needs: Column, slow) -> Column:
    """``slow`` (an Arrow function) for those values that need it; the others stay in the JVM."""
    return F.coalesce(slow(F.when(needs, value)), value)


def clean_text(value: Column, ascii_only: bool = False) -> Column:
    """Entities and compatibility forms resolved, dashes as '-', white space collapsed; null gives ''."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    if not ascii_only:
        text = _where(text, text.rlike(r"[^\x00-\x7F]|&"), _unescape_nfkc)
    return F.trim(F.regexp_replace(F.translate(text, DASHES, "-" * len(DASHES)), r"(?U)\s+", " "))


def fold(value: Column, ascii_only: bool = False) -> Column:
    """Case folding; plain lower case for ASCII."""
    return F.lower(value) if ascii_only else _where(F.lower(value), value.rlike(r"[^\x00-\x7F]"), _casefold)


def strip_chars(value: Column, chars: str) -> Column:
    """Remove any of ``chars`` from both ends."""
    return F.btrim(value, F.lit(chars))


def alias(table: dict[str, str], value: Column) -> Column:
    """The value's entry in a fixed table, null where there is none."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)


def normalize_brand(value: Column, ascii_only: bool = False) -> Column:
    return folded_brand(fold(clean_text(value, ascii_only), ascii_only))


def folded_brand(folded: Column) -> Column:
    """``normalize_brand`` of a text that is cleaned and folded already."""
    raw = strip_chars(folded, " ._-\t")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in BRAND_ALIASES.items() for x in kv]), raw), raw)


def normalize_category(value: Column, ascii_only: bool = False) -> Column:
    """Exact alias, accessory guard, longest alias at a word edge, ordered tags, else the cleaned label."""
    raw = fold(clean_text(value, ascii_only), ascii_only)
    raw = strip_chars(F.regexp_replace(F.regexp_replace(raw, r"[_\-/]+", " "), r"(?U)\s+", " "), " .")
    aliases = F.create_map(*[F.lit(x) for kv in CATEGORY_ALIASES.items() for x in kv])
    # aliases by length, the first declared first; one with a hyphen meets no cleaned label
    edges = [F.when(F.concat(F.lit(" "), raw, F.lit(" ")).contains(f" {a} "), CATEGORY_ALIASES[a]) for a in sorted(CATEGORY_ALIASES, key=len, reverse=True)]
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(raw, r"[^a-z0-9]+", " ")), F.lit(" "))
    tags = [F.when(words.contains(f" {token} "), label) for token, label in CATEGORY_TAGS]
    accessory = F.when(raw.isin("earphone tip", "earphone tips", "replacement tips", "tips"), "other")
    return F.when(raw == "", "").otherwise(F.coalesce(F.try_element_at(aliases, raw), accessory, *edges, *tags, raw))


def title_words(value: Column, ascii_only: bool = False) -> Column:
    """Distinct title tokens in order, without stop words and single characters."""
    return folded_words(fold(clean_text(value, ascii_only), ascii_only))


def folded_words(folded: Column) -> Column:
    """``title_words`` of a text that is cleaned and folded already."""
    text = F.regexp_replace(folded, r"[^a-z0-9+./_-]+", " ")
    return F.filter(F.array_distinct(F.split(text, " ")), lambda t: (F.length(t) > 1) & ~t.isin(*TITLE_STOP_WORDS))


# Texts that stand for no identifier, and what may stand before the digits of a trade number.
NO_IDENTIFIER = ("", "n/a", "none", "null", "na", "unknown", "-", "--")
GTIN = r"(?i)^(?:(?:gtin(?:[- ]?(?:8|12|13|14))?|ean(?:[- ]?(?:8|13))?|upc|barcode)\s*[:#=\-]?\s*)?([0-9][0-9\s-]*)$"


def clean_identifier(value: Column, max_len: int = 96, ascii_only: bool = False) -> Column:
    text = F.upper(clean_text(value, ascii_only))
    null_word = F.lower(text).isin(*NO_IDENTIFIER)
    return F.when(null_word, "").otherwise(F.substring(F.regexp_replace(text, r"(?U)\s+", ""), 1, max_len))


# Words that stand for no part number.
NO_MPN = ("PRODUCT", "MODEL", "SKU", "N/A", "NONE", "NULL")


def normalize_mpn(value: Column, ascii_only: bool = False) -> Column:
    text = F.replace(clean_identifier(value, 80, ascii_only), F.lit("_"), F.lit("-"))
    return F.when(text.isin(*NO_MPN), "").otherwise(text)


def normalize_gtin(value: Column, strict: bool = True, ascii_only: bool = False) -> Column:
    """Digits padded to 14 if label, length, variety and (strict) check digit are right, else ''."""
    text = clean_text(value, ascii_only)
    bare = F.regexp_extract(text, GTIN, 1)
    digits = F.regexp_replace(bare, r"[\s-]", "")
    padded = F.lpad(digits, 14, "0")
    total = sum((F.substring(padded, i, 1).cast("int") * (3 if i % 2 else 1) for i in range(1, 15)), F.lit(0))
    shape = F.length(digits).isin(8, 12, 13, 14) & ~digits.rlike(r"^(.)\1*$")
    return F.when(shape & ((total % 10 == 0) if strict else F.lit(True)), padded).otherwise("")


def normalize_identifier(value: Column, kind: Column, ascii_only: bool = False) -> Column:
    """By kind: mpn, the sku kinds, the id kinds, gtin, else the generic rule."""
    k = F.lower(F.trim(kind))
    return (
        F.when(k == "mpn", normalize_mpn(value, ascii_only))
        .when(k.isin("sku", "seller_sku", "variant_sku"), clean_identifier(value, 80, ascii_only))
        .when(k == "gtin", normalize_gtin(value, True, ascii_only))
        .otherwise(clean_identifier(value, 96, ascii_only))
    )


def normalize_stock(value: Column) -> Column:
    """Stock label of a text: numbers, then the ordered rules, else its first 80 characters.

    The rules' order is their meaning: "unavailable" contains "available" and is In Stock.
    """
    shown = F.trim(F.regexp_replace(value.cast("string"), r"(?U)\s+", " "))
    text = F.regexp_replace(F.lower(shown), r"^(stock|availability|status)\s*[:=\-]\s*", "")
    label = F.when(text.rlike(r"^\d+$"), F.when(text.rlike("[1-9]"), "In Stock").otherwise("Out of Stock"))
    for needles, name in STOCK_RULES:
        hit = F.lit(False)
        for needle in needles:
            hit = hit | text.contains(needle)
        label = label.when(hit, name)
    return F.coalesce(label.otherwise(F.nullif(F.substring(shown, 1, 80), F.lit(""))), F.lit("Unknown"))


def first_number(value: Column) -> Column:
    """The first decimal number in a text ("1,299" gives 1)."""
    return F.nullif(F.regexp_extract(F.coalesce(value.cast("string"), F.lit("")), r"\d+(?:\.\d+)?", 0), F.lit("")).cast("double")


def redact(value: Column) -> Column:
    """Credential assignments and key blocks replaced, white space collapsed, cut to 1200 characters."""
    text = F.regexp_replace(value, r"(?is)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED]")
    text = F.regexp_replace(text, r"(?i)\b(token|secret|password|api[_-]?key|authorization)\b(\s*[:=]\s*)\S+", "$1$2[REDACTED]")
    return F.left(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(1200))


def clamp3(value: Column) -> Column:
    """Into 0 to 1, rounded half up to three places."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 3)


def canonical_sha256(**fields: Column) -> Column:
    """SHA-256 of the compact JSON object of the fields, sorted by name, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)
