"""Catalog normalization: routing, mapping, offers, plausibility, identity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.tables import FIELDS, IDENTITY_DIMENSIONS, IDENTITY_STRONG, PLAUSIBILITY_RULES
from brindle.functions.text import first_number, normalize_stock
from brindle.functions.urls import url_key


def _text(df: DataFrame, name: str) -> Column:
    """A source column as text: a struct gives its name, an array its elements, empty gives null."""
    kind = df.schema[name].dataType.typeName()
    value = F.col(f"{name}.name") if kind == "struct" else F.to_json(name) if kind == "array" else F.col(name).cast("string")
    if kind == "array":
        value = F.when(F.size(name) > 0, value)
    return F.nullif(value, F.lit(""))


def route_field(df: DataFrame, canonical: str) -> Column:
    """struct(family, canonical, value, source) of the first filled source column, null if none is."""
    family, names = FIELDS[canonical]
    found = [F.when(_text(df, n).isNotNull(), F.struct(F.lit(family).alias("family"), F.lit(canonical).alias("canonical"), _text(df,
        n).alias("value"), F.lit(n).alias("source"))) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<family:string,canonical:string,value:string,source:string>")


def route_fields(df: DataFrame, keys: list[str]) -> DataFrame:
    """Long form: ``keys``, pos, family, canonical, value, source in the order of the fields."""
    routed = F.filter(F.array(*[route_field(df, c) for c in FIELDS]), lambda x: x.isNotNull())
    return df.select(*keys, F.posexplode(routed).alias("pos", "f")).select(*keys, "pos", "f.*")


def signals(price: Column, category: Column, panel: Column, refresh: Column, size: Column) -> Column:
    """Array of plausibility signals (code, severity, field); a null measure fails its condition."""
    out = []
    for code, severity, field, when in PLAUSIBILITY_RULES:
        ok = reduce(lambda a, b: a | b, [category.contains(t) for t in when["category_contains"]])
        if "panel_contains" in when:
            ok = ok & panel.contains(when["panel_contains"])
        if "price_lt" in when:
            ok = ok & (price < when["price_lt"])
        if "refresh_gte" in when:
            ok = ok & (refresh >= when["refresh_gte"])
        if "size_gte" in when:
            ok = ok & (size >= when["size_gte"])
        out.append(F.when(F.coalesce(ok, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(field).alias("field"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def map_product(df: DataFrame, keys: list[str]) -> DataFrame:
    """Stable product columns of raw records; price and stock fall back to the first offer."""
    value = {c: route_field(df, c)["value"] for c in FIELDS}
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    has_offers, has_specs = "offers" in df.columns, "specs" in df.columns
    offers = F.transform("offers", lambda o: F.struct(text(o["seller_id"].cast("string")).alias("seller_id"),
        text(o["price"].cast("string")).alias("price"), text(o["currency"].cast("string")).alias("currency"),
        normalize_stock(o["availability"]).alias("availability"))) if has_offers else F.array()
    first = lambda f: F.try_element_at(offers, F.lit(1))[f] if has_offers else F.lit(None).cast("string")
    spec = lambda *names: F.coalesce(*[F.try_element_at("specs", F.lit(n)) for n in names]) if has_specs else F.lit(None).cast("string")
    own_price = first_number(value["price"])
    category = F.lower(F.concat_ws(" ", value["category"], value["title"]))
    return df.select(
        *keys,
        text(value["title"]).alias("title"),
        text(value["sku"]).alias("sku"),
        text(value["mpn"]).alias("mpn"),
        F.nullif(F.regexp_replace(value["gtin"], r"\D", ""), F.lit("")).alias("gtin"),
        text(value["brand"]).alias("brand"),
        text(value["category"]).alias("category"),
        text(value["description"]).alias("description"),
        (F.col("specs") if has_specs else F.create_map().cast("map<string,string>")).alias("specs"),
        text(value["variant_id"]).alias("variant_id"),
        F.coalesce(text(value["price"]), first("price")).alias("price"),
        normalize_stock(F.coalesce(value["availability"], first("availability"))).alias("stock"),
        text(value["url"]).alias("url"),
        (F.filter("images", lambda x: F.trim(x) != "") if "images" in df.columns else F.array().cast("array<string>")).alias("images"),
        offers.alias("offers"),
        F.when(own_price.isNull(), F.array().cast("array<struct<code:string,severity:string,field:string>>")).otherwise(signals(own_price, category,
            F.lower(F.coalesce(spec("panel", "panel_type"), F.lit(""))), first_number(spec("refresh_rate", "hz")), first_number(spec("screen_size",
            "display_size")))).alias("plausibility"),
    )


def image_provenance(images: Column, source_field: Column, source_url: Column) -> Column:
    """One struct an image with its place and where it was observed."""
    return F.transform(images, lambda x, i: F.struct(x.alias("url"), F.lit("observed").alias("source"), source_field.alias("source_field"), source_url.alias("source_url"), i.alias("index")))


def normalize_specs(pairs: Column) -> Column:
    """Map of a list of (name, value) structs; the last of a name wins, nulls are left out."""
    kept = F.filter(pairs, lambda p: p["name"].isNotNull() & p["value"].isNotNull())
    last = F.filter(kept, lambda p, i: F.size(F.filter(F.slice(kept, i + 2, F.size(kept)), lambda q: q["name"] == p["name"])) == 0)
    return F.map_from_entries(last)


def first_seen(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row a key: the first by ``order`` (or the last)."""
    by = [F.desc(c) if last else F.asc(c) for c in order]
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("__n = 1").drop("__n")


def match_entities(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Decisions for pairs that share an identifier, the URL, or brand and title.

    Both sides have ``id`` and any of the identity fields. A pair without a
    shared value can't be accepted, so the union of equi-joins on those values
    finds all pairs that matter. Any differing field is a conflict and rejects.
    """
    fields = ["url", *IDENTITY_STRONG, "brand", *IDENTITY_DIMENSIONS]

    def prepared(df: DataFrame, side: str) -> DataFrame:
        col = lambda f: (url_key(F.col(f)) if f == "url" else F.nullif(F.lower(F.trim(F.col(f).cast("string"))), F.lit(""))) if f in df.columns else F.lit(None).cast("string")
        return df.select(F.col("id").alias(f"{side}_id"), *[col(f).alias(f"{side}_{f}") for f in [*fields, "title"]])

    t, c = prepared(targets, "t"), prepared(candidates, "c")
    blocks = [(f,) for f in ("url", *IDENTITY_STRONG)] + [("brand", "title")]

    def block(names: tuple[str, ...]) -> DataFrame:
        left = t.select("t_id", *[F.col(f"t_{n}").alias(n) for n in names]).dropna()
        right = c.select("c_id", *[F.col(f"c_{n}").alias(n) for n in names]).dropna()
        return left.join(right, list(names)).select("t_id", "c_id")

    pairs = reduce(DataFrame.unionByName, map(block, blocks)).distinct()
    both = pairs.join(t, "t_id").join(c, "c_id")
    pick = lambda test: F.filter(F.array(*[F.when(test(F.col(f"t_{f}"), F.col(f"c_{f}")), f) for f in fields]), lambda x: x.isNotNull())
    matched, conflicts = pick(lambda a, b: a == b), pick(lambda a, b: a != b)
    rows = both.select("t_id", "c_id", matched.alias("matched"), conflicts.alias("conflicts"), ((F.col("t_title") == F.col("c_title")) & (F.col("t_brand") == F.col("c_brand"))).alias("named"))
    strong = F.size(F.array_intersect("matched", F.array(*[F.lit(f) for f in IDENTITY_STRONG]))) > 0
    reason = (
        F.when(F.size("conflicts") > 0, "identity conflict")
        .when(strong, "exact identity match")
        .when(F.array_contains("matched", "url"), "canonical URL match")
        .when(F.coalesce("named", F.lit(False)), "exact brand and title match")
        .otherwise("insufficient identity evidence")
    )
    return rows.select("t_id", "c_id", "matched", "conflicts", reason.alias("reason"), reason.rlike("match$").alias("accepted"))
