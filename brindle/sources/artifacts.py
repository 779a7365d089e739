"""Published records of artifacts, and the rows of JSON documents in their several forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.urls import canonical_url, let
from brindle.operators.contracts import record_rules
from brindle.sources.files import numbered_lines

#: JSON of values that count as absent.
ABSENT = ("null", '""', "0", "0.0", "false", "[]", "{}")


def artifact_records(spark: SparkSession, path: str, schema: str | None = None, lane: int | None = None, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of published research artifacts, files of JSON lines.

    A record (artifact, file, line, program_id, lane, slot, status,
    research_type, topic, finding_count) comes from a line that breaks no rule of
    ``record_rules`` and whose program_id no earlier good line of the artifact
    has. An error (artifact, file, line, error) is a broken rule or
    repeated_program. Blank lines are neither. An artifact is a file, or with
    ``whole`` a folder, read in the order of its files' names.
    """
    lines = numbered_lines(spark, path).where(F.trim("value") != "").withColumnRenamed("value", "record")
    folder = F.regexp_extract("file", "^(.*)/[^/]*$", 1) if whole else F.col("file")
    rules = record_rules(lane, schema)
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(good, F.lit(False)), name) for name, good in rules.items()]))
    checked = lines.select(folder.alias("artifact"), "file", "line", "record", broken.alias("broken"))
    errors = checked.select("artifact", "file", "line", F.explode("broken").alias("error"))
    value = F.try_parse_json("record")
    text = lambda name: F.trim(F.try_variant_get(value, f"$.{name}", "string")).alias(name)
    number = lambda name: F.try_variant_get(value, f"$.{name}", "int").alias(name)
    count = F.size(F.try_variant_get(value, "$.findings", "array<variant>")).alias("finding_count")
    good = checked.where(F.size("broken") == 0).select("artifact", "file", "line", text("program_id"), number("lane"), number("slot"), text("status"), text("research_type"), text("topic"), count)
    first = good.groupBy("artifact", "program_id").agg(F.min(F.struct("file", "line")).alias("first"))
    marked = good.join(first, ["artifact", "program_id"]).withColumn("again", F.struct("file", "line") > F.col("first"))
    repeated = marked.where("again").select("artifact", "file", "line", F.lit("repeated_program").alias("error"))
    return marked.where(~F.col("again")).select(*good.columns), errors.unionByName(repeated)


def listed(document: Column, *names: str) -> Column:
    """The list that a JSON document is, or that stands at the first of ``names`` that it has; null for other documents and broken JSON."""
    value = F.try_parse_json(document)
    at = lambda n, kind: F.try_variant_get(value, f"$.{n}", kind)
    own = F.when(F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))
    inner = [F.when(at(n, "variant").isNotNull(), F.struct(at(n, "array<variant>").alias("l"))) for n in names]
    return F.coalesce(own, F.coalesce(*inner)["l"])


def absent(value: Column) -> Column:
    """Whether a value of a document is missing, null, false, zero or empty."""
    return F.coalesce(F.to_json(value).isin(*ABSENT), F.lit(True))


def corpus_rows(documents: DataFrame, key: str, text: str, required: tuple[str, ...] = ("id", "query")) -> DataFrame:
    """(key, place, the ``required`` fields as text, row as JSON) of JSON documents that are lists of objects or have one at ``queries``.

    Elements that are no objects, and objects that lack a required field, are left
    out, as are documents without such a list.
    """
    rows = documents.select(F.col(key), F.posexplode(listed(F.col(text), "queries")).alias("place", "v"))
    field = lambda n, kind: F.try_variant_get("v", f"$.{n}", kind)
    kept = rows.where(F.schema_of_variant("v").startswith("OBJECT"))
    for n in required:
        kept = kept.where(~absent(field(n, "variant")))
    return kept.select(key, "place", *[field(n, "string").alias(n) for n in required], F.to_json("v").alias("row"))


def target_rows(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(target, url, label, n_named) of JSON documents that list targets, itself or at ``targets`` or else ``sites``.

    A target is a URL or an object with ``url`` or else ``site``, and ``name`` or
    else ``label``. Targets whose URL is no text or not canonical are left out; of
    those with one canonical URL the first in the order of ``key`` and place gives the
    label, '' where it has none. Names are the SHA-256 of the URL.
    """
    at = lambda n: F.try_variant_get("v", f"$.{n}", "variant")
    either = lambda a, b: F.coalesce(F.when(~absent(at(a)), at(a)), at(b))
    rows = documents.select(F.col(key).alias("k"), F.posexplode(listed(F.col(text), "targets", "sites")).alias("place", "v"))
    # one step each, so that no step works out the one before many times
    kinds = rows.withColumn("kind", F.schema_of_variant("v")).where((F.col("kind") == "STRING") | F.col("kind").startswith("OBJECT"))
    plain = F.col("kind") == "STRING"
    chosen = kinds.select("k", "place", F.when(plain, F.col("v")).otherwise(either("url", "site")).alias("u"), F.when(~plain, either("name", "label")).alias("l"))
    texts = chosen.where(F.schema_of_variant("u") == "STRING").select(
        "k", "place", F.try_variant_get("u", "$", "string").alias("u"), F.when(absent(F.col("l")), "").otherwise(F.try_variant_get("l", "$", "string")).alias("label"))
    named = texts.select("k", "place", let(F.col("u"), canonical_url).alias("url"), "label")
    first = named.where("url is not null").groupBy("url").agg(F.min_by("label", F.struct("k", "place")).alias("label"), F.count("*").alias("n_named"))
    return first.select(F.sha2("url", 256).alias("target"), "url", "label", "n_named")
