"""Sources and sinks: JSON lines, artifacts in a tree, inventories, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

CORRUPT = "_corrupt"


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, lines that are no object of the schema). Blank lines are skipped."""
    rows = spark.read.text(path).where(F.trim("value") != "").select("value", parsed(F.col("value"), schema).alias("r"))
    bad = broken(F.col("value"))
    return rows.where(~bad).select("r.*").drop(CORRUPT), rows.where(bad).select("value")


def parsed(line: Column, schema: StructType) -> Column:
    wide = StructType(list(schema.fields)).add(CORRUPT, StringType())
    return F.from_json(line, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})


def broken(line: Column) -> Column:
    return F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull() | ~F.trim(line).startswith("{")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): every line of text files of any size, numbered from 1 in each file.

    Files are read by their splits. Lines are numbered within a split as they are
    read; the numbers of lines of the splits before, one row a split, are added.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("id"))
    splits = raw.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    shifts = splits.select("file", "start", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    return raw.join(shifts, ["file", "start"]).select("file", (F.col("id") + F.col("shift")).alias("line"), "value")


def read_numbered_jsonl(spark: SparkSession, path: str, schema: StructType, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows with file and line, errors (file, line, error)) of files of any size.

    An error is bad_json for a line that is no object of the schema, or
    repeated_key for one whose ``key`` an earlier line of the same file has.
    Lines count from 1, blank ones too, but they are no error.
    """
    rows = numbered_lines(spark, path).where(F.trim("value") != "").select("file", "line", "value", parsed(F.col("value"), schema).alias("r"))
    bad = broken(F.col("value"))
    errors = rows.where(bad).select("file", "line", F.lit("bad_json").alias("error"))
    good = rows.where(~bad).select("file", "line", "r.*").drop(CORRUPT)
    if key:
        first = good.where(F.col(key).isNotNull()).groupBy("file", key).agg(F.min("line").alias("__first"))
        marked = good.join(first, ["file", key], "left")
        again = F.coalesce(F.col("line") > F.col("__first"), F.lit(False))
        errors = errors.unionByName(marked.where(again).select("file", "line", F.lit("repeated_key").alias("error")))
        good = marked.where(~again).select(*good.columns)
    return good, errors


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """key and count of keys that more than one row has."""
    return rows.groupBy(key).count().where("count > 1")


def read_documents(spark: SparkSession, path: str, schema: StructType, root: str | None = None, required: tuple[str, ...] = ("id",)) -> DataFrame:
    """Whole-file JSON: a list of objects, or an object whose list is at ``root``; rows in which a ``required`` field is null or blank are dropped."""
    if root is None:
        rows = spark.read.schema(schema).json(path, multiLine=True)
    else:
        rows = spark.read.schema(StructType().add(root, ArrayType(schema))).json(path, multiLine=True).select(F.explode(root).alias("x")).select("x.*")
    for name in required:
        if name in rows.columns:
            rows = rows.where(F.trim(F.col(name).cast("string")) != "")
    return rows


def read_tree(spark: SparkSession, root: str, pattern: str, schema: StructType) -> DataFrame:
    """JSON files named by a pattern anywhere below ``root``, with their path."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("multiLine", True).json(root).withColumn("path", F.col("_metadata.file_path"))


def inventory(spark: SparkSession, root: str, skip: tuple[str, ...] = (".git", "node_modules", "__pycache__")) -> DataFrame:
    """path, bytes, sha256 and extension of every file below ``root`` outside the skipped folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    part = "|".join(s.replace(".", r"\.") for s in skip)
    return files.where(~F.col("path").rlike(f"/({part})/")).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"),
        F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extension"))


def read_keep_keys(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """First column of a tab-separated keep list; a key outside ``prefix`` or an empty list fails the job."""
    keys = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", "\t")[0].alias("key"))
    if keys.isEmpty():
        raise ValueError("the keep list is empty")
    return keys.withColumn("key", F.when(F.col("key").startswith(prefix), F.col("key")).otherwise(F.raise_error(F.lit("a key lies outside the prefix"))))


def append_receipts(receipts: DataFrame, path: str) -> None:
    receipts.write.mode("append").partitionBy("run_id", "shard").json(path)


def in_order(value: Column, kind: DataType) -> Column:
    """A value with the fields of all its structs, and the keys of its maps, sorted by name."""
    if isinstance(kind, StructType):
        fields = [in_order(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: in_order(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(value, lambda k, v: in_order(v, kind.valueType)))))
    return value


def write_report(report: DataFrame, path: str) -> None:
    """Rows as JSON objects with their fields sorted by name at every level; null fields are kept."""
    ordered = [in_order(F.col(f.name), f.dataType).alias(f.name) for f in sorted(report.schema.fields, key=lambda f: f.name)]
    report.select(*ordered).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def project_items(rows: DataFrame, items: str, fields: list[str]) -> DataFrame:
    """Each element of a list column, trimmed to ``fields``."""
    return rows.select(F.explode(items).alias("x")).select(*[F.col(f"x.{f}").alias(f) for f in fields])
