"""Queries that write what a table gives in the formats of sources and sinks, and read it back; first and last rows of keys; redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from brindle.functions.text import redact
from brindle.operators.catalog import first_seen
from brindle.operators.ledger import deletion_plan
from brindle.operators.work import work_folder
from brindle.plans.registry import load, query
from brindle.sources import files as S

OBSERVATION = StructType().add("event_id", LongType()).add("kind", StringType()).add("note", StructType().add("user", LongType()))


@query("""with l as (select event_id, event_id % 10 as k, case event_id % 10 when 1 then '[' || event_id || ']' when 2 then '{"event_id": ' || event_id when 3 then 'none' when 4 then '{"event_id":"x' || event_id || '"}' end as line, event_type, user_id from events)
    select event_id, event_type as kind, case when k <> 6 then user_id end as user, null as line from l where line is null
    union all select null, null, null, line from l where line is not null and line <> 'none' union all select null, null, null, line from l where line = 'none'""")
def quarantined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines, some of which are blank, broken or no object of the schema, read back as rows and lines set aside."""
    i = F.col("event_id")
    number = i.cast("string")
    row = F.to_json(F.struct(i, F.col("event_type").alias("kind"), F.when(i % 10 != 6, F.struct(F.col("user_id").alias("user"))).alias("note"), F.lit(1).alias("more")))
    line = F.when(i % 10 == 1, F.concat(F.lit("["), number, F.lit("]"))).when(i % 10 == 2, F.concat(F.lit('{"event_id": '), number)).when(i % 10 == 3, "none")
    line = line.when(i % 10 == 4, F.concat(F.lit('{"event_id":"x'), number, F.lit('"}'))).when(i % 10 == 5, F.concat(row, F.lit("\n\n  "))).otherwise(row)
    folder = work_folder(spark, "lines")
    load(spark, sf_dir, "events").select(line.alias("value")).write.text(folder)
    good, bad = S.read_jsonl(spark, folder, OBSERVATION)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = good.select("event_id", "kind", F.col("note.user").alias("user"), none("string", "line"))
    return rows.unionByName(bad.select(none("long", "event_id"), none("string", "kind"), none("long", "user"), F.col("value").alias("line")))


@query("""select c_nationkey::bigint as nation, c_mktsegment as segment, count(*) as n_orders, count(*) filter (o_orderstatus = 'F') as n_done, max(o_orderkey) as last_order
    from orders join customer on o_custkey = c_custkey group by all""")
def summary_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order summaries written as one JSON file a nation and segment in a tree, beside files of other names, found by pattern and read with their paths."""
    joined = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    summary = joined.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done"), F.max("o_orderkey").alias("last_order"))
    folder = work_folder(spark, "tree")
    summary.write.partitionBy("c_nationkey", "c_mktsegment").json(f"{folder}/runs")
    load(spark, sf_dir, "nation").select(F.col("n_name").alias("value")).write.text(f"{folder}/runs/notes")
    schema = StructType().add("n_orders", LongType()).add("n_done", LongType()).add("last_order", LongType())
    rows = S.read_tree(spark, folder, "part-*.json", schema)
    part = lambda name: F.regexp_extract("path", f"{name}=([^/]*)/", 1)
    return rows.select(part("c_nationkey").cast("long").alias("nation"), F.url_decode(part("c_mktsegment")).alias("segment"), "n_orders", "n_done", "last_order")


@query("""with f as (select source, lang, count(*) || ' ' || sum(strlen(coalesce(text, ''))) || ' ' || min(doc_id) || ' ' || max(doc_id) || chr(10) as body from documents where source is not null and lang is not null group by all)
    select source || '/' || lang as path, strlen(body) as bytes, sha256(body) as sha256, '.txt' as extension from f""")
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each source and language, written below a folder, beside a skipped one; sizes and digests as found."""
    docs = load(spark, sf_dir, "documents").where("source is not null and lang is not null")
    size = F.sum(F.octet_length(F.coalesce("text", F.lit(""))))
    body = docs.groupBy("source", "lang").agg(F.concat_ws(" ", F.count("*").cast("string"), size.cast("string"), F.min("doc_id").cast("string"), F.max("doc_id").cast("string")).alias("value"))
    folder = work_folder(spark, "files")
    body.write.partitionBy("source", "lang").text(f"{folder}/kept")
    body.select("value").write.text(f"{folder}/node_modules/x")
    found = S.inventory(spark, folder)
    part = lambda name: F.url_decode(F.regexp_extract("path", f"/{name}=([^/]*)/", 1))
    return found.select(F.concat(part("source"), F.lit("/"), part("lang")).alias("path"), "bytes", "sha256", "extension")


@query("""with v as (select o_custkey, 'backup/c' || o_custkey as key, 'v' || o_orderkey as version_id, o_orderkey = max(o_orderkey) over (partition by o_custkey) as is_latest from orders)
    select key, version_id from v where not (is_latest and o_custkey in (select c_custkey from customer where c_acctbal > 0))""")
def keep_list_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions to delete by a keep list that is written tab-separated, with blank lines, and read back: all but the latest of customers in credit."""
    folder = work_folder(spark, "keep")
    key = lambda c: F.concat(F.lit("backup/c"), F.col(c).cast("string"))
    kept = load(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.concat(key("c_custkey"), F.lit("\t"), "c_name", F.lit("\n")).alias("value"))
    kept.write.text(folder)
    orders = load(spark, sf_dir, "orders")
    last = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"))
    versions = orders.join(last, "o_custkey").select(key("o_custkey").alias("key"), F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("version_id"), (F.col("o_orderkey") == F.col("last")).alias("is_latest"))
    return deletion_plan(versions, S.read_keep_keys(spark, folder, "backup/"), "backup/")


@query("""select 'run-' || (event_id % 4) as run_id, event_type as shard, user_id, count(*) as n, min(event_id) as first, max(event_id) as last from events group by all""")
def receipt_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended as receipts in two goes to a sink by run and shard, and read back."""
    folder = work_folder(spark, "receipts")
    rows = load(spark, sf_dir, "events").select("event_id", "user_id", F.concat(F.lit("run-"), (F.col("event_id") % 4).cast("string")).alias("run_id"), F.col("event_type").alias("shard"))
    S.append_receipts(rows.where("user_id % 3 = 0"), folder)
    S.append_receipts(rows.where("user_id % 3 <> 0 or user_id is null"), folder)
    schema = StructType().add("event_id", LongType()).add("user_id", LongType()).add("run_id", StringType()).add("shard", StringType())
    back = spark.read.schema(schema).json(folder)
    return back.groupBy("run_id", "shard", "user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("""select '{"agent":' || case when p_partkey % 4 = 0 then 'null' else '"' || p_brand || '"' end || ',"counts":{"' || p_type || '":' || p_size || ',"zz":1},"runs":[{"id":' || p_partkey
    || ',"state":' || case when p_partkey % 3 = 0 then 'null' else '"ok"' end || '}],"zone":"' || p_name || '"}' as line from part""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as report objects with nested structs and maps, written with sorted keys and read back as text."""
    k = F.col("p_partkey")
    run = F.struct(F.when(k % 3 > 0, "ok").alias("state"), k.alias("id"))
    counts = F.create_map(F.lit("zz"), F.lit(1), F.coalesce("p_type", F.lit("-")), F.col("p_size").cast("int"))
    rows = load(spark, sf_dir, "part").select(F.col("p_name").alias("zone"), F.array(run).alias("runs"), counts.alias("counts"), F.when(k % 4 > 0, F.col("p_brand")).alias("agent"))
    folder = work_folder(spark, "report")
    S.write_report(rows, folder)
    return spark.read.text(folder).select(F.col("value").alias("line"))


@query("""select p_partkey as feed, p_name as name, p_size::bigint as size from part union all select p_partkey, p_brand, null from part where p_partkey % 3 > 0 union all select p_partkey, null, 7 from part where p_partkey % 5 = 0""")
def feed_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product feeds with lists of different lengths, each element cut to the same fields."""
    k = F.col("p_partkey")
    item = lambda name, size: F.struct(k.alias("feed"), F.col("p_type").alias("kind"), name.alias("name"), size.cast("long").alias("size"), F.lit("x").alias("more"))
    none = F.lit(None).cast("string")
    items = F.array_compact(F.array(item(F.col("p_name"), F.col("p_size")), F.when(k % 3 > 0, item(F.col("p_brand"), none)), F.when(k % 5 == 0, item(none, F.lit(7)))))
    return S.project_items(load(spark, sf_dir, "part").select(items.alias("items")), "items", ["feed", "name", "size"])


@query("""with f as (select * from orders qualify row_number() over (partition by o_custkey, o_orderstatus order by o_orderdate, o_orderkey) = 1),
    l as (select * from orders qualify row_number() over (partition by o_custkey, o_orderstatus order by o_orderdate desc, o_orderkey desc) = 1)
    select f.o_custkey as customer, f.o_orderstatus as status, f.o_orderkey as first_order, f.o_orderpriority as first_priority, l.o_orderkey as last_order, l.o_orderpriority as last_priority from f join l on f.o_custkey = l.o_custkey and f.o_orderstatus = l.o_orderstatus""")
def first_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last order of each customer and status, as whole rows."""
    rows = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), "o_orderdate", "o_orderkey", "o_orderpriority")
    keys, order = ["customer", "status"], ["o_orderdate", "o_orderkey"]
    named = lambda df, which: df.select(*keys, F.col("o_orderkey").alias(f"{which}_order"), F.col("o_orderpriority").alias(f"{which}_priority"))
    return named(first_seen(rows, keys, order), "first").join(named(first_seen(rows, keys, order, last=True), "last"), keys)


@query(r"""with d as (select doc_id, case doc_id % 4 when 0 then 'Token = abc' || doc_id || '  x ' when 1 then '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || doc_id || chr(10) || '-----END RSA PRIVATE KEY----- then API-key: k' || doc_id || ' mytoken=1 ' else '' end || coalesce(text, '') as t from documents),
    k as (select doc_id, regexp_replace(t, '(?is)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----', '[REDACTED]', 'g') as t from d),
    s as (select doc_id, regexp_replace(t, '(?i)\b(token|secret|password|api[_-]?key|authorization)\b(\s*[:=]\s*)\S+', '\1\2[REDACTED]', 'g') as t from k),
    c as (select doc_id, left(trim(regexp_replace(t, '[\s\x{A0}]+', ' ', 'g')), 1200) as t from s)
    select doc_id, sha256(t) as redacted, contains(t, '[REDACTED]') as touched from c""")
def redacted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with keys and passwords planted, redacted and cut to the 1,200 characters that a log shows."""
    i = F.col("doc_id")
    number = i.cast("string")
    block = F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), number, F.lit("\n-----END RSA PRIVATE KEY----- then API-key: k"), number, F.lit(" mytoken=1 "))
    head = F.when(i % 4 == 0, F.concat(F.lit("Token = abc"), number, F.lit("  x "))).when(i % 4 == 1, block).otherwise("")
    rows = load(spark, sf_dir, "documents").select("doc_id", redact(F.concat(head, F.coalesce("text", F.lit("")))).alias("t"))
    return rows.select("doc_id", F.sha2("t", 256).alias("redacted"), F.col("t").contains("[REDACTED]").alias("touched"))
