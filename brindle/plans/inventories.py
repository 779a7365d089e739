"""Queries on digests of inventories and their differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import digest_tree as D
from brindle.plans.registry import load, query


def tree_sql(lines: str) -> str:
    """CTEs from ``lines`` (source, k, v) to ``roots`` (source, n_lines, digest), for groups of up to 65,536 different lines."""
    up = lambda size: f"""t{size} as (select source, case when length(prefix) = {size + 1} then substr(prefix, 1, {size}) else prefix end as prefix, sum(n) as n,
      case when max(length(prefix)) = {size + 1} then sha256(string_agg(prefix || ':' || digest, chr(10) order by prefix)) else max(digest) end as digest from t{size + 1} group by source, 2)"""  # noqa: E731
    return f"""{lines}, l as (select source, k, sha256(k) as h, sha256(length(k) || ':' || k || v) as d, count(*) as n from lines group by all),
    deep as (select case when m <= 16 then 0 when m <= 256 then 1 when m <= 4096 then 2 else 3 end as depth from (select max(c) as m from (select count(*) as c from l group by source))),
    t3 as (select source, substr(h, 1, depth) as prefix, sum(n) as n, sha256(string_agg(d || ':' || n, chr(10) order by h, d)) as digest from l, deep group by all),
    {up(2)}, {up(1)}, {up(0)}, roots as (select source, n::bigint as n_lines, digest from t0)"""


@query(f"with {tree_sql('lines as (select source, doc_id::varchar as k, coalesce(text, chr(0)) as v from documents)')} select * from roots")
def inventory_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each source's documents, whatever their order."""
    return D.roots(document_lines(load(spark, sf_dir, "documents")), ["source"])


def document_lines(docs: DataFrame) -> DataFrame:
    return D.digest_lines(docs, ["source"], F.col("doc_id"), F.coalesce("text", F.lit("\0")))


@query("""with r as (select doc_id + case when doc_id % 43 = 0 then 1000000000 else 0 end as doc_id, source, case when doc_id % 37 = 0 then coalesce(text, '') || '!' else text end as text from documents where doc_id % 41 > 0 or doc_id % 37 = 0)
    select coalesce(a.source, b.source) as source, coalesce(a.doc_id, b.doc_id)::varchar as key, case when b.doc_id is null then 'removed' when a.doc_id is null then 'added' else 'changed' end as change
    from documents a full join r b on a.doc_id = b.doc_id and a.source = b.source where a.doc_id is null or b.doc_id is null or a.text is distinct from b.text""")
def inventory_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a later inventory in which some are removed, renamed or changed."""
    docs, i = load(spark, sf_dir, "documents"), F.col("doc_id")
    later = docs.where("doc_id % 41 > 0 or doc_id % 37 = 0").select((i + F.when(i % 43 == 0, 1000000000).otherwise(0)).alias("doc_id"), "source", F.when(i % 37 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return D.inventory_changes(document_lines(docs), document_lines(later), ["source"])


MANIFEST_SQL = """lines as (select source, doc_id::varchar as k, '{"case_id":' || doc_id || ',"label":' || coalesce('"' || nullif(lang, 'en') || '"', 'null') || '}' as v from documents)"""


@query(f"with {tree_sql(MANIFEST_SQL)} select source, n_lines as n_cases, digest from roots")
def manifest_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each source's cases in canonical form."""
    rows = load(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("case_id"), F.nullif("lang", F.lit("en")).alias("label"))
    line = F.to_json(F.struct("case_id", "label"), {"ignoreNullFields": "false"})  # keys sorted, nulls kept
    return D.roots(D.digest_lines(rows, ["source"], F.col("case_id"), line), ["source"]).withColumnRenamed("n_lines", "n_cases")
