"""Queries on contradictions between typed claims, made of order lines and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import contradiction as C
from brindle.plans.registry import load, query

UNITS = {"cent": ("money", 1), "dime": ("money", 10), "euro": ("money", 100)}
#: Order lines as claims on what a part costs in a year, in different units; the fifth line of an order only says where prices start.
CLAIMS_SQL = """c as (select l_orderkey * 10 + l_linenumber as id, l_partkey as entity, year(l_shipdate) as span, case l_linenumber % 3 when 0 then 'cent' when 1 then 'euro' else 'guilder' end as unit,
      round(l_extendedprice)::bigint * case when l_linenumber % 3 = 0 then 100 else 1 end * case when l_linenumber = 4 then -1 else 1 end as value, l_linenumber from lineitem),
    k as (select id, entity, span, case when unit = 'guilder' then unit else 'money' end as dimension, case when unit = 'euro' then value * 100 else value end as amount from c where l_linenumber <> 5 and id % 17 > 0)"""


def price_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    unit = F.when(line % 3 == 0, " Cent").when(line % 3 == 1, "euro").otherwise("guilder")
    value = F.round("l_extendedprice").cast("long") * F.when(line % 3 == 0, 100).otherwise(1) * F.when(line == 4, -1).otherwise(1)
    rows = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + line).alias("id"), F.col("l_partkey").alias("entity"), F.year("l_shipdate").cast("long").alias("span"), unit.alias("unit"), value.alias("value"), F.when(line == 5, "Starts_at").alias("qualifier"))
    return C.normalized(rows.withColumn("value", F.when(F.col("id") % 17 > 0, F.col("value"))), UNITS)


BUCKET = ["entity", "span", "dimension"]


@query(f"""with {CLAIMS_SQL}, g as (select entity, span, dimension, amount, min(id) as rep, count(*) as n from k group by all),
    p as (select a.*, b.amount as other, b.rep as other_rep, b.n as other_n from g a join g b using (entity, span, dimension) where abs(a.amount - b.amount) * 100 > 30 * greatest(abs(a.amount), abs(b.amount)))
    select entity, span, dimension, amount, rep, n, coalesce(sum(other_n) filter (other < amount), 0)::bigint as n_below, coalesce(sum(other_n) filter (other > amount), 0)::bigint as n_above,
      arg_max(other_rep, other) filter (other < amount) as below_rep, arg_min(other_rep, other) filter (other > amount) as above_rep from p group by all""")
def typed_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of a part in a year that differ by more than 30 per cent from others: classes, numbers on both sides, nearest opponents."""
    out = C.amount_conflicts(price_claims(spark, sf_dir), BUCKET, 30)
    return out.select(*BUCKET, F.col("amount").cast("long").alias("amount"), "rep", "n", "n_below", "n_above", "below_rep", "above_rep")


@query(f"with {CLAIMS_SQL} select id, min(id) over (partition by entity, span, dimension, amount) as rep from k")
def contradiction_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each price claim with its class."""
    return C.members(price_claims(spark, sf_dir), BUCKET, "amount")


@query("""with c as (select event_id as id, user_id as entity, date_trunc('month', ts) as span, event_type as category, event_id % 5 = 0 as negated from events),
    g as (select entity, span, category, negated, min(id) as rep, count(*) as n from c group by all),
    p as (select a.*, b.rep as other_rep, b.n as other_n from g a join g b on a.entity = b.entity and a.span = b.span and ((not a.negated and not b.negated and a.category <> b.category) or (a.negated <> b.negated and a.category = b.category)))
    select entity, span, category, negated, rep, n, sum(other_n)::bigint as n_other, min(other_rep) as other_rep from p group by all""")
def category_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user did in a month as mutually exclusive claims, every fifth one denied."""
    rows = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("entity"), F.date_trunc("month", "ts").cast("timestamp_ntz").alias("span"), F.col("event_type").alias("category"), (F.col("event_id") % 5 == 0).alias("negated"))
    return C.category_conflicts(rows, ["entity", "span"])
