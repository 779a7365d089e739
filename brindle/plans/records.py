"""Queries on checks, classes and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import records as R
from brindle.operators.tiers import EVIDENCE_TIERS
from brindle.plans.registry import load, query


@query("""select o_orderkey, array_to_string(list_sort(list_filter([case when o_orderkey % 11 = 0 then 'bad_calls' end, case when o_orderkey % 13 = 0 then 'bad_latency' end, case when o_custkey % 7 = 3 then 'best_not_a_candidate' end, case when o_orderkey % 17 = 0 then 'outcome_visible' end, case when o_orderkey % 19 = 0 then 'repeated_candidates' end], lambda x: x is not null)), ',') as errors from orders""")
def fork_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions made of orders, some of them faulty, with the rules that they break."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    names = F.when(k % 19 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    rows = load(spark, sf_dir, "orders").select("o_orderkey", names.alias("candidates"), F.lit("a").alias("chosen_candidate"), F.when(c % 7 == 3,
        "z").otherwise("b").alias("hindsight_best_candidate"), (k % 17 == 0).alias("outcome_visible"), F.when(k % 13 == 0,
        -1.0).otherwise(F.col("o_totalprice")).alias("decision_latency_ms"), F.when(k % 11 == 0, 0).otherwise(1).alias("decision_calls"))
    return R.check(rows, ["o_orderkey"], R.fork_rules()).withColumn("errors", F.array_join("errors", ","))


@query("""with r as (select event_id, case when event_id % 9 = 0 then '  ' else event_type end as kind, case when event_id % 10 = 0 then -value else value end as value, user_id from events), u as (select user_id, count(*) as n from events group by 1)
    select event_id, array_to_string(list_sort(list_filter([case when trim(kind) = '' then 'blank:kind' end, case when value < 0 then 'negative:value' end, case when kind not in ('click', 'view') then 'unknown:kind' end, case when n > 1 then 'repeated:user_id' end], lambda x: x is not null)), ',') as errors from r join u using (user_id)""")
def record_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of event records, repeated users among them."""
    i = F.col("event_id")
    rows = load(spark, sf_dir, "events").select("event_id", "user_id", F.when(i % 9 == 0, "  ").otherwise(F.col("event_type")).alias("kind"),
        F.when(i % 10 == 0, -F.col("value")).otherwise(F.col("value")).alias("value"))
    rules = R.filled("kind") | R.not_negative("value") | R.one_of("kind", ("click", "view"))
    return R.check(rows, ["event_id"], rules, unique="user_id").withColumn("errors", F.array_join("errors", ","))


TIERS_SQL = "['" + "', '".join(EVIDENCE_TIERS) + "']"


@query(f"""with t as (select user_id, case event_type when 'click' then 'Production ' when 'view' then 'integration_runtime' when 'purchase' then 'live_provider' when 'signup' then case when value > 50 then 'deterministic_contract' else 'simulated_provider' end
        when 'error' then case when value > 90 then 'somewhere' else 'live_source_acquisition' end end as tier from events),
    r as (select user_id, nullif(coalesce(list_position({TIERS_SQL}, lower(trim(tier))), 0), 0) as k from t)
    select user_id, {TIERS_SQL}[min(k)] as least_tier, bool_or(k is null) as untyped from r group by 1""")
def evidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weakest evidence tier of each user's events, whose kinds and values stand for tiers."""
    kind, v = F.col("event_type"), F.col("value")
    tier = F.when(kind == "click", "Production ").when(kind == "view", "integration_runtime").when(kind == "purchase", "live_provider")
    tier = tier.when(kind == "signup", F.when(v > 50, "deterministic_contract").otherwise("simulated_provider")).when(kind == "error", F.when(v > 90, "somewhere").otherwise("live_source_acquisition"))
    t = load(spark, sf_dir, "events").select("user_id", tier.alias("tier"))
    return R.least_tier(t, ["user_id"], "tier")


@query("select source, doc_id, n_chars, row_number() over (partition by source order by n_chars desc, doc_id) as place from documents qualify place <= 5")
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five longest documents of each source."""
    rows = R.top_k(load(spark, sf_dir, "documents"), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 5)
    return rows.select("source", "doc_id", "n_chars", F.col("place").cast("long").alias("place"))


@query("""with n as (select o_orderkey as k, o_totalprice as d, case o_orderstatus when 'F' then 'info' when 'O' then 'high' else 'warn' end as severity from orders), s as (select o_orderkey as k, case when o_orderkey % 2 = 0 then o_totalprice else 0 end as d from orders where o_orderkey % 3 <> 0)
    select n.k, case when severity = 'info' then 'skip' when s.k is null then 'insert' when s.d = n.d then 'skip' when severity = 'high' then 'update_and_notify' else 'update' end as action from n left join s on n.k = s.k""")
def upsert_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What storing new findings over older ones would do."""
    o = load(spark, sf_dir, "orders")
    new = o.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("d"), F.when(F.col("o_orderstatus") == "F",
        "info").when(F.col("o_orderstatus") == "O", "high").otherwise("warn").alias("severity"))
    stored = new.where("k % 3 <> 0").select("k", F.when(F.col("k") % 2 == 0, F.col("d")).otherwise(0.0).alias("d"))
    return R.upsert_plan(new, stored, "k", "d", "severity")


@query("""with a as (select distinct c_custkey as k from customer), b as (select distinct o_custkey + case when o_orderkey % 50 = 0 then 1000000 else 0 end as k from orders) select k, 'missing' as problem from a where k not in (select k from b) union all select k, 'undeclared' from b where k not in (select k from a)""")
def stale_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without orders, and orders of unknown customers."""
    found = load(spark, sf_dir, "orders").select((F.col("o_custkey") + F.when(F.col("o_orderkey") % 50 == 0, 1000000).otherwise(0)).alias("k"))
    return R.missing_both_ways(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), found, "k")


@query("""select l_orderkey, case when bool_or(l_linestatus = 'O') then 'running' when bool_and(l_linestatus = 'F') then 'verifying' else 'unknown' end as state from lineitem group by 1""")
def child_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the states of their lines."""
    return R.reconcile(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_linestatus", ("O",), ("F",))


@query("""select o_orderkey as k, o_orderpriority as expected, case when o_orderkey % 4 = 0 then null when o_orderkey % 6 = 1 then '5-LOW' else o_orderpriority end as actual from orders where o_orderkey % 4 = 0 or (o_orderkey % 6 = 1 and o_orderpriority <> '5-LOW')""")
def catalog_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against actual values; a part is missing or changed."""
    e = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("value"))
    a = e.where("k % 4 <> 0").withColumn("value", F.when(F.col("k") % 6 == 1, "5-LOW").otherwise(F.col("value")))
    return R.drift(e, a, ["k"])


@query("""with c as (select o_orderkey as k, coalesce(nullif(trim(case when o_orderkey % 31 = 0 then ' ' else o_orderpriority end), ''), 'unknown') as category, case when o_orderkey % 7 = 1 then 'old_vs_new' else 'current' end as temporal,
      case when o_custkey % 2 = 0 then ['github', 'oem'] else ['github'] end as families, o_custkey % 2 = 0 and o_custkey % 3 = 0 as lost, o_orderstatus = 'P' as cut, o_orderkey % 11 = 0 as bare, o_orderkey % 7 = 1 and o_orderkey % 2 = 0 as loose from orders),
    t as (select *, lost or cut or bare or loose as failed, list_filter([case when lost then 'oem' end, case when cut then '__missing_required_stage__' end, case when bare then '__citations_not_planned__' end, case when loose then '__temporal_reconciliation_missing__' end], lambda x: x is not null) as causes from c),
    r as (select 'category' as kind, category as value, failed from t union all select 'temporal', temporal, failed from t union all select 'all', '', failed from t union all select 'project', '', failed from t where category in ('1-URGENT', '2-HIGH')
      union all select 'family', unnest(families), failed from t union all select 'cause', unnest(causes), failed from t)
    select kind, value, count(*) as n, count(*) filter (failed) as failed from r group by all""")
def case_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query cases made of orders, with plans that lack sources, stages, citations or a reconciliation of old and new."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    words = lambda *x: F.array(*[F.lit(y) for y in x])
    cases = load(spark, sf_dir, "orders").select(
        F.when(k % 31 == 0, " ").otherwise(F.col("o_orderpriority")).alias("category"), F.when(k % 7 == 1, "old_vs_new").alias("temporal"),
        F.when(c % 2 == 0, words("github", "oem")).otherwise(words("github")).alias("families"), F.when(c % 6 == 0, words("github", "reddit")).otherwise(words("oem", "github")).alias("planned"),
        F.when(F.col("o_orderstatus") == "P", words("plan", "search")).otherwise(words("plan", "search", "verify")).alias("planned_stages"), (k % 11 != 0).alias("citations"), F.when(k % 2 == 1, True).alias("reconciles"))
    return R.corpus_coverage(R.plan_checks(cases, ("plan", "verify")), ("1-URGENT", "2-HIGH"))
