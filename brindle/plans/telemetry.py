"""Queries on receipts, evaluation runs and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import evaluation as E
from brindle.operators import ledger as L
from brindle.operators import pages as G
from brindle.operators import telemetry as T
from brindle.plans.registry import load, query

RECEIPTS_SQL = """receipts as (select event_id, user_id as target, ts as recorded_at, cast(round(value) as bigint) as elapsed_ms,
    case event_type when 'click' then 'ok' when 'view' then 'ok' when 'signup' then 'empty' when 'purchase' then 'blocked' else 'error' end as status,
    case event_type when 'purchase' then 403 when 'error' then null else 200 end as http_status, user_id % 4 as shard from events)"""


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch receipts made of events: users are targets."""
    kind = F.col("event_type")
    return load(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("target"), F.col("ts").alias("recorded_at"),
        F.round("value").cast("long").alias("elapsed_ms"), F.when(kind.isin("click", "view"), "ok").when(kind == "signup",
        "empty").when(kind == "purchase", "blocked").otherwise("error").alias("status"), F.when(kind == "purchase", 403).when(kind == "error",
        None).otherwise(200).alias("http_status"), (F.col("user_id") % 4).alias("shard"))


SUMMARY_SQL = """count(*) as observations, count(*) filter (status <> 'ok') as failures, count(*) filter (status = 'ok') as n_ok, count(*) filter (status = 'empty') as n_empty,
    count(*) filter (status = 'blocked') as n_blocked, count(*) filter (status = 'resource_limited') as n_resource_limited, count(*) filter (status = 'error') as n_error, count(http_status) as http_seen, sum(elapsed_ms)::bigint as elapsed_ms"""


@query(f"with {RECEIPTS_SQL} select target, {SUMMARY_SQL} from receipts group by target")
def receipt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.summarize(receipts(spark, sf_dir), ["target"])


@query(f"""with {RECEIPTS_SQL}, s as (select target, {SUMMARY_SQL} from receipts group by target),
    h as (select *, case when n_blocked / observations >= 0.95 then 'blocked' when n_resource_limited / observations >= 0.95 then 'rate_limited'
        when n_error / observations >= 0.95 and http_seen = 0 then 'transport_error'
      when failures = 0 then 'healthy' when failures / observations >= 0.5 then 'degraded' else 'intermittent' end as health from s)
    select target, observations, failures, health, case health when 'blocked' then 'quarantine_until_manual_recheck'
        when 'rate_limited' then 'exponential_backoff_and_quarantine' when 'transport_error' then 'investigate_dns_tls_or_network_path'
      when 'healthy' then 'retain_normal_sampling' when 'degraded' then 'retain_for_targeted_recheck' else 'retain_with_failure_aware_retry' end as action from h""")
def target_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.target_health(receipts(spark, sf_dir), ["target"])


@query(f"""with {RECEIPTS_SQL}, r as (select status, elapsed_ms, row_number() over (partition by status order by elapsed_ms) - 1 as i, count(*) over (partition by status) as n from receipts)
    select status, min(elapsed_ms) as min_ms, max(elapsed_ms) filter (i = floor((n - 1) * 0.5)) as median_ms, max(elapsed_ms) filter (i = floor((n - 1) * 0.95)) as p95_ms, max(elapsed_ms) as max_ms from r group by status""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles by the index rule int((n - 1) * p)."""
    return T.exact_percentiles(receipts(spark, sf_dir), ["status"], "elapsed_ms", {"min_ms": 0.0, "median_ms": 0.5, "p95_ms": 0.95, "max_ms": 1.0})


@query(f"""with {RECEIPTS_SQL}, s as (select shard, {SUMMARY_SQL} from receipts group by shard),
    r as (select shard, elapsed_ms, row_number() over (partition by shard order by elapsed_ms) - 1 as i, count(*) over (partition by shard) as n from receipts),
    p as (select shard, max(elapsed_ms) filter (i = floor((n - 1) * 0.5)) as median_ms, max(elapsed_ms) filter (i = floor((n - 1) * 0.95)) as p95_ms from r group by shard)
    select count(*) as shards, sum(observations)::bigint as observations, round(sum(n_ok) / sum(observations), 6) as usable_rate,
        round(sum(n_blocked) / sum(observations), 6) as blocked_rate, round(sum(n_resource_limited) / sum(observations), 6) as limited_rate,
      round(sum(n_error) / sum(observations), 6) as error_rate, round(sum(n_empty) / sum(observations), 6) as empty_rate, round(sum(median_ms * observations) / sum(observations), 3) as median_ms, max(p95_ms) as p95_ms, 'WARN' as overall from s join p using (shard)""")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = receipts(spark, sf_dir)
    shards = T.summarize(r, ["shard"]).join(T.exact_percentiles(r, ["shard"], "elapsed_ms", {"median_ms": 0.5, "p95_ms": 0.95}), "shard")
    return T.scorecard(shards)


@query(f"""with {RECEIPTS_SQL} select target, count(*) filter (status <> 'ok') as failures, count(*) as observations, round(count(*) filter (status <> 'ok') / count(*), 6) as failure_rate from receipts group by target having count(*) filter (status <> 'ok') > 0 order by 4 desc, 1""")
def failing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.summarize(receipts(spark, sf_dir), ["target"]).where("failures > 0")
    return s.select("target", "failures", "observations", F.round(F.col("failures") / F.col("observations"), 6).alias("failure_rate")).orderBy(F.desc("failure_rate"), "target")


LD = '<script type="application/ld+json">{"@type":"Product"}</script>'
BLANK = "<!-- <title>no</title> --><script type=\'application/LD+JSON\'> </script>"


#: ``own`` without the references that escaping HTML makes; those of one name that need no semicolon may be cut short before it.
UNESCAPED = "own"
for entity, shown in (("&quot;?", """'"'"""), ("&(#39|#x27);?|&apos;", "chr(39)"), ("&lt;?", "'<'"), ("&gt;?", "'>'"), ("&amp;?", "'&'")):
    UNESCAPED = f"regexp_replace({UNESCAPED}, '{entity}', {shown}, 'g')"


@query(f"""with p as (select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) as own, case page_id % 12 when 0 then html || '{LD}' when 6 then html || '{LD}' || '{LD}'
        when 1 then '{BLANK.replace("'", "''")}' || html when 2 then replace(html, '<title>', '<title>Sale &lt;b&gt; <b>') when 3 then html || '<title>Two</title>' when 4 then chr(10) || ' ' when 5 then html || '<!--' else html end as html,
      case page_id % 11 when 0 then 403 when 1 then 401 when 2 then 429 when 3 then 503 when 4 then 404 when 5 then 200 end as http from pages),
    s as (select page_id, http, html, {UNESCAPED} as own, case page_id % 12 when 0 then 1 when 6 then 2 else 0 end as blocks,
      (len(string_split(lower(html), 'product')) + len(string_split(lower(html), 'itemprop="name"')) + len(string_split(lower(html), 'productid')) + len(string_split(lower(html), 'sku')) + len(string_split(lower(html), 'add-to-cart')) + len(string_split(lower(html), 'price')) - 6)::integer as hints from p)
    select page_id, left(case page_id % 12 when 2 then 'Sale <b> ' || own when 3 then own || ' Two' when 4 then '' else own end, 300) as title, blocks::integer as jsonld_blocks, hints as product_hints, strlen(html)::bigint as n_bytes,
      case when http in (401, 403) then 'blocked' when http = 429 then 'resource_limited' when http >= 400 then 'error' when page_id % 12 = 4 then 'empty' when hints > 0 or blocks > 0 then 'ok' else 'empty' end as status from s""")
def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, some with JSON-LD, hidden or second titles, markup in the title or an open comment, and with different HTTP answers."""
    i, h = F.col("page_id") % 12, F.col("html")
    page = F.when(i == 0, F.concat(h, F.lit(LD))).when(i == 6, F.concat(h, F.lit(LD + LD))).when(i == 1, F.concat(F.lit(BLANK), h)).when(i == 2, F.replace(h, F.lit("<title>"), F.lit("<title>Sale &lt;b&gt; <b>")))
    page = page.when(i == 3, F.concat(h, F.lit("<title>Two</title>"))).when(i == 4, "\n ").when(i == 5, F.concat(h, F.lit("<!--"))).otherwise(h)
    k = F.col("page_id") % 11
    http = F.when(k == 0, 403).when(k == 1, 401).when(k == 2, 429).when(k == 3, 503).when(k == 4, 404).when(k == 5, 200)
    return G.page_structure(load(spark, sf_dir, "pages").select("page_id", page.alias("html"), http.alias("http_status")))


RUNS_SQL = """obs as (select o_orderkey as run_id, o_orderpriority as model, o_orderstatus as agent_role, (o_custkey % 6)::varchar as lane, n as required_claims, n_r as correct_claims, n_n as supported_claims, n_a as missed_requirements, q as tool_calls, n as files_read,
    n_r as duplicate_actions, 0 as irrelevant_actions, n_a as unsupported_claims, q * 40 as input_tokens, q * 10 as output_tokens,
        0 as thinking_tokens, q * 20 as cached_tokens, n_a as compaction_events, q * 30 as context_peak_tokens, q // 2 as useful_tool_calls,
        n_r as self_corrections, n as successful_actions
    from orders join (select l_orderkey, count(*) as n, sum(l_quantity)::bigint as q, count(*) filter (l_returnflag = 'R') as n_r, count(*) filter (l_returnflag = 'N') as n_n, count(*) filter (l_returnflag = 'A') as n_a from lineitem group by 1) on l_orderkey = o_orderkey)"""
C3 = "round(greatest(0, least(1, {})), 3)"
SCORES_SQL = f"""{RUNS_SQL}, parts as (select *, {C3.format('correct_claims / required_claims')} as correctness, {C3.format('supported_claims / greatest(correct_claims, required_claims, 1)')} as evidence_quality,
    {C3.format('1.0::double - ' + C3.format('missed_requirements / greatest(required_claims, 1)'))} as completeness,
        {C3.format('1.0::double - least(1.0, (duplicate_actions + irrelevant_actions + unsupported_claims) / greatest(tool_calls + files_read, 1))')}
        as precision,
    {C3.format('(correct_claims + supported_claims + self_corrections) / greatest((input_tokens + output_tokens) / 1000.0::double, 1.0::double)')} as
        token_efficiency, {C3.format('useful_tool_calls / greatest(tool_calls, 1)')} as tool_efficiency,
    {C3.format('cached_tokens / greatest(input_tokens + output_tokens, 1) * 0.35::double + 1.0::double / (1 + compaction_events) * 0.35::double + (1.0::double - least(1.0::double, context_peak_tokens / greatest(input_tokens + output_tokens, 1))) * 0.30::double')} as context_efficiency,
    {C3.format('self_corrections / greatest(successful_actions, self_corrections, 1)')} as self_correction from obs),
    scores as (select *, {C3.format('0.0::double + correctness * 0.24::double + evidence_quality * 0.18::double + completeness * 0.16::double + precision * 0.14::double + token_efficiency * 0.10::double + tool_efficiency * 0.06::double + context_efficiency * 0.07::double + self_correction * 0.05::double')} as overall from parts)"""
METRICS_SQL = ", ".join(E.METRICS)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent runs made of orders: claims, actions and tokens from their lines."""
    flag = F.col("l_returnflag")
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("q"),
        *[F.count_if(flag == x).alias(f"n_{x.lower()}") for x in "RNA"])
    n, q, r, u, a, zero = (F.col(c) for c in ("n", "q", "n_r", "n_n", "n_a", "zero"))
    cols = {"required_claims": n, "correct_claims": r, "supported_claims": u, "missed_requirements": a, "tool_calls": q, "files_read": n,
        "duplicate_actions": r, "irrelevant_actions": zero, "unsupported_claims": a, "input_tokens": q * 40, "output_tokens": q * 10,
        "thinking_tokens": zero, "cached_tokens": q * 20, "compaction_events": a, "context_peak_tokens": q * 30, "useful_tool_calls": F.floor(q / 2),
        "self_corrections": r, "successful_actions": n}
    joined = load(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("zero", F.lit(0))
    return joined.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("agent_role"),
        (F.col("o_custkey") % 6).cast("string").alias("lane"), *[c.alias(k) for k, c in cols.items()])


@query(f"with {SCORES_SQL} select run_id, model, {METRICS_SQL} from scores")
def run_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.score_runs(runs(spark, sf_dir)).select("run_id", "model", *E.METRICS)


MEANS_SQL = ", ".join(f"avg({m}) as {m}" for m in E.METRICS)


@query(f"""with {SCORES_SQL}, g as (select 'model' as dimension, model as value, * from scores union all select 'agent_role', agent_role, * from scores union all select 'lane', lane, * from scores)
    select dimension, value, count(*) as runs, {', '.join(f'round(round(avg({m}), 3), 2) as {m}' for m in E.METRICS)} from g group by all""")
def score_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by model, role and lane in one pass; two places here, as means of floats may differ in their last digits."""
    m = E.mean_scores(E.score_runs(runs(spark, sf_dir)).withColumns({x: F.col(x).cast("decimal(10,3)") for x in E.METRICS}), ["model", "agent_role", "lane"])
    return m.select("dimension", "value", "runs", *[F.round(F.col(x).cast("double"), 2).alias(x) for x in E.METRICS])


@query(f"""with {SCORES_SQL} select run_id, model, overall, precision, correctness, row_number() over (partition by model order by overall desc, precision desc, correctness desc, run_id) as place from scores qualify place <= 10""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best runs of each model: overall, then precision, then correctness."""
    from pyspark.sql import Window

    order = Window.partitionBy("model").orderBy(F.desc("overall"), F.desc("precision"), F.desc("correctness"), "run_id")
    s = E.score_runs(runs(spark, sf_dir)).withColumn("place", F.row_number().over(order).cast("long")).where("place <= 10")
    return s.select("run_id", "model", "overall", "precision", "correctness", "place")


@query("""with f as (select o_orderpriority as model, o_orderkey % 3 as c, o_custkey % 3 as b, cast(o_totalprice as decimal(18,2)) as ms from orders)
    select model, count(*) as observations, count(*) filter (c = b) as correct_observations, round(count(*) filter (c = b) / count(*), 3) as decision_accuracy, round(avg(abs(c - b) / 2), 3) as mean_rank_distance, round(sum(ms)::double / count(*), 1) as mean_latency_ms from f group by model""")
def decision_forks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions between three candidates, made of orders."""
    names = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    pick = lambda k: F.element_at(names, (F.col(k) % 3 + 1).cast("int"))
    forks = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model"), names.alias("candidates"),
        pick("o_orderkey").alias("chosen_candidate"), pick("o_custkey").alias("hindsight_best_candidate"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("decision_latency_ms"))
    out = E.fork_report(forks, ["model"])
    return out.withColumn("mean_latency_ms", F.round(F.col("mean_latency_ms").cast("double"), 1))


@query("""with s as (select user_id % 7 as workload, event_type as stage, cast(value * 1000 as bigint) as us from events), r as (select *, row_number() over (partition by workload, stage order by us) - 1 as i, count(*) over (partition by workload, stage) as n from s)
    select workload, stage, max(us) filter (i = floor((n - 1) * 0.5)) as p50_us, max(us) filter (i = floor((n - 1) * 0.95)) as p95_us, max(us) filter (i = floor((n - 1) * 0.99)) as p99_us from r group by all""")
def stage_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("workload"), F.col("event_type").alias("stage"), F.round(F.col("value") * 1000).cast("long").alias("us"))
    return T.exact_percentiles(s, ["workload", "stage"], "us", {"p50_us": 0.5, "p95_us": 0.95, "p99_us": 0.99})


STAGES = ("click", "error", "purchase", "signup", "view")


@query("""with s as (select user_id * 100 + event_id % 100 as run, list(distinct event_type) as seen from events group by 1)
    select run, array_to_string(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: not list_contains(seen, x)), ',') as missing
    from s where len(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: not list_contains(seen, x))) > 0""")
def stage_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, a user's events by the last digits of their ids, that lack one of the required stages."""
    need = F.array(*[F.lit(x) for x in STAGES])
    run = F.col("user_id") * 100 + F.col("event_id") % 100
    seen = load(spark, sf_dir, "events").groupBy(run.alias("run")).agg(F.collect_set("event_type").alias("seen"))
    return seen.select("run", F.array_join(F.array_except(need, "seen"), ",").alias("missing")).where("missing <> ''")


DIMS_SQL = """dims as (select year(o_orderdate) as y, o_orderpriority as dimension, avg(o_totalprice) as value from orders group by all)"""


def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y"), F.col("o_orderpriority").alias("dimension")).agg(F.avg("o_totalprice").alias("value"))


@query(f"""with {DIMS_SQL}, n as (select * from dims where not (y % 3 = 0 and dimension = '2-HIGH') and not (y % 4 = 1 and dimension < '3')),
    w as (select c.y, c.dimension from n c join dims b on b.y + 1 = c.y and b.dimension = c.dimension where b.value - c.value > 1500),
    g as (select y, 5 - count(*) as n_missing, (select count(*) from w where w.y = n.y) as n_regressed from n where y > (select min(y) from dims) group by y)
    select y, n_missing, n_regressed, case when n_missing = 0 and n_regressed = 0 then 'PASS' else 'BLOCKED' end as state from g""")
def release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each year against the year before, a dimension for each priority class; some years lack some dimensions."""
    d = dimensions(spark, sf_dir)
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    before = d.withColumn("y", F.col("y") + 1)
    lacks = ((F.col("y") % 3 == 0) & (F.col("dimension") == "2-HIGH")) | ((F.col("y") % 4 == 1) & (F.col("dimension") < "3"))
    now = d.where(~lacks).join(before.select("y").distinct(), "y", "left_semi").withColumns({"critical": F.lit(True), "max_regression": F.lit(1500.0)})
    return E.release_gate(before, now, names, ["y"])


@query("""with r as (select o_orderpriority as identity, year(o_orderdate) * 100 + month(o_orderdate) as month, count(*) filter (o_orderstatus = 'F') as completed, count(*) filter (o_totalprice > 200000) as useful, count(*) filter (o_totalprice < 20000) as high, list_sort(list(distinct o_orderstatus)) as signals from orders group by all),
    s as (select *, case when month % 100 = 2 then 'partial' else 'completed' end as st from r),
    p as (select *, last_value(case when st = 'completed' then {'completed': completed, 'useful': useful, 'high': high, 'signals': signals}
        end ignore nulls) over (partition by identity order by month rows between unbounded preceding and 1 preceding) as prior from s)
    select identity, month, case when prior is null then 'NO_BASELINE'
        when st <> 'completed' or completed < prior.completed or useful < prior.useful or high > prior.high then 'REGRESSED'
        when completed > prior.completed or useful > prior.useful or high < prior.high then 'IMPROVED' else 'STABLE' end as decision,
      completed - prior.completed as completed_delta, useful - prior.useful as useful_delta, high - prior.high as high_delta, case when prior is not null then array_to_string(list_filter(signals, lambda x: not list_contains(prior.signals, x)), ',') end as added, case when prior is not null then array_to_string(list_filter(prior.signals, lambda x: not list_contains(signals, x)), ',') end as resolved from p""")
def baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly runs of each priority class against the last completed month."""
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("identity"),
        (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("month")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("completed"),
        F.count_if(F.col("o_totalprice") > 200000).alias("useful"), F.count_if(F.col("o_totalprice") < 20000).alias("high"),
        F.sort_array(F.collect_set("o_orderstatus")).alias("signals"))
    d = E.baseline_diff(o.withColumn("execution_state", F.when(F.col("month") % 100 == 2, "partial").otherwise("completed")), ["identity"], "month")
    return d.withColumns({"month": F.col("month").cast("long"), "added": F.array_join("added", ","), "resolved": F.array_join("resolved", ",")})


@query("""with y as (select o_custkey as k, year(o_orderdate) as y, count(*) as n, sum(o_totalprice::decimal(18,2)) as t from orders group by all),
    p as (select c.k, c.y, ((b.t * 100)::hugeint // 10000)::double as bi, (b.n * 10)::double as bo, ((c.t * 100)::hugeint // 10000)::double as ci, (c.n * 10)::double as co,
        b.n % 4 <> 0 as ba, c.n % 5 <> 0 as ca, b.n as bn, c.n as cn from y b join y c on b.k = c.k and b.y + 1 = c.y),
    r as (select k, y, case when ca and not ba then 'candidate is accepted while baseline is not' when not ca then 'candidate is not accepted'
        when bi <= 0 then 'baseline token measurements must be positive' when (ci - bi) / bi > 0.10 then 'candidate input-token growth exceeds gate'
      when (ci + co - bi - bo) / (bi + bo) > 0.10 then 'candidate total-token growth exceeds gate' when ci + co <= bi + bo then 'candidate accepted with non-increasing token use'
      when cn / (cn + 1) > bn / (bn + 1) then 'candidate spends limited extra tokens for better evidence retention' else 'candidate did not justify additional token use' end as reason from p)
    select k, y, reason, reason in ('candidate is accepted while baseline is not', 'candidate accepted with non-increasing token use', 'candidate spends limited extra tokens for better evidence retention') as accepted from r""")
def token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's year against the year before, read as token use."""
    y = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("t"))

    def side(p: str, mod: int) -> list:
        return [F.floor(F.col("t") / 100).cast("double").alias(f"{p}_input"), (F.col("n") * 10).alias(f"{p}_output"),
            F.col("n").alias(f"{p}_retained"), F.lit(1).alias(f"{p}_dropped"), (F.col("n") % mod != 0).alias(f"{p}_accepted"),
            F.lit(1).alias(f"{p}_calls"), F.lit(1).alias(f"{p}_cache_hits")]

    b = y.select("k", (F.col("y") + 1).alias("y"), *side("b", 4))
    return E.compare_efficiency(b.join(y.select("k", "y", *side("c", 5)), ["k", "y"])).select("k", F.col("y").cast("long").alias("y"), "reason", "accepted")


CHAIN_SQL = """ranked as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as seq, sha256(user_id || ':' || event_id) as fp, cast(round(value) as bigint) as units from events),
    chain as (select *, case when event_id % 50 = 0 then 'broken' else lag(fp) over (partition by user_id order by seq) end as parent from ranked)"""


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receipt chain a user, every fiftieth link broken."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fp = F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_id").cast("string")), 256)
    r = load(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).alias("seq"), fp.alias("fingerprint"),
        F.round("value").cast("long").alias("units"), F.lag(fp).over(w).alias("before"))
    return r.withColumn("parent_fingerprint", F.when(F.col("event_id") % 50 == 0, "broken").otherwise(F.col("before"))).drop("before")


@query(f"""with {CHAIN_SQL} select user_id, count(*) as n_receipts, bool_and(seq = 1 or parent = prev) as linked, sum(units)::bigint as units, sum(units) <= 1000 as within from (select *, lag(fp) over (partition by user_id order by seq) as prev from chain) group by user_id""")
def receipt_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.validate_chain(chain(spark, sf_dir), "user_id", "seq", 1000)


@query("""with l as (select distinct user_id || '' as task_id, 'https://x.example/' || event_type as url from events where event_id % 3 = 0),
    p as (select event_id, user_id || '' as task_id, 'https://x.example/' || event_type as url, case when event_id % 7 = 0 then 'contradiction_check'
        when event_id % 11 = 0 then 'because' end as force_reason from events where event_id % 3 > 0)
    select event_id, l.url is null or coalesce(force_reason = 'contradiction_check', false) as allowed, case when l.url is null then 'new_source' when force_reason = 'contradiction_check' then force_reason else 'already_visited_for_task' end as reason from p left join l on p.task_id = l.task_id and p.url = l.url""")
def revisit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the events is the ledger of visits, the others propose visits."""
    e, i = load(spark, sf_dir, "events"), F.col("event_id")
    rows = e.select("event_id", F.col("user_id").cast("string").alias("task_id"), F.concat(F.lit("https://x.example/"), "event_type").alias("url"))
    proposed = rows.where(i % 3 > 0).withColumn("force_reason", F.when(i % 7 == 0, "contradiction_check").when(i % 11 == 0, "because"))
    return L.revisit_gate(proposed, rows.where(i % 3 == 0)).select("event_id", "allowed", "reason")


STATES = {"click": "Running", "view": "streaming", "signup": "submitted", "purchase": "success", "error": "failed"}


@query("""with recursive s as (select user_id, row_number() over (partition by user_id order by ts, event_id) as i, count(*) over (partition by user_id) as n, case event_type when 'click' then 'RUNNING' when 'view' then 'STREAMING' when 'signup' then 'QUEUED' when 'purchase' then 'COMPLETE' else 'FAILED' end as st from events),
    f as (select user_id, i, n, st as state from s where i = 1 union all
      select f.user_id, s.i, f.n, case when s.st = f.state then s.st when f.state = 'RUNNING' and s.st in ('STREAMING', 'COMPLETE',
        'FAILED') then s.st when f.state = 'STREAMING' and s.st in ('COMPLETE', 'FAILED') then s.st
        when f.state = 'QUEUED' and s.st in ('RUNNING', 'STREAMING', 'COMPLETE', 'FAILED') then s.st when f.state = 'UNKNOWN' and s.st in ('RUNNING',
        'STREAMING', 'COMPLETE') then s.st else 'UNKNOWN' end
      from f join s on s.user_id = f.user_id and s.i = f.i + 1)
    select user_id, state, n as n_events from f where i = n""")
def lifecycle_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that each user's events leave."""
    raw = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    e = load(spark, sf_dir, "events").withColumn("raw_state", F.try_element_at(raw, F.col("event_type")))
    return L.fold_lifecycle(e, "user_id", ["ts", "event_id"], "raw_state")


@query(f"""with {CHAIN_SQL}, g as (select distinct user_id, seq % 4 as input from chain where units % 2 = 0 and (seq % 5 = 0 or seq < 4)), q as (select distinct user_id, seq % 4 as input from chain)
    select q.user_id, q.input, g.input is not null as eligible from q left join g on q.user_id = g.user_id and q.input = g.input""")
def resume_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which (user, input) have an unexpired completed receipt."""
    c = chain(spark, sf_dir).select(F.col("user_id").alias("request"), (F.col("seq") % 4).cast("long").alias("input"), "seq", "units")
    now = F.lit("2024-01-01").cast("timestamp")
    r = c.select("request", "input", (F.col("units") % 2 == 0).alias("resume_eligible"), F.lit("completed").alias("status"),
        F.when(F.col("seq") % 5 == 0, None).when(F.col("seq") < 4, F.lit("2025-01-01").cast("timestamp")).otherwise(now).alias("expires_at"))
    return L.resume_eligible(r, c.select("request", "input").distinct(), now).select(F.col("request").alias("user_id"), "input", "eligible")


@query("""with v as (select 'backup/' || o_custkey as key, o_orderkey || '' as version_id, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1 as is_latest, o_custkey from orders) select key, version_id from v where not (o_custkey % 2 = 0 and is_latest)""")
def retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of their customer's backup; even customers are kept."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    v = load(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("backup/"), F.col("o_custkey").cast("string")).alias("key"),
        F.col("o_orderkey").cast("string").alias("version_id"), (F.row_number().over(w) == 1).alias("is_latest"))
    return L.deletion_plan(v, v.where("o_custkey % 2 = 0"), "backup/")


@query("""with r as (select 'b' || o_orderkey as name, o_custkey as sha, o_orderdate as made, o_orderkey % 97 = 0 as d, o_orderkey % 13 = 0 as pr, o_orderkey % 17 = 0 as pt, o_orderkey % 5 = 0 as anc from orders),
    k as (select *, row_number() over w as n, first_value(name) over w as keeper, date_diff('second', made,
        timestamp '1998-12-31') // 86400 < 200 as young from r window w as (partition by sha order by case when d then 0 when pr then 1 when pt then 2
        else 3 end, length(name), name)),
    x as (select *, case when pt then 'protected' when pr then 'open_pr' when n = 1 then case when anc and not d and not young then 'merged'
        else 'keeper' end when young then 'too_young' else 'duplicate_tip' end as reason from k)
    select name, sha, keeper, reason, case when reason in ('merged', 'duplicate_tip') then 'retire' else 'keep' end as action from x""")
def retirement_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as branches whose tips are customers."""
    k = F.col("o_orderkey")
    refs = load(spark, sf_dir, "orders").select(F.concat(F.lit("b"), k.cast("string")).alias("name"), F.col("o_custkey").alias("sha"),
        F.col("o_orderdate").alias("committed_at"), (k % 97 == 0).alias("is_default"), (k % 13 == 0).alias("has_open_pr"),
        (k % 17 == 0).alias("is_protected"), (k % 5 == 0).alias("is_ancestor"))
    return L.retirement_plan(refs, F.lit("1998-12-31").cast("timestamp"), 200)
