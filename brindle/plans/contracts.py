"""Queries on row contracts, run completeness, compatibility and product domains.

The tables hold no such records, so each query derives them from a given table
and spoils some by their ids; the SQL says which rules that breaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import domains as D
from brindle.operators import contracts as C
from brindle.operators.evaluation import row_errors
from brindle.operators.work import spread
from brindle.plans.registry import load, query


def errors_sql(broken: dict[str, str]) -> str:
    """SQL of the sorted names of broken rules, joined by commas."""
    cases = ", ".join(f"case when {c} then '{n}' end" for n, c in broken.items())
    return f"array_to_string(list_sort(list_filter([{cases}], lambda x: x is not null)), ',')"


def errors_of(rows: DataFrame, keys: list[str], rules: dict[str, F.Column]) -> DataFrame:
    return rows.select(*keys, F.array_join(row_errors(rules), ",").alias("errors"))


CASES = """doc_id as case_id, source as corpus_id, case when doc_id % 53 = 0 then 'v2' else 'v1' end as corpus_version,
    case doc_id % 6 when 0 then 'Leakage probe' when 1 then 'contaminated' when 2 then ' ' else lang end as category,
    case when doc_id % 4 = 0 then 'clean' else 'suspect' end as leakage_class,
    case doc_id % 3 when 0 then 'snapshot' when 1 then 'live_source' else 'fixture' end as replay_mode,
    case when doc_id % 5 = 0 then ' ' when doc_id % 5 = 1 then null else 'r' end as snapshot_ref,
    case when doc_id % 7 = 0 then null else 'o' end as oracle_ref, lang as population, source as source_family"""
CASE_TRUTH = errors_sql({
    "blank:category": "doc_id % 6 = 2",
    "bad_digest": "doc_id % 11 = 0",
    "bad_invariants": "doc_id % 13 = 0 or doc_id % 13 = 1",
    "missing_snapshot": "doc_id % 3 = 0 and doc_id % 5 < 2",
    "missing_oracle": "doc_id % 3 = 1 and doc_id % 7 = 0",
    "mislabelled_leakage": "doc_id % 4 = 0 and doc_id % 6 < 2",
})


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation cases made of documents."""
    digest = F.when(F.col("doc_id") % 11 == 0, F.md5("text")).otherwise(F.upper(F.sha2(F.coalesce("text", F.lit("")), 256)))
    held = F.when(F.col("doc_id") % 13 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 13 == 1, F.array(F.lit("a"), F.lit(" "))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return load(spark, sf_dir, "documents").selectExpr("doc_id", "text", *[c.strip() for c in split_columns(CASES)]).withColumns({"input_digest": digest, "expected_invariants": held})


def split_columns(text: str) -> list[str]:
    """The columns of a select list that has no commas inside."""
    return [c for c in text.replace("\n", " ").split(", ") if c.strip()]


@query(f"select doc_id, {CASE_TRUTH} as errors from documents")
def case_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that evaluation cases break."""
    return errors_of(cases(spark, sf_dir), ["doc_id"], C.case_rules())


@query(f"""with c as (select {CASES} from documents), i as (select corpus_id, case_id % 900 as k, count(*) as n, min(corpus_version) as v0, max(corpus_version) as v1 from c group by all),
    g as (select corpus_id, sum(n) as n, max(n) as most, min(v0) as v0, max(v1) as v1 from i group by 1),
    m as (select distinct source as corpus_id from documents union all select 'nowhere')
    select m.corpus_id,
        {errors_sql({"no_cases": "g.n is null", "too_many_cases": "g.n > 300", "repeated_ids": "g.most > 1", "other_version": "g.n is not null and not (g.v0 = 'v1' and g.v1 = 'v1')", "missing_approval": "length(m.corpus_id) % 2 = 0"})} as errors
    from m left join g using (corpus_id)""")
def corpus_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with corpora as wholes: a source is a corpus, ids repeat from 900 on."""
    rows = cases(spark, sf_dir).withColumn("case_id", F.col("case_id") % 900)
    names = rows.select("corpus_id").distinct().unionByName(spark.createDataFrame([("nowhere",)], "corpus_id string"))
    odd = F.length("corpus_id") % 2 == 1
    m = names.withColumns({"corpus_version": F.lit("v1"), "approval_status": F.lit("approved"), "approval_ref": F.when(odd, "r").otherwise(" ")})
    return C.manifest_errors(rows, m, 300).withColumn("errors", F.array_join("errors", ","))


DIMENSIONS = """o_orderkey, case o_orderkey % 3 when 0 then 'latency' when 1 then 'quality' else 'safety' end as dimension,
    case o_orderkey % 5 when 0 then null when 1 then -0.5 when 2 then 1.5 else 0.5 end as value,
    case when o_orderkey % 7 = 0 then -1.0 end as baseline, case o_orderkey % 11 when 0 then -0.1 when 1 then 0.1 end as max_regression,
    case when o_orderkey % 13 = 0 then '  ' else 's' end as source, o_custkey"""


@query(f"""with d as (select {DIMENSIONS} from orders), n as (select o_custkey, dimension, count(*) > 1 as repeated from d group by all)
    select o_orderkey,
        {errors_sql({"blank:source": "trim(source) = ''", "out_of_range": "dimension <> 'latency' and (value < 0 or value > 1)", "negative_latency": "dimension = 'latency' and value < 0", "negative_baseline": "baseline < 0", "negative_regression": "max_regression < 0", "repeated_dimension": "n.repeated"})} as errors
    from d join n using (o_custkey, dimension)""")
def dimension_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that scorecard dimensions break; a customer's orders are a scorecard."""
    rows = C.repeated(load(spark, sf_dir, "orders").selectExpr(*split_columns(DIMENSIONS)), ["o_custkey", "dimension"], "twice")
    return errors_of(rows, ["o_orderkey"], C.dimension_rules() | {"repeated_dimension": ~F.col("twice")})


@query("select event_id, " + errors_sql({
    "blank:stage": "event_id % 7 = 0", "too_long:provider": "event_id % 9 = 0", "blank:parent": "event_id % 5 = 0", "negative:resource_units": "event_id % 10 = 3", "bad_attempt": "event_id % 4 = 0",
    "bad_time:created_at": "event_id % 6 = 1", "no_zone": "event_id % 6 = 1 or event_id % 6 = 2", "expired_at_once": "event_id % 6 = 3",
}) + " as errors from events")
def stage_receipt_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that stage receipts made of events break."""
    i = F.col("event_id")
    zone = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    made, end = zone(F.col("ts")), zone(F.col("ts") + F.expr("interval 1 day"))
    rows = load(spark, sf_dir, "events").select(
        "event_id", *[F.lit("x").alias(n) for n in ("request_fingerprint", "input_fingerprint", "output_fingerprint", "method", "status")],
        F.when(i % 7 == 0, " ").otherwise("fetch").alias("stage"), F.when(i % 9 == 0, F.repeat(F.lit("p"), 65)).otherwise("p").alias("provider"),
        F.when(i % 5 == 0, "").when(i % 5 == 1, "parent").alias("parent_receipt_fingerprint"), F.when(i % 10 == 3, -1).otherwise(2).alias("resource_units"), (i % 4).alias("attempt"),
        F.when(i % 6 == 1, "yesterday").when(i % 6 == 2, F.regexp_replace(made, "Z$", "")).otherwise(made).alias("created_at"),
        F.when(i % 6 == 3, made).when(i % 6 == 4, F.lit(None)).otherwise(end).alias("expires_at"),
    )
    return errors_of(rows, ["event_id"], C.stage_rules())


RECEIPTS = """o_orderkey, o_custkey, case when o_orderkey % 17 = 0 then ' ' else 'repo' end as repository, 'r' as revision, 'a' as artifact_id, o_orderpriority as suite,
    case when o_orderkey % 8 = 0 then '2' else '1' end as suite_version, o_orderstatus as configuration_digest, 'live' as evidence_tier, 'c' as corpus_id, '1' as corpus_version, 't' as generated_at,
    case o_orderkey % 6 when 0 then 'failed' when 1 then 'running' when 2 then 'partial_or_failed' else 'completed' end as execution_state, case when o_orderkey % 5 = 0 then '' end as workflow_id, 'w' as workflow_run_id"""


@query("select o_orderkey, " + errors_sql({"blank:repository": "o_orderkey % 17 = 0", "unknown_state": "o_orderkey % 6 = 1",
    "blank:workflow_id": "o_orderkey % 5 = 0", "sensitive_key": "o_orderkey % 9 < 2"}) + " as errors from orders")
def receipt_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that reproducibility receipts break, sensitive keys anywhere in their configuration among them."""
    k = F.col("o_orderkey")
    config = F.when(k % 9 == 0, '{"a": {"b": [{"API-Key": "x"}]}}').when(k % 9 == 1, '{"User_Prompt" : 1}').otherwise('{"a": {"note": "the token: none"}, "b": [1, "secret"]}')
    rows = load(spark, sf_dir, "orders").selectExpr(*split_columns(RECEIPTS)).withColumn("configuration", config)
    return errors_of(rows, ["o_orderkey"], C.receipt_rules())


@query(f"""with r as (select {RECEIPTS} from orders), l as (select o_custkey, max(o_orderkey) as c, min(o_orderkey) as p from r group by 1),
    j as (select l.o_custkey, l.c = l.p as lone, a.repository <> b.repository as d1, a.suite <> b.suite as d2,
        a.suite_version <> b.suite_version as d3, a.configuration_digest <> b.configuration_digest as d4,
        a.execution_state = 'running' as s1, b.execution_state not in ('completed', 'partial_or_failed') as s2
        from l join r a on a.o_orderkey = l.c join r b on b.o_orderkey = l.p)
    select o_custkey, not (lone or d1 or d2 or d3 or d4 or s1 or s2) as compatible,
        case when lone then 'no_baseline' else {errors_sql({"repository": "d1", "suite": "d2", "suite_version": "d3", "configuration_digest": "d4", "current_state": "s1", "baseline_state": "s2"})} end as problems from j""")
def receipt_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's last receipt against their first."""
    rows = load(spark, sf_dir, "orders").selectExpr(*split_columns(RECEIPTS))
    ends = rows.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"), F.min("o_orderkey").alias("first"))
    pick = lambda which: rows.join(ends.select(F.col(which).alias("o_orderkey")), "o_orderkey", "left_semi")
    previous = pick("first").join(ends.where("first = last").select(F.col("first").alias("o_orderkey")), "o_orderkey", "left_anti")
    return C.compatibility(pick("last"), previous, "o_custkey").withColumn("problems", F.array_join(F.array_sort("problems"), ","))


def program_records(spark: SparkSession, sf_dir: str, program: F.Column | None = None) -> DataFrame:
    """Program records (conv_id, turn, record as JSON) made of chat turns, some of which give a password away."""
    k = F.col("k")
    said = F.when(F.col("turn") % 13 == 2, F.concat(F.lit(" Password : hunter"), F.col("conv_id").cast("string"))).otherwise("")
    rows = load(spark, sf_dir, "conversations").withColumns({"k": (F.col("conv_id") * 31 + F.col("turn")) % 17, "text": F.concat(F.coalesce("text", F.lit("")), said)})
    url = F.when(k == 11, "http://localhost:80/x").when(k == 12, "https://10.1.2.3/").when(k == 13, "ftp://example.com/").otherwise("https://example.com/a")
    claim = F.when(k == 9, " ").when(k == 10, "api_key: abc123").otherwise("c")
    finding = F.struct(claim.alias("claim"), url.alias("source_url"), F.when(k == 8, "x").alias("mail"), F.lit("web").alias("source_family"))
    measures = F.struct(F.lit(3).alias("allocated_agents"), F.when(k == 6, "3").alias("failed_agents"), F.lit(0.25).alias("duplicate_rate"), F.when(k == 5, 1).alias("cost"))
    record = F.struct(
        F.lit("v1").alias("schema"), F.when(k == 2, " ").otherwise(F.lit("p") if program is None else program).alias("program_id"), F.when(k == 3, 3).otherwise(1).alias("lane"), F.col("turn").alias("slot"),
        F.when(k == 4, "done").otherwise("completed").alias("status"), F.when(F.col("role") == "user",
            "search").otherwise("talk").alias("research_type"), F.col("text").alias("topic"),
        measures.alias("measurement"), F.when(k != 7, F.array(finding)).alias("findings"), F.when(k == 1, "x").alias("owner"),
    )
    text = F.when(k == 0, "[1]").when(k == 7, F.regexp_replace(F.to_json(record), r"\}$", ',"findings":7}')).otherwise(F.to_json(record))
    return rows.select("conv_id", "turn", text.alias("record"))


@query("select conv_id, turn, " + errors_sql({
    "not_an_object": "k = 0", "private_fields": "k = 0 or k = 1", "blank:program_id": "k = 0 or k = 2",
        "blank:topic": "k = 0 or trim(t) = ''", "bad_lane": "k = 0 or k = 3", "bad_slot": "k = 0 or turn > 7",
    "unknown:status": "k = 0 or k = 4", "unknown:research_type": "k = 0 or role <> 'user'", "private_measures": "k = 0 or k = 5",
        "measure_not_a_number": "k = 0 or k = 6", "findings_not_a_list": "k = 0 or k = 7",
    "private_finding_fields": "k = 0 or k = 7 or k = 8", "blank:claim": "k = 0 or k = 7 or k = 9", "credential": f"k = 0 or k = 7 or k = 10 or regexp_matches(t, '{C.CREDENTIAL}') or (contains(upper(t), '-----BEGIN ') and contains(upper(t), 'PRIVATE KEY-----')) or length(trim(t)) > 12000", "private_url": "k = 0 or k = 7 or k between 11 and 13",
}) + " as errors from (select *, (conv_id * 31 + turn) % 17 as k, coalesce(text, '') || case when turn % 13 = 2 then ' Password : hunter' || conv_id else '' end as t from conversations)")
def publishable_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Program records made of chat turns, some of which give a password away, and why they may not be published."""
    return errors_of(program_records(spark, sf_dir), ["conv_id", "turn"], C.record_rules())


@query("select page_id, " + errors_sql({"unknown:result": "page_id % 9 > 6", "missing:findings": "page_id % 5 = 0"}) + " as errors from pages")
def visit_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that visits of pages break."""
    i = F.col("page_id")
    results = F.array(*[F.lit(r) for r in (*C.VISIT_RESULTS, "nice", "")])
    one = F.array(F.lit("x"))
    rows = load(spark, sf_dir, "pages").select("page_id", F.get(results, (i % 9).cast("int")).alias("result"), one.alias("tasks"),
        one.alias("visits"), F.when(i % 5 > 0, one).alias("findings"), one.alias("next_tasks"))
    return errors_of(rows, ["page_id"], C.visit_rules())


@query("select event_id, " + errors_sql({"unknown:kind": "event_id % 10 = 9", "bad_rating": "event_id % 8 in (0, 6)", "too_many_receipts": "event_id % 70 > 64"}) + " as errors from events")
def feedback_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that feedback made of events breaks."""
    i = F.col("event_id")
    kinds = F.array(*[F.lit(k) for k in (*C.FEEDBACK_KINDS, "praise")])
    ids = F.when(i % 70 > 0, F.array_repeat(F.lit("r"), (i % 70).cast("int")))
    rows = load(spark, sf_dir, "events").select("event_id", F.get(kinds, (i % 10).cast("int")).alias("kind"), F.when(i % 8 != 7, i % 8).alias("rating"), ids.alias("receipt_ids"))
    return errors_of(rows, ["event_id"], C.feedback_rules())


OUTCOMES_SQL = "[" + ", ".join(f"'{o}'" for o in (*C.OUTCOMES, "odd")) + "]"


@query(f"""select user_id, o as outcome, coalesce(o = 'retryable_failure', false) as retryable, coalesce(o <> 'retryable_failure', false) as terminal, count(*) as n
    from (select user_id, nullif({OUTCOMES_SQL}[event_id % 10 + 1], 'odd') as o from events) group by all""")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage outcomes of each user's events, unknown ones as null."""
    raw = F.get(F.array(*[F.lit(o) for o in (*C.OUTCOMES, "odd")]), (F.col("event_id") % 10).cast("int"))
    known, retryable, terminal = C.outcome_flags(raw)
    rows = load(spark, sf_dir, "events").select("user_id", known.alias("outcome"), retryable.alias("retryable"), terminal.alias("terminal"))
    return rows.groupBy("user_id", "outcome", "retryable", "terminal").agg(F.count("*").alias("n"))


#: A release receipt's contract: column, kind of rule, value.
RELEASE = [
    ("schema_version", "required", None), ("schema_version", "const", "release/v1"), ("revision", "required", None), ("revision", "pattern", "^[0-9a-f]{40}$"),
    ("outcome", "required", None), ("outcome", "enum", ("success", "failure")), ("attempts", "min", 1), ("attempts", "max", 5), ("created_at", "min", "1993"),
]


@query("select o_orderkey, " + errors_sql({
    "const:schema_version": "o_orderkey % 7 = 1", "required:schema_version": "o_orderkey % 7 = 2", "pattern:revision": "o_orderkey % 5 = 0", "enum:outcome": "o_orderstatus = 'P'",
    "min:attempts": "o_orderkey % 9 = 0", "max:attempts": "o_orderkey % 9 > 5", "min:created_at": "year(o_orderdate) < 1993",
}) + " as errors from orders")
def contract_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release receipts made of orders against a contract table."""
    k = F.col("o_orderkey")
    version = F.when(k % 7 == 1, "release/v0").when(k % 7 != 2, "release/v1")
    revision = F.sha1(k.cast("string").cast("binary"))
    outcome = F.when(F.col("o_orderstatus") == "O", "success").when(F.col("o_orderstatus") == "F", "failure").otherwise("?")
    rows = load(spark, sf_dir, "orders").select("o_orderkey", version.alias("schema_version"), F.when(k % 5 == 0, F.upper(F.concat(revision,
        F.lit("g")))).otherwise(revision).alias("revision"), outcome.alias("outcome"), (k % 9).alias("attempts"),
        F.year("o_orderdate").cast("string").alias("created_at"))
    return errors_of(rows, ["o_orderkey"], C.contract_rules(RELEASE))


SHARDS = """o_custkey as run_id, o_orderkey % 3 as lane, case when o_custkey % 11 = 0 and o_orderkey % 2 = 0 then 'dry-run' when o_custkey % 13 = 0 then 'test' else 'live' end as mode,
    case when o_custkey % 17 = 0 then '' when o_custkey % 19 = 0 then o_orderstatus else 'r1' end as revision,
    case when o_custkey % 5 = 0 then 'dry_run' when o_custkey % 7 = 0 and o_orderkey % 3 = 0 then 'lane_failure' when o_custkey % 9 = 1 then 'blocked_before_execution'
      when o_custkey % 23 = 0 then 'odd' else 'live_research_executed' end as state, o_custkey % 4 = 3 and o_orderkey % 5 = 0 as short"""


@query(f"""with s as (select {SHARDS} from orders), g as (select run_id, count(distinct lane) < 3 as l, count(distinct mode) > 1 or bool_or(mode = 'test') as m, count(distinct revision) > 1 or bool_or(revision = '') as v,
      bool_or(state = 'odd') as u, bool_or(short and state in ('dry_run', 'live_research_executed')) as p, bool_or(mode = 'live' and state = 'dry_run') as d,
      bool_or(state = 'lane_failure') as f, bool_or(state = 'blocked_before_execution') as b, bool_and(state = 'dry_run') as dry, bool_and(state = 'live_research_executed') as live from s group by 1)
    select run_id, case when f then 'lane_specific_failure' when b then 'blocked_before_execution' when dry then 'dry_run'
        when live then 'live_research_executed' else 'partial_or_mixed' end as aggregate,
      {errors_sql({"missing_lane": "l", "mixed_mode": "m", "mixed_revision": "v", "unknown_state": "u", "wrong_programs": "p", "dry_run_in_live": "d"})} as errors from g""")
def run_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each run, a customer's orders as its shards, is whole."""
    names = F.transform(F.sequence(F.lit(0), F.when(F.col("short"), 6).otherwise(7)), lambda s: F.concat(F.lit("lane"), F.col("lane").cast("string"), F.lit("-slot"), s.cast("string")))
    rows = load(spark, sf_dir, "orders").selectExpr(*split_columns(SHARDS)).withColumn("program_ids", names)
    return C.run_completeness(rows).withColumn("errors", F.array_join("errors", ","))


@query("""with j as (select event_id, case event_type when 'click' then 200 when 'view' then 404 end as web, case when event_id % 3 = 0 then 200 else 500 end as forum, case when event_id % 7 > 0 then user_id end as g from events where event_id % 10 > 0)
    select count(*) filter (web = 200) as ok_web, count(*) filter (forum = 200) as ok_forum, count(*) filter (coalesce(web,
        0) <> 200 and forum <> 200) as jobs_without_source, count(distinct g) as lineage_digests, count(*) filter (g is null) as jobs_without_lineage,
      (select count(*) from events where event_id % 10 = 0) as missing_jobs from j""")
def job_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the expected jobs were run, and which sources answered."""
    i, e = F.col("event_id"), load(spark, sf_dir, "events")
    jobs = e.where(i % 10 > 0).select("event_id", F.when(F.col("event_type") == "click", 200).when(F.col("event_type") == "view", 404).alias("web"),
        F.when(i % 3 == 0, 200).otherwise(500).alias("forum"), F.when(i % 7 > 0, F.col("user_id")).alias("g"))
    return C.source_counts(jobs, ["web", "forum"], e.select("event_id"), "event_id", "g")


#: What a part is said to be, by its id: texts that every rule has something to find in.
PHRASES = [
    "TKL mechanical keyboard pbt hot-swap barebone 1.25 kg 3000 mAh 3-pin 5-pin knob gasket steel wood 1000 Hz bluetooth wired",
    "gaming keyboard 75% hall effect prebuilt 87 900.5 g rotary encoder tray sa aluminum 2.4 GHz",
    "wireless mouse bamf 3.0 68 g 500 mAh 26K DPI optical palm claw",
    "gaming mouse PAW3395  SE 16000 DPI 49g bt huano blue shell usb",
    "ipi haze 6369g haze x1 mouse fingertip", "ipi haze 6369 g mouse kailh ttc gold", "monitor 165 Hz display", "mouse pad very fast rough firm 4 mm desk mat", "laptop with ssd and tv",
    "mini pc desktop 144 hz", "router and access point", "webcam camera 60%", "in-ear headset speaker", "nothing of note",
]


def domain_sql() -> str:
    """SQL of ``domain_fields``: all rules as rows, the first of each field by the domains' order."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    here = lambda p: quoted(p.replace(r"(?<!\d)", r"(?:^|\D)"))
    points = " union all ".join(f"select id, '{d}' as domain, " + " + ".join(f"regexp_matches(t, {quoted(p)}, 'i')::int + 2 * regexp_matches(c, {quoted(p)}, 'i')::int" for p in ps) + " as score from x" for d, ps in D.DETECT.items())
    rules = []
    for domain, own in D.RULES.items():
        for i, (kind, field, what, more) in enumerate(own):
            group = lambda g: f"regexp_extract(x.t, {here(what)}, {g}, 'i')"  # noqa: E731, B023
            if kind == "first_of":
                value = "case " + " ".join(f"when contains(lower(x.t), {quoted(a)}) then {quoted(b)}" for a, b in what) + " end"
            elif kind == "all_of":
                value = "array_to_string(list_filter([" + ", ".join(f"case when regexp_matches(x.t, {quoted(a)}, 'i') then {quoted(b)} end" for a, b in what) + "], lambda v: v is not null), ', ')"
            elif kind == "haze_weight":
                value = "case when regexp_matches(lower(x.t), '6369 ?g') and contains(lower(x.t), 'ipi') and contains(lower(x.t), 'haze') then case when regexp_matches(lower(x.t), ' tmr|haze x1|haze x ii') then '69g' else '63g' end end"
            elif kind == "regex":
                value = f"regexp_replace(trim({group(0)}), '\\s+', ' ', 'g')"
                if more == "layout":
                    value = f"case when upper({value}) = 'TKL' then '75%' when regexp_matches({value}, '^\\d+$') then {value} || '%' else upper({value}) end"
            elif kind == "dpi":
                value = f"case when {group(1)} <> '' then (try_cast({group(1)} as bigint) * 1000)::varchar else {group(2)} end"
            elif more == "weight_g":
                value = f"case when {group(1)} <> '' then floor(try_cast({group(1)} as decimal(18,4)) * case when lower({group(2)}) = 'kg' then 1000 else 1 end)::bigint || 'g' end"
            else:
                value = f"case when {group(1)} <> '' then {group(1)} || '{' ' + more if more in ('Hz', 'mAh') else more}' end"
            rules.append(f"select x.id, d.rank, {i} as i, '{field}' as field, {value} as value from x join d on d.id = x.id and d.domain = '{domain}'")
    phrases = " ".join(f"when {i} then {quoted(p)}" for i, p in enumerate(PHRASES))
    return f"""with x as (select p_partkey as id, p_name || ' ' || case p_partkey % {len(PHRASES)} {phrases} end as t, case p_partkey % 3 when 0 then 'monitor' else lower(p_type) end as c from part), s as ({points}),
        d as (select id, domain, row_number() over (partition by id order by score desc, domain) as rank from s where score > 0), r as ({' union all '.join(rules)}),
        f as (select id, field, value, row_number() over (partition by id, field order by rank, i) as n from r where coalesce(value, '') <> '')
        select id as p_partkey, string_agg(domain, ',' order by rank) as domains,
          coalesce(max(case when domain = 'computer' then case when not exists (select 1 from d e where e.id = d.id and e.domain = 'display') then 'display' end end) || '', '') as related_first,
          coalesce((select string_agg(field || '=' || value, ';' order by field) from f where f.id = d.id and n = 1), '') as fields from d group by id"""


@query(domain_sql())
def domain_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of parts by their texts, the first related domain, and the fields that the domains' rules find."""
    n = (F.col("p_partkey") % len(PHRASES)).cast("int")
    rows = load(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.get(F.array(*[F.lit(p) for p in PHRASES]), n)).alias("t"),
        F.when(F.col("p_partkey") % 3 == 0, "monitor").otherwise(F.lower("p_type")).alias("c"))
    # exploded, so that domains are detected once and not again for each use of them
    found = spread(rows).select("p_partkey", "t", F.explode(F.array(D.detect_domains(F.col("t"), F.col("c")))).alias("d")).where(F.size("d") > 0)
    fields = F.transform(F.array_sort(F.map_entries(D.domain_fields(F.lower("t"), F.col("d"), F.col("t")))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    first = F.coalesce(F.get(D.related_domains(F.col("d")), F.lit(0)), F.lit(""))
    return found.select("p_partkey", F.array_join("d", ",").alias("domains"), F.when(first == "display", first).otherwise("").alias("related_first"), F.array_join(fields, ";").alias("fields"))
