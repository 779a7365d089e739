"""Queries on documents, conversations, and tables to compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import audit as A
from brindle.operators import ledger as L
from brindle.operators import payload as P
from brindle.plans.registry import load, query

LINES_SQL = """raw as (select doc_id as doc, unnest(string_split(replace(coalesce(text, ''), chr(13), chr(10)), chr(10))) as raw, generate_subscripts(string_split(replace(coalesce(text, ''), chr(13), chr(10)), chr(10)), 1) as line from documents),
    lines as (select * from (select doc, line, trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(raw, '\\s+', ' ', 'g'))), '^([-*]\\s*)+', ''), '\\s+', ' ', 'g')) as key from raw) where key <> '' and key not like '```%')"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.lines_of(load(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""with {LINES_SQL}, l as (select key, doc, max(line) as owner_line from lines where length(key) >= 24 group by all), o as (select key, arg_min(owner_line, doc) as owner_line, min(doc) as owner_doc from l group by key having count(*) > 1)
    select doc, line::integer as line, owner_doc, owner_line::integer as owner_line from lines join o using (key) where doc <> owner_doc""")
def duplicate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has, with the line that owns them."""
    return A.duplicate_lines(lines(spark, sf_dir))


@query(f"""with {LINES_SQL}, t as (select doc, line, doc % 2 = 0 as positive, key as subject from lines),
    c as (select subject from t group by subject having count(distinct positive) = 2) select doc, line::integer as line, subject from t join c using (subject)""")
def conflicting_whole_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines as instructions: even documents demand what odd ones forbid."""
    made = lines(spark, sf_dir).withColumn("key", F.concat(F.when(F.col("doc") % 2 == 0, "must ").otherwise("must not "), "key"))
    return A.conflicting_lines(made)


RULES = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "high", "mail address"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "warn", "network address"),
    (r"(?i)\b(?:token|secret|password|api_key)\s*[:=]\s*\S+", "high", "credential assignment"),
    (r"(?i)BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY", "high", "private key material"),
    (r"(?i)licen[cs]e", "warn", "license line"),
]
RULES_SQL = "r as (" + " union all ".join(f"select '{p}' as p, '{s}' as severity, '{n}' as label" for p, s, n in RULES) + ")"


@query(f"with {RULES_SQL} select doc_id as doc, severity, label, substr(sha256(regexp_extract(text, p, 0)), 1, 16) as fingerprint from documents, r where regexp_matches(text, p)")
def disclosure_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by rule, with a fingerprint instead of the text found."""
    return A.scan_rules(load(spark, sf_dir, "documents"), "doc_id", "text", RULES)


@query(f"with {RULES_SQL}, f as (select doc_id, severity from documents, r where regexp_matches(text, p)), d as (select d.doc_id, count(*) filter (f.severity = 'high') as h, count(*) filter (f.severity = 'warn') as w from documents d left join f on f.doc_id = d.doc_id group by 1) select case when h > 0 then 'blocked' when w > 0 then 'review' else 'clean' end as verdict, count(*) as n_docs from d group by 1")
def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the worst of their findings."""
    return verdicts(load(spark, sf_dir, "documents"), RULES)


def verdicts(docs: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    worst = A.scan_rules(docs, "doc_id", "text", rules).groupBy(F.col("doc").alias("doc_id")).agg(F.bool_or(F.col("severity") == "high").alias("h"))
    verdict = F.when(F.col("h"), "blocked").when(F.col("h").isNotNull(), "review").otherwise("clean")
    return docs.select("doc_id").join(worst, "doc_id", "left").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n_docs"))


# High-risk and warning patterns of a public surface; names of one's own projects are left to the caller.
PUBLIC_RULES = [
    (r"https?://[A-Za-z0-9.-]+\.workers\.dev(?:[/A-Za-z0-9_.?=&%:-]*)?", "high", "live Workers.dev origin"),
    (r"\bSuper Administrator\s*-\s*All Privileges\b", "high", "privileged Cloudflare account role"),
    (r"\bCloudflare account(?: ID| identifier)?\s*[:=]?\s*[0-9a-f]{32}\b", "high", "Cloudflare account identifier"),
    (r"\bD1 (?:database )?(?:ID|identifier)\s*[:=]?\s*[0-9a-f-]{36}\b", "high", "D1 resource identifier"),
    (r"(?i)(?:version ID|deployment ID)\s*[:=]?\s*[0-9a-f]{8}-[0-9a-f-]{27,}\b", "high", "Cloudflare version/deployment identifier"),
    (r"(?i)github:[0-9a-f]{40}", "high", "private revision provenance literal"),
    (r'(?im)^\s*["\']?(?:live_d1_counts|d1_counts|live_d1_row_counts)["\']?\s*:\s*\{[^{}]*\b(?:count|total|rows|observations|reservations)\b\s*[:=]\s*[0-9]+', "high", "live D1 operational counts"),
    (r"(?i)cloudflare nameservers?\s*[:=]", "high", "Cloudflare nameserver disclosure"),
    (r"(?i)Worker-managed .*?(?:AAAA|edge address)\s*[:=]", "high", "Worker edge-address disclosure"),
    (r"(?i)BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY", "high", "private key material"),
    (r"(?i)\b(?:github_pat_|ghp_|gho_|ghu_|ghs_|ghr_)[A-Za-z0-9_]{20,}\b", "high", "GitHub credential material"),
]
# Literals that couple a text to a provider.
MARKERS = ["api.groq.com", "generativelanguage.googleapis.com", "integrate.api.nvidia.com", "api.cohere.ai", "router.huggingface.co", "openrouter.ai/api/v1", "GROQ_API_KEY", "GEMINI_API_KEY", "NVIDIA_NIM_API_KEY", "COHERE_API_KEY", "HF_TOKEN", "OPENROUTER_API_KEY"]
WHOLE_RULES = PUBLIC_RULES + [(m.replace(".", r"\."), "high", f"provider marker {m}") for m in MARKERS]
WHOLE_RULES_SQL = "r as (" + " union all ".join("select '{}' as p, '{}' as severity, '{}' as label".format(*(x.replace("'", "''") for x in rule)) for rule in WHOLE_RULES) + ")"


@query(f"with {WHOLE_RULES_SQL} select doc_id as doc, severity, label, substr(sha256(regexp_extract(text, p, 0)), 1, 16) as fingerprint from documents, r where regexp_matches(text, p)")
def public_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by the patterns of a public surface and the provider markers."""
    return A.scan_rules(load(spark, sf_dir, "documents"), "doc_id", "text", WHOLE_RULES)


@query(f"with {RULES_SQL}, {WHOLE_RULES_SQL.replace('r as', 'q as', 1)}, f as (select doc_id, severity from documents, (from r union all from q) where regexp_matches(text, p)), d as (select d.doc_id, count(*) filter (f.severity = 'high') as h, count(*) filter (f.severity = 'warn') as w from documents d left join f on f.doc_id = d.doc_id group by 1) select case when h > 0 then 'blocked' when w > 0 then 'review' else 'clean' end as verdict, count(*) as n_docs from d group by 1")
def public_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the worst of their findings by all rules."""
    return verdicts(load(spark, sf_dir, "documents"), RULES + WHOLE_RULES)


@query("""select doc_id as doc, contains(text, chr(0)) as has_nul, contains(text, chr(13)) as has_cr, not ends_with(text, chr(10)) as no_final_newline, regexp_matches(text, '[ \\t](\\n|$)') as trailing_space, regexp_matches(text, '(^|\\n)\\t') as tab_indent,
    strlen(text) > 1048576 as oversize, strlen(text) as n_bytes from (select doc_id, coalesce(text, '') as text from documents)""")
def text_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.text_hygiene(load(spark, sf_dir, "documents"), "doc_id", "text")


@query("select d.doc_id as id, sha256(d.text) as digest, f.first_id from documents d join (select text, min(doc_id) as first_id from documents group by text) f on f.text = d.text where d.doc_id > f.first_id")
def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose content an earlier one has."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return A.collisions(d, "digest", "doc_id")


@query("""with w as (select item_id, string_split(text, ' ') as w from benchmark), g as (select item_id, unnest(range(1, greatest(len(w) - 6, 2))) as i, w from w), p as (select distinct item_id, array_to_string(w[i:i+7], ' ') as g from g where len(w) >= 8),
    d as (select doc_id, string_split(text, ' ') as w from documents), e as (select doc_id, unnest(range(1, len(w) - 6)) as i, w from d where len(w) >= 8), q as (select distinct doc_id, array_to_string(w[i:i+7], ' ') as g from e)
    select doc_id, item_id, count(*) as n_shared from q join p using (g) group by all""")
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share eight-word passages with benchmark items."""
    docs, items = load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")
    return P.shared_passages(docs.select("doc_id", "text"), items.select("item_id", "text"), "doc_id", "item_id", 8)


@query("""with t as (select conv_id, turn, case when role = 'system' then 0 else 1 end as k, case when role = 'system' then trim(text) else role || ': ' || trim(text) end as line from conversations where trim(coalesce(text, '')) <> ''),
    g as (select conv_id, coalesce(string_agg(line, chr(10) || chr(10) order by turn) filter (k = 0), '') as s, coalesce(string_agg(line, chr(10) || chr(10) order by turn) filter (k = 1), '') as c from t group by 1)
    select conv_id, left(trim(case when s <> '' then 'Research execution instructions:' || chr(10) || s || chr(10) || chr(10) else '' end || 'Research request:' || chr(10) || c), 11800) as prompt from g""")
def conversation_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.compact_messages(load(spark, sf_dir, "conversations"))


RESULTS_SQL = """res as (select conv_id || '-' || turn as response_id, case turn % 4 when 0 then 'COMPLETE' when 1 then 'PARTIAL' when 2 then 'BLOCKED' else 'error' end as result_state, text from conversations where role <> 'system')"""


def chat_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn") % 4
    return load(spark, sf_dir, "conversations").where("role <> 'system'").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("response_id"), F.when(t == 0, "COMPLETE").when(t == 1, "PARTIAL").when(t == 2, "BLOCKED").otherwise("error").alias("result_state"), "text")


@query(f"""with {RESULTS_SQL}, r as (select *, case upper(result_state) when 'COMPLETE' then 'completed' when 'PARTIAL' then 'partial' when 'ERROR' then 'failed' end as st, ceil(length(text) / 256)::integer as n from res where upper(result_state) <> 'BLOCKED'),
    e as (select response_id, 0 as seq, 'start' as event, null as text, 'streaming' as status, null as digest from r union all select response_id, i + 1, 'delta', substr(text, i * 256 + 1, 256), null, null from (select *, unnest(range(0, n)) as i from r) union all select response_id, n + 1, 'done', null, st, sha256(text) from r)
    select response_id, seq::integer as seq, event, text, status, digest from e""")
def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies framed as start, deltas and done."""
    return L.frame_events(chat_results(spark, sf_dir))


FRAMES_SQL = f"""with {RESULTS_SQL}, t as (select *, coalesce(text, '') as body, ends_with(response_id, '1') and length(coalesce(text, '')) > 0 as spoilt from res where upper(result_state) <> 'BLOCKED')
    select response_id, case when spoilt then substr(body, 1, 256) || '!' || substr(body, 257) else body end as text,
      case upper(result_state) when 'COMPLETE' then 'completed' when 'PARTIAL' then 'partial' else 'failed' end as status, not spoilt as intact from t"""


def spoilt_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of replies, with a character added to the first delta of some."""
    hit = (F.col("seq") == 1) & (F.col("event") == "delta") & F.col("response_id").endswith("1")
    return L.frame_events(chat_results(spark, sf_dir)).withColumn("text", F.when(hit, F.concat("text", F.lit("!"))).otherwise(F.col("text")))


@query(FRAMES_SQL)
def frame_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames put together again; the digests of spoilt ones disagree."""
    return L.reassemble(spoilt_frames(spark, sf_dir))


@query("""select event_id, case when event_id % 23 = 0 then 'unsupported media type' else case event_id % 9 when 1 then 'root is not an object' when 2 then 'invalid json' when 3 then 'too deep' when 4 then 'too many items' when 5 then case when event_id % 50 = 0 then 'string too long' else '' end when 6 then 'missing'
      when 8 then case when user_id % 2 = 0 and event_id % 50 = 0 then 'too large' else '' end else '' end end as problem from events""")
def payload_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All event payloads, broken in different ways, against each bound of a payload; every fiftieth gets a variant of a megabyte, if any."""
    i, rare = F.col("event_id") % 9, F.col("event_id") % 50 == 0
    wrap = lambda before, middle, after: F.concat(F.lit(before), middle, F.lit(after))
    deep = F.concat(F.repeat(F.lit('{"a":'), 40), "props", F.repeat(F.lit("}"), 40))
    many = wrap('{"a":[0', F.repeat(F.lit(",1"), 1024), "]}")
    long = wrap('{"a":"', F.repeat(F.lit("x"), 131073), '"}')
    large = F.concat(F.lit('{"a":1}'), F.expr(f"repeat(' ', if(user_id % 2 = 0, {(1 << 20) - 6}, {(1 << 20) - 7}))"))
    made = F.when(i == 1, wrap("[", F.col("props"), "]")).when(i == 2, wrap("{", F.col("props"), "")).when(i == 3, deep).when(i == 4, many).when((i == 5) & rare, long).when(i == 6, F.lit(None)).when((i == 8) & rare, large).otherwise(F.col("props"))
    media = F.when(F.col("event_id") % 23 == 0, "text/plain").when(F.col("event_id") % 2 == 0, "application/json").otherwise(" Application/JSON ; charset=utf-8")
    return P.check_payloads(load(spark, sf_dir, "events").select("event_id", made.alias("payload"), media.alias("media")), "event_id", "payload", "media")


@query("""with l as (select o_custkey as k, max(o_totalprice) as v from orders where o_orderkey % 2 = 0 group by 1), r as (select o_custkey as k, max(o_totalprice) as v from orders group by 1 having count(*) > 8)
    select coalesce(l.k, r.k) as k, case when r.k is null then 'left_only' when l.k is null then 'right_only' when l.v = r.v then 'exact' else 'divergent' end as relation from l full join r on l.k = r.k""")
def policy_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    v = F.max("o_totalprice").alias("v")
    right = o.groupBy("k").agg(v, F.count("*").alias("n")).where("n > 8").drop("n")
    return A.policy_diff(o.where("o_orderkey % 2 = 0").groupBy("k").agg(v), right, "k", "v")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("names"), F.split("p_type", " ").alias("types"))


@query("""with p as (select p_partkey as id, list_sort(list_distinct(string_split(p_name, ' '))) as names, list_sort(list_distinct(string_split(p_type, ' '))) as types from part), c as (select names, types, min(p.id) as id, count(*) as n from p group by all),
    x as (select l.id as left_id, r.id as right_id, l.n as n_left, r.n as n_right, len(list_intersect(l.names, r.names)) as n, len(list_intersect(l.types, r.types)) as t, len(l.names) + len(r.names) as ns, len(l.types) + len(r.types) as ts from c l join c r on l.id < r.id or (l.id = r.id and l.n > 1)),
    s as (select *, round((0.0::double + n / (ns - n) + t / (ts - t)) / 2, 6) as score from x) select left_id, right_id, score, n_left, n_right from s where score >= 0.2 and n + t > 0""")
def feature_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All similar parts by mean Jaccard of name and type words, as pairs of the smallest ids of equal parts, with their numbers."""
    return A.similar_classes(features(spark, sf_dir), ["names", "types"], 0.2)


@query()
def feature_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part with the smallest id of its equals and the number of parts it resembles; 0 for the unpaired."""
    return A.similar_links(features(spark, sf_dir), ["names", "types"], 0.2)


@query("select p_brand as brand, p_type as type, count(*) as n from part group by all having count(*) >= 3")
def name_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of three or more parts with one brand and type."""
    return load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("type")).agg(F.count("*").alias("n")).where("n >= 3")


PREFIXES = [("http://", "plain"), ("https://", "secure"), ("https://m.", "mobile"), ("https://th", "th"), ("https://the", "the"), ("https://the", "them")]


@query("with p as (select * from (values " + ", ".join(f"('{a}', '{b}')" for a, b in PREFIXES) + ") as t(prefix, surface)) select url, max(prefix) as prefix, min(surface) as surface, count(distinct surface) > 1 as ambiguous from (select url, prefix, surface, length(prefix) = max(length(prefix)) over (partition by url) as longest from (select distinct url from pages) join p on starts_with(url, prefix)) where longest group by url")
def prefix_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs by the longest prefix of a fixed table."""
    table = spark.createDataFrame(PREFIXES, "prefix string, surface string")
    return A.longest_prefix(load(spark, sf_dir, "pages"), "url", table)


@query("with l as (select distinct l_suppkey as k from lineitem where l_quantity > 49), r as (select distinct l_suppkey as k from lineitem where l_discount > 0.09) select coalesce(l.k, r.k) as k, case when r.k is null then 'left_only' when l.k is null then 'right_only' else 'shared' end as side from l full join r on l.k = r.k")
def set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "k")
    return A.set_difference(li.where("l_quantity > 49"), li.where("l_discount > 0.09"), "k")


@query("""with e as (select c_custkey as source, o_orderkey as target, case when o_orderkey % 9 = 0 then ' ' else o_orderpriority end as contract from customer join orders on c_custkey = o_custkey), n as (select c_custkey as id from customer where c_custkey % 10 <> 0 union select o_orderkey from orders where o_orderkey % 8 <> 0)
    select source, target, 'unknown_source' as problem from e where source not in (select id from n) union all select source, target, 'unknown_target' from e where target not in (select id from n) union all select source, target, 'blank_contract' from e where trim(contract) = ''""")
def graph_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and orders as a graph with some nodes and contracts missing."""
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    e = c.join(o, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_custkey").alias("source"), F.col("o_orderkey").alias("target"), F.when(F.col("o_orderkey") % 9 == 0, " ").otherwise(F.col("o_orderpriority")).alias("contract"))
    n = c.where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("id")).union(o.where("o_orderkey % 8 <> 0").select("o_orderkey")).distinct()
    return A.graph_findings(e, n)


@query("""with o as (select l_orderkey as k, l_partkey % 50 as claim, l_linenumber as source_rank, l_extendedprice as relevance, l_orderkey * 10 + l_linenumber as id, l_quantity::bigint as tokens from lineitem),
    u as (select * from o qualify row_number() over (partition by k, claim order by source_rank, relevance desc, id) = 1),
    r as (select *, row_number() over w as place, sum(tokens) over (w rows unbounded preceding) as used from u window w as (partition by k order by source_rank, relevance desc, id)) select k, id, place, used::bigint as used from r where place <= 3 and used <= 100""")
def evidence_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as evidence within three items and a hundred tokens."""
    li = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 50).alias("claim"), F.col("l_linenumber").alias("source_rank"), F.col("l_extendedprice").alias("relevance"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").cast("long").alias("tokens"))
    return A.select_evidence(li, ["k"], 3, 100).select("k", "id", F.col("place").cast("long").alias("place"), "used")


@query("""with c as (select event_id as id, user_id as entity, event_type as predicate, date_trunc('month', ts) as span, case when event_id % 10 > 0 then value end as value from events),
    g as (select entity, predicate, span, count(*) as n_claims, min(value) as low, max(value) as high, arg_min(id, (value, id)) as low_id, arg_max(id, (value, -id)) as high_id from c where value is not null group by all)
    select entity, predicate, span, n_claims, low, high, low_id, high_id from g where high - low > 0.5 * greatest(abs(high), abs(low))""")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of claims whose values differ by more than half."""
    c = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("entity"), F.col("event_type").alias("predicate"), F.date_trunc("month", "ts").cast("timestamp_ntz").alias("span"), F.when(F.col("event_id") % 10 > 0, F.col("value")).alias("value"))
    return A.contradictions(c, ["entity", "predicate", "span"], 0.5)


@query("""with r as (select user_id as claim, props, event_type as family, case when event_id % 3 > 0 then ts end as t from events), o as (select claim, props, min(family) as f, count(*) as n, max(t) as t from r group by all)
    select claim, sum(n)::bigint as n_rows, count(distinct f) as n_families, case when max(t) is null then 'unknown' when date_diff('second', max(t), timestamp '2024-02-01') // 86400 <= 10 then 'fresh' else 'stale' end as freshness from o group by claim""")
def freshness_independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as evidence: copies of a payload are one family."""
    r = load(spark, sf_dir, "events").withColumn("t", F.when(F.col("event_id") % 3 > 0, F.col("ts")))
    out = A.independence(r, "user_id", F.col("props"), "event_type", "t", F.lit("2024-02-01").cast("timestamp"), 10)
    return out.withColumnRenamed("user_id", "claim")


@query("""with d as (select doc_id as id, case when doc_id % 10 <> 6 then doc_id - 1 else -doc_id end as parent_id, sha256(coalesce(text, '')) as digest from documents), a as (select c.id, c.parent_id, case when c.id % 4 = 0 then 'x' else p.digest end as pd, p.digest as real, case when c.id % 8 = 0 then 'MAPPING_LOST' else 'map' end as m from d c left join d p on p.id = c.parent_id)
    select id, case when real is null then 'missing_parent' when m = 'MAPPING_LOST' then 'mapping_lost' else 'digest_mismatch' end as problem from a where real is null or pd <> real""")
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document derived from the one before; some parents and digests are wrong."""
    i = F.col("doc_id")
    d = load(spark, sf_dir, "documents").select(i.alias("id"), F.when(i % 10 != 6, i - 1).otherwise(-i).alias("parent_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    p = d.select(F.col("id").alias("parent_id"), F.col("digest").alias("pd"))
    a = d.join(p, "parent_id", "left").withColumn("parent_digest", F.when(F.col("id") % 4 == 0, "x").otherwise(F.col("pd"))).withColumn("span_map", F.when(F.col("id") % 8 == 0, "MAPPING_LOST").otherwise("map"))
    return A.lineage_findings(a)
