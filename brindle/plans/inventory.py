"""Queries on file inventories, findings and signal candidates, made of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import inventory as I
from brindle.operators import minhash as M
from brindle.plans.registry import load, query

#: Endings of source files and a text of each, by document id.
SOURCES = [
    (".py", "import os\nfrom a.b import c\nasync def scheduled(x):\n  def inner(y):\nclass K\ndef main():\nif __name__ == '__main__':\n subprocess.run(['python3 -m x'])\nimport os"),
    (".rs", "pub async fn go<T>(x) {}\n  fn inner (y)\nlet fn_ = 1;"),
    (".GO", "func (s *S) Serve(w)\nfunc main()\nx := func() {}"),
    (".ts", "export async function run(a)\n export function main() {}\nexport default fetch(httpx)"),
    (".kt", "private suspend fun load(x)\nfun main()"),
    (".zig", "pub fn main() void\nfn hidden() void"),
    (".php", "public static function Get($x)\nfunction main($y)"),
    ("", "def nothing(x)\nredis and sqlite"),
]
FILES_SQL = "f as (select doc_id, source || '/' || lang || '/d' || doc_id || case doc_id % 8 " + " ".join(f"when {i} then '{e}'" for i, (e,
    _) in enumerate(SOURCES)) + " end as path, case doc_id % 8 " + " ".join("when {} then '{}'".format(i, t.replace("'", "''")) for i, (_,
    t) in enumerate(SOURCES)) + " end || coalesce(text, '') as text, lang, source, text as own from documents)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files: path, text."""
    n = (F.col("doc_id") % len(SOURCES)).cast("int")
    pick = lambda i: F.get(F.array(*[F.lit(s[i]) for s in SOURCES]), n)
    path = F.concat("source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), pick(0))
    return load(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.concat(pick(1), F.coalesce("text", F.lit(""))).alias("text"), "lang", "source", F.col("text").alias("own"))


@query(rf"""with {FILES_SQL} select path, array_to_string(list_distinct_in_order, ',') as imports, n_exported, has_subprocess, has_exec_python, has_network, has_state, worker_entrypoint, main_entrypoint from (
    select path, list_filter(i, lambda x, k: list_position(i, x) = k) as list_distinct_in_order, len(regexp_extract_all(text, '(?m)^(?:async\s+)?(?:def|class)\s+\w+'))::bigint as n_exported,
      regexp_matches(text, 'subprocess|os\.system|Popen') as has_subprocess, regexp_matches(text,
        'python(?:3)?\s+-m|sys\.executable') as has_exec_python, regexp_matches(text, 'requests|httpx|urllib|aiohttp') as has_network,
      regexp_matches(text, 'sqlite|d1|redis|kv|durable|ledger|persistence') as has_state, regexp_matches(text,
        'WorkerEntrypoint|export\s+default|async\s+def\s+scheduled\b|async\s+def\s+fetch\b') as worker_entrypoint,
      regexp_matches(text, 'if\s+__name__\s*==\s*["'']__main__["'']') as main_entrypoint
    from (select *, regexp_extract_all(text, '(?:^|\n)\s*(?:from|import)\s+([A-Za-z_][\w.]*)', 1) as i from f))""")
def code_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports and what else tells of a file's behaviour."""
    return I.code_signals(files(spark, sf_dir), "path", "text").withColumn("imports", F.array_join("imports", ","))


NAMES_SQL = "n as (" + " union all ".join(
    f"select distinct path, unnest(regexp_extract_all(text, '{p}', 1)) as name, '{e[1:].lower()}' as language, doc_id from f where doc_id % 8 = {i}"
    for i, (e, _) in enumerate(SOURCES) if e for p in [I.DECLARATIONS[e.lower()]]) + ")"


@query(f"with {FILES_SQL}, {NAMES_SQL} select distinct path, name, language from n")
def declared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that files declare, by the pattern of their language."""
    return I.declarations(files(spark, sf_dir), "path", "text")


@query(f"""with {FILES_SQL}, {NAMES_SQL}, s as (select distinct path, name, lower(name) as key, doc_id % 16 < 8 as l from n),
    l as (select key, count(*) as n_left, min(path) as left_path from s where l group by 1), r as (select key, count(*) as n_right, min(path) as right_path from s where not l group by 1)
    select key, n_left, n_right, left_path, right_path from l join r using (key)""")
def shared_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that two halves of the files both declare."""
    f = files(spark, sf_dir)
    half = lambda own: I.declarations(f.where((F.col("doc_id") % 16 < 8) == own), "path", "text")
    return I.shared_declarations(half(True), half(False))


@query(f"""with {FILES_SQL}, s as (select sha256(own) as digest, path, lang in ('en', 'de') as l from f where own is not null), l as (select digest, max(path) as left_path from s where l group by 1), r as (select digest, max(path) as right_path from s where not l group by 1)
    select digest, left_path, right_path from l join r using (digest)
    union all select digest, left_path, left_path from (select 'own' || sha256(own) as digest, max(path) as left_path from f where own is not null group by 1 having count(*) > 1)""")
def same_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content that files of two language pairs share, and that which several files have at all."""
    f = files(spark, sf_dir).select("path", "lang", F.sha2("own", 256).alias("digest"))
    left = F.col("lang").isin("en", "de")
    twice = f.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1 and digest is not null")
    own = f.join(twice, "digest", "left_semi").withColumn("digest", F.concat(F.lit("own"), "digest"))
    return I.same_content(f.where(left), f.where(~left), "digest", "path").unionByName(I.same_content(own, own, "digest", "path"))


@query(f"""with {FILES_SQL}, e as (select case doc_id % 8 {" ".join(f"when {i} then '{e[1:].lower() or '[none]'}'" for i, (e, _) in enumerate(SOURCES))} end as extension, lang, source, coalesce(length(own) > 2000, false) as c from f)
    select kind, value, count(*) as n, round(100 * avg(c::int), 2) as coverage from (select 'extension' as kind, extension as value, c from e union all select 'lang', lang, c from e union all select 'source', source, c from e) group by all""")
def inventory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by extension, language and source, and how many are long."""
    return I.inventory_counts(files(spark, sf_dir), "path", F.length("own") > 2000, "lang", "source")


CANDIDATES_SQL = "case " + " ".join("when " + " or ".join(f"contains(t, '{w}')" for w in words) + f" then '{kind}/{probe}'" for words, kind,
    probe in I.CANDIDATE_RULES) + f" else '{'/'.join(I.OTHER_CANDIDATE)}' end"


@query(f"""select k as candidate, count(*) as n from (select {CANDIDATES_SQL} as k from (select lower(p_name || ' ' || case p_partkey % 11 when 0 then 'Graph' when 1 then 'decision' when 2 then 'C++ parts' when 3 then 'Typed' when 4 then 'internet' when 5 then 'supply' when 6 then 'browser' when 7 then 'runtime' when 8 then 'research' when 9 then 'memory' else p_type end) as t from part)) group by 1""")
def candidate_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, read as topics, by the candidate type of their words."""
    words = ["Graph", "decision", "C++ parts", "Typed", "internet", "supply", "browser", "runtime", "research", "memory"]
    focus = F.coalesce(F.get(F.array(*[F.lit(w) for w in words]), (F.col("p_partkey") % 11).cast("int")), "p_type")
    kind = I.candidate_type(F.col("p_name"), focus)
    return load(spark, sf_dir, "part").groupBy(F.concat_ws("/", kind["type"], kind["probe"]).alias("candidate")).agg(F.count("*").alias("n"))


@query("""with l as (select l_orderkey as job_id, list(struct_pack(title := l_linestatus || l_linenumber, url := 'u' || l_partkey) order by l_linenumber, l_partkey, l_linestatus) as s from lineitem group by 1),
    j as (select job_id, o_orderstatus as st, o_orderpriority as pr, s, job_id % 2 = 0 as seed, job_id % 7 = 0 as reddit from l join orders on o_orderkey = job_id)
    select job_id || '-' || issue as candidate_id, issue, job_id, 'general_agent' as candidate_type, 'FI-11' as benchmark_probe, reddit as social_signal_present,
      array_to_string(list_transform(list_concat(case when seed then list_transform(s, lambda x: 'seed ' || x.title || ' ' || x.url) else [] end,
        list_transform(s, lambda x: 'issue ' || x.title || ' ' || x.url))[1:8], lambda x: x), ',') as supporting_sources
    from (select *, unnest(case st when 'F' then ['a', 'b'] when 'O' then ['a'] else [] end) as issue from j)""")
def signal_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as research jobs, each with its lines as sources, and the issues that they target."""
    line = F.struct("l_linenumber", "l_partkey", "l_linestatus")
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.array_sort(F.collect_list(line)).alias("s"))
    sources = F.transform("s", lambda x: F.struct(F.concat(x["l_linestatus"], x["l_linenumber"].cast("string")).alias("title"), F.concat(F.lit("u"), x["l_partkey"].cast("string")).alias("url")))
    targets = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("a"), F.lit("b"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    none = F.lit(None).cast("array<struct<title:string,url:string>>")
    jobs = lines.join(load(spark, sf_dir, "orders"), F.col("job_id") == F.col("o_orderkey")).select(
        "job_id", F.lit("vehicle").alias("topic"), F.lit("x").alias("focus"), targets.alias("target_issues"), F.when(F.col("job_id") % 2 == 0,
            sources).alias("seeds"), none.alias("repositories"), sources.alias("issues"),
        F.when(F.col("job_id") % 7 == 0, 200).alias("reddit_status"), F.lit(404).alias("x_status"),
    )
    return I.signal_candidates(jobs).withColumn("supporting_sources", F.array_join(F.transform("supporting_sources", lambda x: F.concat_ws(" ", x["source_type"], x["title"], x["url"])), ","))


@query(f"""with {FILES_SQL}, c as (select path as file from f where doc_id % 3 > 0),
    p as (select s_suppkey as id, unnest(case s_suppkey % 5 when 0 then ['src' || s_nationkey || '/', 'nothing']
        when 1 then ['src' || s_nationkey || '/en'] when 2 then ['s*x', 'zz*'] when 3 then [(select min(path) from f
        where doc_id % 7 = s_suppkey % 7)] else ['src' || s_nationkey, 'src1*'] end) as path from supplier
        where s_suppkey % 11 > 0 and s_suppkey % 13 > 0)
    select id as finding_id, count(distinct file) as n_files from p join c on c.file = p.path or starts_with(c.file, rtrim(p.path, '/') || '/') or (contains(p.path, '*') and starts_with(c.file, split_part(p.path, '*', 1))) group by 1""")
def path_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings made of suppliers that touch changed files, but those that are informational or reported."""
    f = files(spark, sf_dir)
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    firsts = f.where(F.col("path").isNotNull()).groupBy((F.col("doc_id") % 7).alias("m")).agg(F.min("path").alias("first"))
    s = load(spark, sf_dir, "supplier").join(F.broadcast(firsts), k % 7 == F.col("m"))
    one = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    paths = F.when(k % 5 == 0, F.array(one("src", n, "/"), F.lit("nothing"))).when(k % 5 == 1, F.array(one("src", n, "/en"))).when(k % 5 == 2,
        F.array(F.lit("s*x"), F.lit("zz*"))).when(k % 5 == 3, F.array("first")).otherwise(F.array(one("src", n), F.lit("src1*")))
    findings = s.select(k.alias("finding_id"), F.when(k % 11 == 0, "info").otherwise("high").alias("severity"), paths.alias("paths"))
    return I.path_overlaps(findings, f.where(F.col("doc_id") % 3 > 0).select(F.col("path").alias("file")), findings.where(F.col("finding_id") % 13 == 0))


@query(f"""with {FILES_SQL}, i as (select path from f where doc_id % 4 > 0), c as (select lang as source, path from f where doc_id % 2 = 0 union select lang, source || '/' || lang || '/' from f union select 'x', 'no/such/' union select 'y', source from f)
    select distinct source, path from c where not exists (select 1 from i where i.path = rtrim(c.path, '/') or starts_with(i.path, rtrim(c.path, '/') || '/'))
    union all select surface, 'anchor ' || a from (select distinct source as surface from f), (select unnest(['fr', 'xx']) as a) where not exists (select 1 from f where f.source = surface and f.lang = a)""")
def missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that a catalog names and no file has, and anchors that surfaces lack."""
    f = files(spark, sf_dir)
    folder = f.select(F.col("lang").alias("source"), F.concat("source", F.lit("/"), "lang", F.lit("/")).alias("path"))
    extra = spark.createDataFrame([("x", "no/such/"), ("x", None), ("x", " ")], "source string, path string")
    catalog = f.where(F.col("doc_id") % 2 == 0).select(F.col("lang").alias("source"),
        "path").unionByName(folder).unionByName(extra).unionByName(f.select(F.lit("y").alias("source"), F.col("source").alias("path")))
    lost = I.missing_paths(catalog, f.where(F.col("doc_id") % 4 > 0), "path")
    wanted = f.select(F.col("source").alias("surface")).distinct().withColumn("anchor", F.explode(F.array(F.lit("fr"), F.lit("xx"))))
    anchors = I.missing_anchors(f.select(F.col("source").alias("surface"), F.col("lang").alias("anchor")), wanted)
    return lost.unionByName(anchors.select(F.col("surface").alias("source"), F.concat(F.lit("anchor "), "anchor").alias("path")))


@query("""with f as (select 0 as o, 'instruction-audit' as source, coalesce(case when doc_id % 3 = 0 then null else lang end, 'finding') as kind, source as document, doc_id as l, doc_id::varchar as line, left(coalesce(text, ''), 600) as detail from documents),
    g as (select 1, 'aggregate-benchmark', 'hard-gate-failure', 'gates', null, '?', s_name || '=' || case s_nationkey % 3 when 0 then 'FAILED'
        else 'BLOCKED' end from supplier where s_nationkey % 3 < 2)
    select source, kind, document, line, detail from (select * from (from f union all from g) order by o, document, l, kind, detail limit 40)""")
def report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 findings of a report, failures of gates last."""
    i = F.col("doc_id")
    found = load(spark, sf_dir, "documents").select(F.when(i % 3 > 0, F.col("lang")).alias("kind"), F.col("source").alias("document"), i.alias("line"), F.col("text").alias("detail"))
    m = F.col("s_nationkey") % 3
    gates = load(spark, sf_dir, "supplier").select(F.col("s_name").alias("gate"), F.when(m == 0, "failed").when(m == 1, "Blocked").otherwise("ok").alias("status"))
    return I.report_findings(found, gates)


LITERALS_SQL = "['" + "', '".join(p.replace("'", "''") for p, _, _ in I.LITERALS) + "']"


@query(rf"""with l as (select doc_id, unnest(string_split(t, chr(10))) as raw, generate_subscripts(string_split(t, chr(10)), 1) as line from
      (select doc_id, coalesce(text, '') || case doc_id % 5 when 0 then chr(10) || 'Authorization: "Bearer ' || md5(doc_id::varchar) || '"'
        when 1 then ' api-key = ''' || md5(doc_id::varchar) || ''' NAME_X' when 2 then chr(10) || 'NAME.X' else '' end as t from documents))
    select 'd' || doc_id as path, line::integer as line, label from (select *, unnest(list_filter([case when regexp_matches(raw,
        {LITERALS_SQL}[1]) then 'bearer credential' end, case when regexp_matches(raw, {LITERALS_SQL}[2]) then 'credential-like literal' end, case
        when contains(raw, 'NAME_X') then 'protected marker' end], lambda x: x is not null)) as label from l)
    where not starts_with('d' || doc_id, 'd1')""")
def credential_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with credential-like literals or a protected marker, but in exempt paths."""
    i = F.col("doc_id")
    key = F.md5(i.cast("string").cast("binary"))
    tail = F.when(i % 5 == 0, F.concat(F.lit('\nAuthorization: "Bearer '), key, F.lit('"'))).when(i % 5 == 1, F.concat(F.lit(" api-key = '"), key,
        F.lit("' NAME_X"))).when(i % 5 == 2, "\nNAME.X").otherwise("")
    rows = load(spark, sf_dir, "documents").select(F.concat(F.lit("d"), i.cast("string")).alias("path"), F.concat(F.coalesce("text", F.lit("")), tail).alias("text"))
    return I.literal_findings(rows, "path", "text", ["NAME_X"], spark.createDataFrame([("d1",)], "prefix string"))


@query(r"""with w as (select item_id, string_split_regex(lower(trim(text)), '\s+') as w from benchmark), p as (select distinct item_id, array_to_string(w[i:i+4], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)),
    d as (select doc_id, string_split_regex(lower(trim(coalesce(text, ''))), '\s+') as w from documents), q as (select distinct doc_id,
        array_to_string(w[i:i+4], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
    s as (select item_id, count(*) as size from p group by 1) select doc_id, item_id, count(*) as n_shared from q join p using (g) join s using (item_id) group by doc_id, item_id, size having count(*) * 100 >= size * 80""")
def near_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths or more of an item's five-word shingles."""
    return I.near_passages(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark").select("item_id", "text"), "doc_id", "item_id")


@query(r"""with w as (select doc_id as id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') as w from documents),
    s as (select id, list_sort(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) else [array_to_string(w, ' ')] end)) as s from w where len(w) > 0),
    a as (select s, min(id) as left_rep, count(*) as n_left from s where id % 50 = 0 group by s), b as (select s, min(id) as right_rep, count(*) as n_right from s group by s),
    p as (select left_rep, right_rep, n_left, n_right, len(list_intersect(a.s, b.s)) as k, len(a.s) as x, len(b.s) as y from a join b on len(a.s) * 10 >= len(b.s) * 8 and len(b.s) * 10 >= len(a.s) * 8)
    select left_rep, right_rep, round(k / (x + y - k), 6) as similarity, n_left, n_right from p where k * 10 >= (x + y - k) * 8""")
def near_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an id divisible by 50 as evaluation cases: which documents are near copies of them."""
    docs = load(spark, sf_dir, "documents")
    return M.near_classes(docs.where("doc_id % 50 = 0"), docs, "doc_id", "text")[0]
