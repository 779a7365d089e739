"""Queries on what may become public: scans of documents as files, artifacts written and read back, documents that list targets and questions, probes of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import audit as A
from brindle.operators import public_scan as P
from brindle.operators.inventory import LITERALS
from brindle.operators.work import work_folder
from brindle.plans.catalog import CANONICAL_SQL
from brindle.plans.contracts import program_records
from brindle.plans.registry import load, query
from brindle.sources import artifacts as R

#: Where the files made of documents stand; s, l and d are source, language and id.
PLACES = [
    "src/{s}/d{d}.py", "docs/d{d}.md", "tests/d{d}.py", ".github/workflows/{s}_{l}-v{d}.yml", "pkg/tests/d{d}.py", "benchmark/d{d}.py", "lib/d{d}_test.py",
    "app/{s}/{d}/Main{l}.ts", ".github/workflows/approved.yml", "scripts/release.sh", "services/provider_runtime/d{d}.py", "conf/d{d}.toml",
]
#: What a file has beside its document's text; h is the SHA-1 of the id.
TAILS = [
    "", "\nimport inner.core.x", "\nsee vault/inner/run.py", "\npin acme/vault@{h}", "\n  run: python3 ./x/vault/inner/job.py", "\nreimport inner.core",
    "\n      - uses: actions/checkout@v4\r\n      - uses: a/b@{h} # pinned", "\nconst u = 'https://openrouter.ai/api';\nsk-{h}", "\ngit acme/vault@short MARK_X", "\ntoken = \"{h}\"",
]
PACKAGE, FOLDER, REPOSITORY = "inner", "vault/inner", "acme/vault"
APPROVED, MARKS, REQUIRED = [".github/workflows/approved.yml", "scripts/release.sh"], ["MARK_X"], ["docs/d1.md", "README.md", "scripts/release.sh"]


def _made_sql(template: str) -> str:
    text = template.replace("'", "''").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '")
    for name, value in {"s": "coalesce(source, '')", "l": "coalesce(lang, '')", "d": "doc_id", "h": "sha1(doc_id::varchar)"}.items():
        text = text.replace(f"{{{name}}}", f"' || {value} || '")
    return f"'{text}'"


PLACED_SQL = f"""f as (select case doc_id % {len(PLACES)} {' '.join(f'when {i} then {_made_sql(p)}' for i, p in enumerate(PLACES))} end as path,
    coalesce(text, '') || case doc_id // {len(PLACES)} % {len(TAILS)} {' '.join(f'when {i} then {_made_sql(t)}' for i, t in enumerate(TAILS))} end as text from documents)"""


def _made(templates: list[str], which: F.Column) -> F.Column:
    parts = {"s": F.coalesce("source", F.lit("")), "l": F.coalesce("lang", F.lit("")), "d": F.col("doc_id").cast("string"), "h": F.sha1(F.col("doc_id").cast("string").cast("binary"))}
    made = F.get(F.array(*[F.lit(t) for t in templates]), which.cast("int"))
    for name, value in parts.items():
        made = F.replace(made, F.lit(f"{{{name}}}"), value)
    return made


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a repository: path, text."""
    i = F.col("doc_id")
    tail = _made(TAILS, F.floor(i / len(PLACES)) % len(TAILS))
    return load(spark, sf_dir, "documents").select(_made(PLACES, i % len(PLACES)).alias("path"), F.concat(F.coalesce("text", F.lit("")), tail).alias("text"))


ALONE = "(^|[^A-Za-z0-9_.-])"
HARMLESS_SQL = "(starts_with(path, 'docs/') or starts_with(path, 'tests/') or starts_with(path, 'benchmark/') or contains(path, '/tests/') or ends_with(path, '_test.py') or starts_with(path, '.github/workflows/') or path = 'scripts/release.sh')"
CREDENTIAL_SQL = " or ".join("regexp_matches(text, '{}')".format(p.replace("'", "''")) for p, _, _ in LITERALS)
RULES_SQL = {
    "private-marker": "contains(text, 'MARK_X')",
    "credential-literal": CREDENTIAL_SQL,
    "private-reference": rf"not {HARMLESS_SQL} and (regexp_matches(text, '{ALONE}(from|import)\s+inner\.[A-Za-z0-9_.]+') or regexp_matches(text, '{ALONE}vault/inner/[A-Za-z0-9_./-]+'))",
    "private-revision": f"not {HARMLESS_SQL} and regexp_matches(text, 'acme/vault@[0-9a-f]{{40}}')",
    "workflow-private-execution": r"starts_with(path, '.github/workflows/') and path <> '.github/workflows/approved.yml' and regexp_matches(text, '(python|python3|node|deno|go|cargo\s+run)[ \t]+(vault/inner|[^\n]*/vault/inner)')",
}


@query(f"with {PLACED_SQL} " + " union all ".join(f"select distinct path, '{r}' as rule, '{P.SAID[r]}' as message from f where {c}" for r, c in RULES_SQL.items()))
def private_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What files made of documents give away of a private repository."""
    return P.private_findings(placed(spark, sf_dir), "path", "text", P.private_rules(PACKAGE, FOLDER, REPOSITORY), MARKS, APPROVED)


HOSTS_SQL = "['" + "', '".join(P.PROVIDER_HOSTS) + "']"


@query(rf"""with {PLACED_SQL}, p as (select distinct path, regexp_extract(path, '([^/]*)$', 1) as base from f),
    l as (select path, unnest(x) as line, generate_subscripts(x, 1) as i from (select path, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) as x from f where starts_with(path, '.github/workflows/') and ends_with(path, '.yml'))),
    u as (select path, i, regexp_extract(line, 'uses:\s*([^\s#]+)@([^\s#]+)', 2) as ref from l), h as (select f.path, t.host from f, (select unnest({HOSTS_SQL}) as host) t where contains(text, host) and regexp_matches(path, '{P.CALLERS}') and not regexp_matches(path, '{P.PROVIDER_MODULES}')),
    w as (select path, regexp_replace(regexp_replace(regexp_replace(regexp_replace(base, '\.yml$', ''), '-v\d+(-v\d+)*$', ''), '\d+$', ''), '[-_]+', ' ', 'g') as name from p where starts_with(path, '.github/workflows/') and ends_with(path, '.yml')),
    e as (select 'warning' as severity, 'unpinned_action' as kind, path, '{P.UNPINNED}' || ref as message, path || ':' || i as evidence from u where ref <> '' and not regexp_full_match(ref, '[0-9a-f]{{40}}')
      union select 'warning', 'direct_provider_endpoint', path, '{P.ENDPOINT}' || host, host from h
      union select 'warning', 'secret_like_literal', path, '{P.SECRET}', path from f where regexp_matches(path, '{P.CONFIGURED}') and regexp_matches(text, '{P.SECRET_LIKE}')
      union select 'info', 'duplicate_filename_cluster', min(path), '{P.SAME_NAME[0]}' || lower(base) || '{P.SAME_NAME[1]}', array_to_string(list_sort(list(path))[1:8], ',') from p where regexp_matches(lower(base), '{P.IMPLEMENTED}') group by lower(base) having count(*) >= 3
      union select 'info', 'workflow_overlap_cluster', min(path), '{P.OVERLAP[0]}' || name || '{P.OVERLAP[1]}', array_to_string(list_sort(list(path))[1:10], ',') from w group by name having count(*) > 1
      union select 'critical', 'missing_required_file', r, '{P.MISSING}' || r, '' from (select unnest({REQUIRED}) as r) where r not in (select path from p))
    select *, substr(sha256('{{"severity":"' || severity || '","kind":"' || kind || '","path":"' || path || '","message":"' || replace(message, '"', '\"') || '"}}'), 1, 16) as fingerprint from e""")
def surface_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a scan of files made of documents, with their fingerprints."""
    return P.surface_findings(placed(spark, sf_dir), "path", "text", REQUIRED).withColumn("evidence", F.array_join("evidence", ","))


@query(r"""with c as (select conv_id, turn, (conv_id * 31 + turn) % 17 as k, role, coalesce(text, '') || case when turn % 13 = 2 then ' Password : hunter' || conv_id else '' end as t from conversations),
    b as (select 'lane-' || conv_id % 5 as artifact, 'c' || conv_id || '-' || turn // 3 as program_id, k, k in (0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 1) or turn > 7 or role <> 'user' or trim(t) = '' or length(trim(t)) > 12000
      or regexp_matches(t, '(?i)(api[_-]?key|access[_-]?token|private[_-]?key|password|authorization)\s*[:=]\s*\S+') or (contains(upper(t), '-----BEGIN ') and contains(upper(t), 'PRIVATE KEY-----')) as bad from c),
    g as (select artifact, program_id, count(*) as n from b where not bad group by 1, 2)
    select artifact, 'records' as kind, count(*) as n, count(distinct program_id) as n_programs from g group by 1
    union all select artifact, 'repeated_program', sum(n - 1)::bigint, null from g group by 1 having sum(n - 1) > 0
    union all select artifact, 'broken_lines', count(*), null from b where bad group by 1
    union all select artifact, 'not_an_object', count(*), null from b where k = 0 group by 1""")
def artifact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Program records made of chat turns, written as artifacts of JSON lines with blank lines between, and read back through the record gate."""
    program = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.floor(F.col("turn") / 3).cast("string"))
    rows = program_records(spark, sf_dir, program).select(F.concat(F.lit("lane-"), (F.col("conv_id") % 5).cast("string")).alias("artifact"), F.concat("record", F.when(F.col("turn") % 2 == 0, "\n").otherwise("")).alias("value"))
    folder = work_folder(spark, "artifacts")
    rows.write.partitionBy("artifact").text(folder)
    good, bad = R.artifact_records(spark, folder, "v1", whole=True)
    name = F.regexp_extract("artifact", "artifact=([^/]*)$", 1).alias("artifact")
    ours = good.groupBy("artifact").agg(F.lit("records").alias("kind"), F.count("*").alias("n"), F.count_distinct("program_id").alias("n_programs"))
    none = F.lit(None).cast("long").alias("n_programs")
    by_line = bad.groupBy("artifact", "file", "line").agg(F.bool_or(F.col("error") == "repeated_program").alias("again"), F.bool_or(F.col("error") == "not_an_object").alias("none"))
    kinds = F.explode(F.array_compact(F.array(F.when(F.col("again"), "repeated_program").otherwise("broken_lines"), F.when(F.col("none"), "not_an_object")))).alias("kind")
    theirs = by_line.select("artifact", kinds).groupBy("artifact", "kind").agg(F.count("*").alias("n")).withColumn("n_programs", none)
    return ours.unionByName(theirs).select(name, "kind", "n", "n_programs")


@query(f"""with {CANONICAL_SQL}, r as (select page_id, canonical, unnest([0, 1, 2]) as place from c),
    n as (select page_id, place, case when page_id % 7 = 6 then null when place = 0 then canonical when place = 1 and page_id % 3 = 0 then canonical when place = 2 and page_id % 5 < 3 then canonical end as url,
      case when place = 0 then '' when place = 1 then case page_id % 4 when 0 then 'n' || page_id when 1 then 'l' || page_id when 2 then '7' else '' end else '' end as label from r)
    select sha256(url) as target, url, arg_min(label, page_id * 3 + place) as label, count(*) as n_named from n where url is not null group by url""")
def target_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of documents made of pages, which list URLs and objects in all their forms."""
    i, url = F.col("page_id"), F.col("url")
    text = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    quoted = F.coalesce(text(url), F.lit("null"))
    number = i.cast("string")
    name = F.when(i % 4 == 0, F.concat(F.lit(',"name":"n'), number, F.lit('","label":"x"'))).when(i % 4 == 1, F.concat(F.lit(',"name":"","label":"l'), number, F.lit('"'))).when(i % 4 == 2, ',"name":7').otherwise(',"label":null')
    second = F.when(i % 3 == 0, F.concat(F.lit('{"url":"","site":'), quoted, name, F.lit("}"))).when(i % 3 == 1, '{"url":5,"site":"http://a.example/"}').otherwise('["http://a.example/"]')
    third = F.when(i % 5 < 3, F.concat(F.lit('{"url":'), quoted, F.lit("}"))).otherwise('"ftp://a.example/"')
    items = F.concat(F.lit("["), quoted, F.lit(","), second, F.lit(","), third, F.lit("]"))
    whole = F.when(i % 7 == 6, F.concat(F.lit('{"targets":null,"sites":'), items, F.lit("}"))).when(i % 7 == 5, F.concat(F.lit('{"sites":'), items, F.lit("}")))
    whole = whole.when(i % 7 == 4, F.concat(F.lit('{"targets":'), items, F.lit(',"sites":[]}'))).otherwise(items)
    return R.target_rows(load(spark, sf_dir, "pages").select("page_id", whole.alias("doc")), "page_id", "doc")


@query("""with c as (select conv_id, turn, coalesce(text, '') as t, (conv_id + turn) % 6 as k from conversations)
    select conv_id * 1000 + turn as corpus, 0 as place, 'q' || turn as id, sha256(t) as question from c where k <> 5 and t <> '' and k <> 3
    union all select conv_id * 1000 + turn, 2, '4', sha256('next') from c where k <> 5""")
def query_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of small corpora made of chat turns: lists, or objects with a list; some rows lack an id or a question."""
    k = (F.col("conv_id") + F.col("turn")) % 6
    row = F.struct(F.when(k != 3, F.concat(F.lit("q"), F.col("turn").cast("string"))).alias("id"), F.coalesce("text", F.lit("")).alias("query"))
    items = F.concat(F.lit("["), F.to_json(row), F.lit(',"no row",{"id":4,"query":"next"},{"id":0,"query":"zero"},{"id":"x","query":[]}]'))
    doc = F.when(k % 2 == 0, items).when(k == 5, F.concat(F.lit('{"queries":7,"more":'), items, F.lit("}"))).otherwise(F.concat(F.lit('{"v":1,"queries":'), items, F.lit("}")))
    rows = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("corpus"), doc.alias("doc"))
    return R.corpus_rows(rows, "corpus", "doc").select("corpus", "place", "id", F.sha2("query", 256).alias("question"))


@query("""with m as (select 'm' || p_size as material, case when p_size % 10 = 0 then 0 else count(*) end as n from part group by p_size),
    p as (select o_orderkey as probe, case when o_orderkey % 11 = 0 then [] else ['m' || (o_custkey % 54 + 1), 'm' || (o_orderkey % 50 + 1)] end as materials,
      case when o_orderkey % 13 = 0 then [] else [case o_orderkey % 6 when 0 then 'outer#x1' when 1 then 'other#1' when 2 then 'inner#' else 'inner#' || o_custkey end, 'outer#' || o_orderkey] end as targets from orders)
    select probe, null as item, 'no_materials' as problem from p where len(materials) = 0 union all select probe, null, 'no_targets' from p where len(targets) = 0
    union all select probe, item, case when n is null then 'unknown_material' else 'empty_material' end from (select distinct probe, unnest(materials) as item from p) left join m on material = item where n is null or n = 0
    union all select distinct probe, item, 'bad_target' from (select probe, unnest(targets) as item from p) where not regexp_full_match(item, '(inner|outer)#[0-9]+')""")
def graph_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as probes that need materials, made of part sizes, and aim at numbered targets."""
    part = load(spark, sf_dir, "part").select(F.concat(F.lit("m"), F.col("p_size").cast("string")).alias("material"), F.when(F.col("p_size") % 10 > 0, F.array("p_brand")).alias("items"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda n: F.concat(F.lit("m"), n.cast("string"))
    first = F.when(k % 6 == 0, "outer#x1").when(k % 6 == 1, "other#1").when(k % 6 == 2, "inner#").otherwise(F.concat(F.lit("inner#"), c.cast("string")))
    probes = load(spark, sf_dir, "orders").select(k.alias("probe"), F.when(k % 11 > 0, F.array(name(c % 54 + 1), name(k % 50 + 1))).alias("materials"),
        F.when(k % 13 > 0, F.array(first, F.concat(F.lit("outer#"), k.cast("string")))).alias("targets"))
    return A.probe_findings(probes, part, ["inner", "outer"])
