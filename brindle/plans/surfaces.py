"""Queries on files of a repository, made of documents, and on registries of components, made of suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import surfaces as S
from brindle.plans.registry import load, query

#: Folders and names that reach every class and target.
PLACES = ["src/Tests_/a", "x/tests/t", "pkg/test_it.py", "benchmark/run_", "tools/fix_", "a/scripts/edge-", "old/archive/k", "foundation_core/m", "private/policy_", "backend/persistence/q", "lib/CanonicalUrl_", "web\\\\Browser_", "net/FanOut_", "z/worker.py", "docs/history/n", "app/jsonld_", "plain/p", ".github/workflows/w"]
PLACES_SQL = "[" + ", ".join("'" + p.replace("\\\\", "\\") + "'" for p in PLACES) + "]"
PATHS_SQL = f"""f as (select doc_id, {PLACES_SQL}[doc_id % {len(PLACES)} + 1] || case when doc_id % {len(PLACES)} in (2, 13) then '' else source || '_d' || doc_id || case doc_id % 3 when 0 then '.py' when 1 then '.md' else '.ts' end end as path, text from documents)"""


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    places = F.array(*[F.lit(p.replace("\\\\", "\\")) for p in PLACES])
    k = (i % len(PLACES)).cast("int")
    name = F.concat("source", F.lit("_d"), i.cast("string"), F.when(i % 3 == 0, ".py").when(i % 3 == 1, ".md").otherwise(".ts"))
    return load(spark, sf_dir, "documents").select("doc_id", F.concat(F.get(places, k), F.when(k.isin(2, 13), "").otherwise(name)).alias("path"), "text")


def ladder_sql(rules: list, value: str, column: int) -> str:
    quote = lambda v: str(v) if isinstance(v, float) else f"'{v}'"
    return " ".join(f"when regexp_matches({value}, '{r[0]}') then {quote(r[column])}" for r in rules)


CLASS_SQL = f"case {ladder_sql(S.CLASSES, 'p', 1)} else 'other' end"


def target_sql(column: int) -> str:
    quote = lambda v: str(v) if isinstance(v, float) else f"'{v}'"
    by_class = " ".join(f"when class = '{k}' then {quote(v[column])}" for k, v in S.BY_CLASS.items())
    return f"case {ladder_sql(S.OWNERS, 'p', column + 1)} {by_class} else {quote(S.UNDECIDED[column])} end"


@query(f"""with {PATHS_SQL}, n as (select doc_id, replace(path, '\\', '/') as p from f), c as (select *, {CLASS_SQL} as class from n)
    select doc_id, class, {target_sql(0)} as language, {target_sql(1)} as disposition, {target_sql(2)}::double as confidence from c""")
def path_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by class, and where they should go."""
    path = F.col("path")
    return placed(spark, sf_dir).select("doc_id", S.path_class(path).alias("class"), S.path_target(path).alias("t")).select("doc_id", "class", "t.*")


DOMAINS_SQL = ", ".join("case when " + " or ".join(f"contains(lower(path), '{n.lower()}')" for n in needles) + f" then '{d}' end" for d, needles in S.DOMAINS.items())


@query(f"""with {PATHS_SQL}, d as (select doc_id, list_sort(list_filter([{DOMAINS_SQL}], lambda x: x is not null)) as l from f) select doc_id, case when len(l) = 0 then 'repository' else array_to_string(l, ',') end as domains from d""")
def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of work that files' paths speak for."""
    return placed(spark, sf_dir).select("doc_id", F.array_join(S.path_domains(F.col("path")), ",").alias("domains"))


@query(f"""with {PATHS_SQL}, s as (select path, strlen(t) as n_bytes, len(string_split(t, chr(10))) as n_lines from (select path, repeat(coalesce(text, '') || chr(10), case when doc_id % 4 = 0 then 9 else 3 end) as t from f))
    select path, n_bytes::bigint as n_bytes, n_lines::bigint as n_lines, case when n_bytes > 50000 or n_lines > 1000 then 'critical' else 'attention' end as severity, regexp_matches(replace(path, '\\', '/'), '{S.MADE}') as made from s where n_bytes > 25000 or n_lines > 500""")
def size_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large files, texts three or nine times over, by bytes and lines, historical ones marked."""
    text = F.repeat(F.concat(F.coalesce("text", F.lit("")), F.lit("\n")), F.when(F.col("doc_id") % 4 == 0, 9).otherwise(3))
    return S.source_sizes(placed(spark, sf_dir).select("path", text.alias("text")), "path", "text")


@query(f"""with {PATHS_SQL}, m as (select distinct path as module, replace(left(path, length(path) - 3), '/', '.') as dotted from f where ends_with(path, '.py')),
    b as (select path as file, coalesce(text, '') || ' see ' || coalesce(lag(path) over (order by doc_id), '') || ', x/' || coalesce(lag(path, 2) over (order by doc_id), '') || ' or ' || replace(coalesce(replace(lag(path, 4) over (order by doc_id), '.py', ''), ''), '/', '.') || ' now' as body from f)
    select distinct module, file from b join m on contains(body, module) or contains(body, dotted) where not ends_with(file, '.py')
      and regexp_matches(body, '(' || replace(module, '.', '[.]') || '|' || replace(dotted, '.', '[.]') || ')([^A-Za-z0-9_/.-]|$)')""")
def reverse_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files name which modules; each file's text names the files before it, by path, by longer path or by dotted name."""
    f = placed(spark, sf_dir)
    named = lambda back, name: f.select((F.col("doc_id") + back).alias("doc_id"), F.col("path").alias(name))
    j = f.join(named(1, "a"), "doc_id", "left").join(named(2, "b"), "doc_id", "left").join(named(4, "c"), "doc_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    body = F.concat(empty("text"), F.lit(" see "), empty("a"), F.lit(", x/"), empty("b"), F.lit(" or "), F.translate(F.replace(empty("c"), F.lit(".py"), F.lit("")), "/", "."), F.lit(" now"))
    return S.module_references(j.select("path", body.alias("text")), "path", "text")


@query("""with c as (select s_nationkey as registry, s_suppkey as component, s_nationkey % 5 = 1 and s_suppkey % 3 = 0 as bare, s_nationkey % 5 = 2 and s_suppkey % 4 = 0 as lost, s_nationkey % 5 = 3 and s_suppkey % 2 = 0 as loose, s_nationkey % 5 = 4 and s_suppkey % 7 = 0 as hidden from supplier),
    g as (select registry, count(*) as n, round(100 * count(*) filter (not bare) / count(*), 2) as registry_score, round(100 * count(*) filter (not lost) / count(*), 2) as r, round(100 * count(*) filter (not loose) / count(*), 2) as k, case when bool_or(hidden) or registry % 5 = 4 then 0.0 else 100.0 end as v from c group by registry),
    w as (select *, case when registry_score = 100 and r = 100 and k = 100 and v = 100 then 100.0 else 0.0 end as t from g)
    select registry, n, registry_score as fields, r as "references", k as controls, v::double as navigation, t::double as contract, round(registry_score * 0.2::double + r * 0.2::double + k * 0.2::double + v * 0.2::double + t * 0.2::double, 2) as score, case when t = 100 then 'PASS' else 'FAIL' end as status from w""")
def table_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as registries of suppliers, of which some lack fields, name unknown references, lack controls or can't be reached."""
    n, k = F.col("s_nationkey"), F.col("s_suppkey")
    of = lambda kind, mod: (n % 5 == kind) & (k % mod == 0)
    c = load(spark, sf_dir, "supplier").select(n.alias("nation"), k.alias("component"), F.when(~of(1, 3), F.col("s_name")).alias("owner"), F.col("s_name").alias("purpose"),
        F.array(F.when(of(2, 4), "nowhere").otherwise(F.concat(F.lit("n"), n.cast("string")))).alias("references"), F.when(of(3, 2), F.array(F.lit("audit"))).otherwise(F.array(F.lit("audit"), F.lit("quality"), F.lit("cost"))).alias("tags"))
    known = load(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"))
    extra = c.where("nation % 5 = 4").groupBy("nation").agg((F.max("component") + 1000000).alias("component"))
    links = c.where(~((F.col("nation") % 5 == 4) & (F.col("component") % 7 == 0))).select("nation", "component").unionByName(extra)
    out = S.completeness_report(c, ["nation"], ["owner", "purpose"], known, ("audit", "quality", "cost"), links)
    return out.select(F.col("nation").alias("registry"), "n", F.col("registry").alias("fields"), "references", "controls", "navigation", "contract", "score", "status")
