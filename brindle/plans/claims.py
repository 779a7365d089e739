"""Queries on claims, observation contracts, loosely shaped values and file names, made of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.functions import urls as U
from brindle.operators import audit as A
from brindle.operators import catalog as K
from brindle.operators.ledger import union_all
from brindle.operators import claims as C
from brindle.operators import paths as P
from brindle.operators.tiers import EVIDENCE_TIERS
from brindle.plans.contracts import errors_of, errors_sql
from brindle.plans.corpus import LINES_SQL, RULES, RULES_SQL, lines
from brindle.plans.inventory import FILES_SQL, files
from brindle.plans.registry import load, query

CLAIM_NAMES = [*C.CLAIMS, "Provider-Latency ", "miracles"]


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(f"""with t as (select event_type, {sql_list([*EVIDENCE_TIERS, "rumour"])}[user_id % 7 + 1] as tier, {sql_list(CLAIM_NAMES)}[event_id % {len(CLAIM_NAMES)} + 1] as claim from events),
    n as (select *, list_position({sql_list(EVIDENCE_TIERS)}, tier) as r, map({sql_list(C.CLAIMS)}, {sql_list(C.CLAIMS.values())})[replace(lower(trim(claim)), '-', '_')] as needed from t)
    select tier, claim, r >= list_position({sql_list(EVIDENCE_TIERS)}, needed) as allowed, count(*) as n from n group by all""")
def claim_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of events and whether their evidence tier allows them."""
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), (i % len(values)).cast("int"))
    rows = load(spark, sf_dir, "events").select(pick([*EVIDENCE_TIERS, "rumour"], F.col("user_id")).alias("tier"), pick(CLAIM_NAMES, F.col("event_id")).alias("claim"))
    return rows.groupBy("tier", "claim", C.allows(F.col("tier"), F.col("claim")).alias("allowed")).agg(F.count("*").alias("n"))


@query("select event_id, " + errors_sql({
    "unknown:schema": "event_id % 11 = 0", "unknown:agent_role": "event_id % 6 = 5", "unknown:lane": "user_id % 7 = 6", "not_an_object:observation": "event_id % 5 = 0",
    "blank:model": "event_id % 13 = 0", "blank:evidence_tier": "event_id % 17 = 0", "negative:tool_calls": "event_id % 19 = 0", "negative:files_read": "event_id % 23 = 0",
}) + " as errors from events")
def observation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that the envelopes and counters of observed runs break."""
    i, u = F.col("event_id"), F.col("user_id")
    pick = lambda values, k: F.get(F.array(*[F.lit(v) for v in values]), k.cast("int"))
    made = {n: F.lit("x") for n in C.ENVELOPE} | {n: F.lit(1) for n in C.COUNTERS}
    made |= {"model": F.when(i % 13 > 0, "m"), "evidence_tier": F.when(i % 17 == 0, " ").otherwise("live"), "tool_calls": F.when(i % 19 == 0, -1).otherwise(0), "files_read": F.when(i % 23 > 0, 2)}
    made |= {"schema": F.when(i % 11 > 0, "v1"), "agent_role": pick(C.ROLES, i % 6), "lane": pick(C.LANES, u % 7), "observation": F.when(i % 5 == 0, "[1]").otherwise(F.col("props"))}
    rows = load(spark, sf_dir, "events").withColumns(made)
    return errors_of(rows, ["event_id"], C.envelope_rules("v1") | C.counter_rules())


@query(f"""with k as (select *, {sql_list(C.SOURCE_ALIASES)} as names, map({sql_list(C.SOURCE_ALIASES)}, {sql_list(C.SOURCE_ALIASES.values())}) as m from orders),
    s as (select o_orderkey, [names[o_orderkey % 26 + 1], names[o_custkey % 26 + 1], o_orderpriority] as sources, m from k)
    select families, count(*) as n from (select array_to_string(list_sort(list_distinct(list_transform(sources, lambda x: coalesce(m[x], x)))), ',') as families from s) group by 1""")
def family_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the families of the sources they name."""
    names = F.array(*[F.lit(x) for x in C.SOURCE_ALIASES])
    sources = F.array(F.get(names, (F.col("o_orderkey") % 26).cast("int")), F.get(names, (F.col("o_custkey") % 26).cast("int")), F.col("o_orderpriority"))
    return load(spark, sf_dir, "orders").groupBy(F.array_join(C.source_families(sources), ",").alias("families")).agg(F.count("*").alias("n"))


@query("""select p_partkey, case p_partkey % 6 when 0 then 'Brand=' || p_brand || ';size=' || p_size || ';x={"unit":"mm"}' when 1 then 'brand=' || p_brand || ';size=7' when 2 then 'size=' || p_size when 3 then 'size=' || p_size || ';type=' || p_type else '' end as specs,
    case p_partkey % 5 when 0 then 'http://a/' || p_partkey when 1 then 'b' || p_size when 2 then 'u1,c' || p_partkey || ',s' when 3 then '' else '' end as images from part""")
def loose_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifications and images of parts in all shapes that a page may give them."""
    brand, size, kind, key = (F.col(c).cast("string") for c in ("p_brand", "p_size", "p_type", "p_partkey"))
    one = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    k = F.col("p_partkey")
    specs = (
        F.when(k % 6 == 0, one('{"Brand":"', brand, '","size":{"value":"","text":', size, '},"none":null,"x":{"unit":"mm"}}'))
        .when(k % 6 == 1, one('[{"key":"brand","value":"', brand, '"},["size",3],{"label":"size","displayValue":"7"},{"name":"lost"},5]'))
        .when(k % 6 == 2, one('[["size","', size, '"],["short"],{"value":"no key"}]'))
        .when(k % 6 == 3, one('{"type":"', kind, '","size":', size, "}"))
        .when(k % 6 == 4, one('"', brand, '"'))
    )
    images = F.when(k % 5 == 0, one('"http://a/', key, '"')).when(k % 5 == 1, one('{"src":"b', size, '","contentUrl":"z"}')).when(k % 5 == 2,
        one('["u1",{"contentUrl":"c', key, '"},{"x":1},""," s ",null]')).when(k % 5 == 3, F.lit("7"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(C.spec_map(specs))), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return load(spark, sf_dir, "part").select("p_partkey", text.alias("specs"), F.array_join(C.image_urls(images), ",").alias("images"))


@query(f"""with {FILES_SQL}, p as (select *, case doc_id % 10 when 3 then 'docs/2024-05-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') || '.md' when 4 then 'docs/history/2024_05_01.md' when 5 then 'a/__pycache__/' || doc_id || '.txt' when 6 then doc_id || '.pyc' else path end as q from f)
    select q as path, 'forbidden-artifact' as rule from p where doc_id % 10 in (5, 6) union all select q, 'date-named-document' from p where doc_id % 10 = 3 union all select q, 'fr-python' from p where regexp_matches(q, '^s.*/fr/.*\\.py$') union all select q, 'utf8' from p where doc_id % 10 = 7""")
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forbidden paths, artifacts, dated documents, and contents that are no UTF-8."""
    i = F.col("doc_id")
    day = F.lpad((i % 28 + 1).cast("string"), 2, "0")
    q = F.when(i % 10 == 3, F.concat(F.lit("docs/2024-05-"), day, F.lit(".md"))).when(i % 10 == 4, "docs/history/2024_05_01.md").when(i % 10 == 5,
        F.concat(F.lit("a/__pycache__/"), i.cast("string"), F.lit(".txt"))).when(i % 10 == 6, F.concat(i.cast("string"),
        F.lit(".pyc"))).otherwise(F.col("path"))
    rows = files(spark, sf_dir).select(q.alias("path"), F.when(i % 10 == 7, F.unhex(F.lit("C328")).cast("string")).otherwise(F.lit("ok")).alias("content"))
    forbidden = P.path_findings(rows, "path", [("s*/fr/*.py", "fr-python")]).withColumnRenamed("code", "rule")
    return P.name_hygiene(rows, "path", "content").unionByName(forbidden)


@query(f"""with {FILES_SQL}, g as (select doc_id % 7 = 0 as c, * from f)
    select 'python' as "group", count(*) filter (regexp_matches(path, '^s[^/]*/[^/]*/[^/]*\\.py$')) as n_matched,
        count(*) filter (c and regexp_matches(path, '^s[^/]*/[^/]*/[^/]*\\.py$')) as n_changed, 0::bigint as n_docs_changed,
        'missing_document' as problem from g
    union all select 'rust', count(*) filter (regexp_matches(path, '\\.rs$')), count(*) filter (c and regexp_matches(path, '\\.rs$')), 0, case
        when count(*) filter (c and regexp_matches(path, '\\.rs$')) > 0 then 'change_without_document' else '' end from g
    union all select 'loose', count(*) filter (regexp_matches(path, '/d[0-9]\\.ts$')), count(*) filter (c and regexp_matches(path, '/d[0-9]\\.ts$')), 0, '' from g union all select 'none', 0, 0, 0, 'no_match'""")
def paired_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of sources and documents, and what is wrong with each; the first document is looked up in the table."""
    f = files(spark, sf_dir)
    first = f.where("doc_id = 1").first()
    doc = first["path"] if first and first["path"] is not None else "docs/none.md"
    groups = {"python": (["s*/*/*.py"], [doc, "docs/lost.md"], True), "rust": (["**.rs"], [doc], True), "loose": (["**/d?.ts"], [doc], False), "none": (["*.nothing"], [doc], True)}
    return P.paired_changes(f, "path", F.col("doc_id") % 7 == 0, groups)


@query(f"""with {FILES_SQL}, p as (select lang || '_' || substr('abcdefghij', doc_id::integer % 10 + 1, 1) || '-v' || (doc_id % 3) || case doc_id % 2 when 0 then '.Py' else '.md' end as base, source || '/' || doc_id || '/' as dir from f),
    n as (select 'name' as kind, lower(base) as name, count(*) as n, min(dir || base) as first_path from p where regexp_matches(lower(base), '\\.py$') group by all having count(*) >= 3),
    v as (select 'family' as kind, regexp_replace(regexp_replace(regexp_replace(regexp_replace(base, '\\.[^.]*$', ''), '-v\\d+(?:-v\\d+)*$', ''),
        '\\d+$', ''), '[-_]+', ' ', 'g') as name, dir || base as path from p)
    select * from n union all select kind, name, count(*), min(path) from v group by kind, name having count(*) > 1""")
def like_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names that many files bear, and families of versions."""
    i = F.col("doc_id")
    base = F.concat("lang", F.lit("_"), F.substring(F.lit("abcdefghij"), (i % 10 + 1).cast("int"), F.lit(1)), F.lit("-v"), (i % 3).cast("string"), F.when(i % 2 == 0, ".Py").otherwise(".md"))
    rows = files(spark, sf_dir).select(F.concat("source", F.lit("/"), i.cast("string"), F.lit("/"), base).alias("path"))
    names = P.name_clusters(rows, "path").select(F.lit("name").alias("kind"), "name", "n", "first_path")
    return names.unionByName(P.version_families(rows, "path").select(F.lit("family").alias("kind"), F.col("family").alias("name"), "n", "first_path"))


@query(f"with {LINES_SQL}, t as (select unnest(['The', 'und ', 'zzz']) as term) select doc, line::integer as line, term from lines join t on contains(key, lower(term))")
def stale_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold a deprecated term."""
    return P.stale_terms(lines(spark, sf_dir), ["The", "und ", "zzz"])


@query(r"""select page_id, regexp_replace(regexp_replace(lower(trim(url)), '#.*$', ''), '/+(\?|$)', '\1') as key, sha256('{"id":' || page_id || ',"none":null,"url":"' || url || '"}') as digest,
      try_cast(nullif(regexp_extract(url, '[0-9]+(\.[0-9]+)?'), '') as double) as number from pages""")
def key_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity keys, canonical digests and first numbers of page URLs."""
    url = F.col("url")
    digest = T.canonical_sha256(url=url, id=F.col("page_id"), none=F.lit(None).cast("string"))
    return load(spark, sf_dir, "pages").select("page_id", U.url_key(url).alias("key"), digest.alias("digest"), T.first_number(url).alias("number"))


@query("""with p as (select p_partkey, case when p_partkey % 3 > 0 then ['a' || p_size, p_brand] else [] end as images from part)
    select p_partkey, i - 1 as place, images[i] as url, 'observed' as source, 'image' as source_field, 'http://x/' || p_partkey as source_url from (select *, unnest(generate_series(1, len(images))) as i from p)""")
def image_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of parts with their places and where they were observed."""
    k = F.col("p_partkey")
    images = F.when(k % 3 > 0, F.array(F.concat(F.lit("a"), F.col("p_size").cast("string")), F.col("p_brand"))).otherwise(F.array().cast("array<string>"))
    rows = K.image_provenance(images, F.lit("image"), F.concat(F.lit("http://x/"), k.cast("string")))
    return load(spark, sf_dir, "part").select("p_partkey", F.explode(rows).alias("x")).select("p_partkey", F.col("x.index").cast("long").alias("place"), "x.url", "x.source", "x.source_field", "x.source_url")


@query(f"""with {LINES_SQL}, {RULES_SQL}, f as (select label, null as line from documents, r where regexp_matches(text, p)
      union all select term, line from lines join (select unnest(['und ', 'zzz']) as term) on contains(key, term))
    select label, count(*) as n, count(line) as n_lines from f group by 1""")
def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of two scanners in one table, by label; those of the first have no line."""
    docs = load(spark, sf_dir, "documents")
    found = [A.scan_rules(docs, "doc_id", "text", RULES), P.stale_terms(lines(spark, sf_dir), ["und ", "zzz"]).withColumnRenamed("term", "label")]
    return union_all(found).groupBy("label").agg(F.count("*").alias("n"), F.count("line").alias("n_lines"))
