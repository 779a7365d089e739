"""Queries on lineage: documents as artifacts that are derived from one another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import lineage as N
from brindle.plans.registry import load, query

# Sixteen documents are a family, derived one from the one before, the eighth also from the third; every eleventh map but two
# is lost; in every twentieth family the second document claims to be made of the third.
MAPS_SQL = """d as (select doc_id as id, length(coalesce(text, ''))::bigint as n, doc_id % 16 as b, (doc_id // 16) % 20 = 5 as ring from documents),
    e as (select id, n, id - 1 as parent_id from d where b > 0 and not (ring and b = 1) union all select id, n, id - 5 from d where b = 7 union all select id, n, id + 1 from d where ring and b = 1),
    j as (select e.*, p.n as pn from e join d p on p.id = e.parent_id),
    m as (select id, parent_id, null::bigint as start, null::bigint as "end", null::bigint as origin from j where id % 11 = 3
      union all select id, parent_id, 0, greatest(0, least(n // 2, pn - id % 7)), id % 7 from j where id % 11 <> 3
      union all select id, parent_id, n // 2 + 3, greatest(n // 2 + 3, least(n, n // 2 + 3 + pn - pn // 2)), pn // 2 from j where id % 11 <> 3),
    x as (select id, parent_id, bool_and(start is null) as lost from m group by all)"""
SPANS_SQL = f"""{MAPS_SQL},
    s as (select id, parent_id as anc, start, "end", origin, 1 as depth from m where start < "end"
      union select s.id, m.parent_id, greatest(s.start, m.start + s.start - s.origin), least(s."end", m."end" + s.start - s.origin),
        m.origin + greatest(s.start, m.start + s.start - s.origin) - (s.start - s.origin) - m.start, s.depth + 1
      from s join m on m.id = s.anc where m.start is not null and s.depth < 40 and greatest(s.start, m.start + s.start - s.origin) < least(s."end", m."end" + s.start - s.origin)),
    spans as (select distinct id, anc as source, start, "end", origin from s where anc not in (select id from x))"""


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span maps of documents as artifacts, some of them lost, some in a ring."""
    i = F.col("doc_id")
    d = load(spark, sf_dir, "documents").where("doc_id is not null").select(i.alias("id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), (i % 16).alias("b"), (F.floor(i / 16) % 20 == 5).alias("ring"))
    turned = F.col("ring") & (F.col("b") == 1)
    parents = F.array_compact(F.array(F.when((F.col("b") > 0) & ~turned, F.col("id") - 1), F.when(F.col("b") == 7, F.col("id") - 5), F.when(turned, F.col("id") + 1)))
    e = d.select("id", "n", F.explode(parents).alias("parent_id")).join(d.select(F.col("id").alias("parent_id"), F.col("n").alias("pn")), "parent_id")
    n, pn, half = F.col("n"), F.col("pn"), F.floor(F.col("n") / 2)
    one = lambda start, end, at: F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), at.cast("long").alias("origin"))
    at, far = F.col("id") % 7, F.floor(pn / 2)
    kept = F.array(one(F.lit(0), F.greatest(F.lit(0), F.least(half, pn - at)), at), one(half + 3, F.greatest(half + 3, F.least(n, half + 3 + pn - far)), far))
    none = F.lit(None)
    return e.select("id", "parent_id", F.explode(F.when(F.col("id") % 11 == 3, F.array(one(none, none, none))).otherwise(kept)).alias("s")).select("id", "parent_id", "s.*")


@query(f"""with recursive {SPANS_SQL},
    w as (select id, parent_id as anc, lost, 1 as depth from x union select w.id, x.parent_id, w.lost or x.lost, w.depth + 1 from w join x on x.id = w.anc where w.depth < 40),
    r as (select id, anc as source, bool_and(lost) as lost, min(depth)::bigint as near, max(depth)::bigint as far from w where anc not in (select id from x) group by all),
    o as (select id, source, count(*) as n, sum("end" - start)::bigint as c from spans group by all)
    select r.id, r.source, case when o.n > 0 then 'mapped' when lost then 'MAPPING_LOST' else 'unmapped' end as state, near, far, coalesce(o.n, 0) as n_spans, coalesce(o.c, 0) as n_chars from r left join o on o.id = r.id and o.source = r.source
    union all select distinct id, null, 'cycle', null, null, 0, 0 from w where depth > 20""")
def lineage_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each document can be traced to which source, over up to fifteen steps."""
    return N.span_closure(maps(spark, sf_dir)).states


@query(f"""with recursive {SPANS_SQL}, q as (select id as source, 30 as a, 90 as z from d where b = 0)
    select source, a::bigint as asked_start, z::bigint as asked_end, id, start + greatest(origin, a) - origin as start, start + least(origin + "end" - start, z) - origin as "end"
    from spans join q using (source) where greatest(origin, a) < least(origin + "end" - start, z)""")
def lineage_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which characters of derived documents come from characters 30 to 90 of each source."""
    sources = load(spark, sf_dir, "documents").where("doc_id % 16 = 0").select(F.col("doc_id").alias("source"), F.lit(30).cast("long").alias("asked_start"), F.lit(90).cast("long").alias("asked_end"))
    return N.derived_from(N.span_closure(maps(spark, sf_dir)).spans, sources)
