"""Queries on products, identifiers and URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.functions import urls as U
from brindle.operators import catalog as C
from brindle.operators import identity as I
from brindle.operators.work import small_batches, work_folder, written
from brindle.plans.registry import load, query

PRODUCTS_SQL = """products as (select p_partkey, p_name as name, p_brand as brand, 'P-' || p_partkey as code,
    case when p_size >= 27 then 'monitor' else p_type end as category,
    cast(cast(p_retailprice * 10 as decimal(12,2)) as varchar) as price, cast(p_retailprice * 10 as decimal(12,2)) as price_n,
    case when p_partkey % 5 = 0 then 'oled' else 'lcd' end as panel, 60 * (1 + p_partkey % 10) as hz, p_size as size from part)"""
OFFERS_SQL = """offers as (select l_partkey, l_orderkey, l_linenumber, cast(l_suppkey as varchar) as seller_id,
    case l_returnflag when 'N' then 'in stock' when 'R' then 'sold out' else 'unavailable' end as availability from lineitem)"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw product records as a shop might send them."""
    return load(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_name").alias("name"),
        F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("productCode"),
        F.struct(F.col("p_brand").alias("name")).alias("manufacturer"),
        F.when(F.col("p_size") >= 27, "monitor").otherwise(F.col("p_type")).alias("categoryName"),
        (F.col("p_retailprice") * 10).cast("decimal(12,2)").cast("string").alias("price"),
        F.create_map(F.lit("panel"), F.when(F.col("p_partkey") % 5 == 0, "oled").otherwise("lcd"), F.lit("hz"),
            (60 * (1 + F.col("p_partkey") % 10)).cast("string"), F.lit("screen_size"), F.col("p_size").cast("string")).alias("specs"),
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return load(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.col("l_suppkey").cast("string").alias("seller_id"),
        F.when(flag == "N", "in stock").when(flag == "R", "sold out").otherwise("unavailable").alias("availability"))


SIGNALS_SQL = """signals as (
    select p_partkey, brand, 'budget_oled_monitor' as code, 'high' as severity, 'panel' as field from products
      where (contains(lower(category || ' ' || name), 'monitor') or contains(lower(category || ' ' || name), 'display')) and panel = 'oled' and price_n < 10000
    union all
    select p_partkey, brand, 'extreme_refresh_price_combo', 'medium', 'refresh_rate' from products
      where (contains(lower(category || ' ' || name), 'monitor') or contains(lower(category || ' ' || name), 'display')) and hz >= 500 and size >= 27 and price_n < 25000)"""


@query(f"""with {PRODUCTS_SQL}, {OFFERS_SQL}, {SIGNALS_SQL},
    o as (select l_partkey, count(*) as n, count(*) filter (availability <> 'sold out') as n_in from offers group by 1),
    s as (select p_partkey, count(*) as n from signals group by 1)
    select brand, count(*) as n_products, coalesce(sum(o.n), 0)::bigint as n_offers, coalesce(sum(o.n_in), 0)::bigint as n_in_stock, coalesce(sum(s.n), 0)::bigint as n_signals
    from products left join o on o.l_partkey = products.p_partkey left join s on s.p_partkey = products.p_partkey group by brand""")
def catalog_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products, offers in stock and plausibility signals by brand."""
    mapped = C.map_product(products(spark, sf_dir), ["p_partkey"]).select("p_partkey", "brand", F.size("plausibility").alias("n_signals"))
    by_part = offers(spark, sf_dir).groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if(X.normalize_stock(F.col("availability")) == "In Stock").alias("n_in"))
    both = mapped.join(by_part, F.col("p_partkey") == F.col("l_partkey"), "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return both.groupBy("brand").agg(F.count("*").alias("n_products"), total("n").alias("n_offers"), total("n_in").alias("n_in_stock"), total("n_signals").alias("n_signals"))


@query(f"""with {PRODUCTS_SQL}, f as (
    select p_partkey, 0 as pos, 'identity' as family, 'title' as canonical, name as value, 'name' as source from products
    union all select p_partkey, 1, 'identity', 'sku', code, 'productCode' from products
    union all select p_partkey, 2, 'identity', 'brand', brand, 'manufacturer' from products
    union all select p_partkey, 3, 'taxonomy', 'category', category, 'categoryName' from products
    union all select p_partkey, 4, 'commercial', 'price', price, 'price' from products)
    select p_partkey, pos::integer as pos, family, canonical, value, source from f""")
def route_fields_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.route_fields(products(spark, sf_dir), ["p_partkey"])


@query(f"""with {PRODUCTS_SQL}, {SIGNALS_SQL}
    select p.p_partkey, p.name as title, p.code as sku, p.brand, p.category, p.price, 'Unknown' as stock, count(s.code) as n_signals
    from products p left join signals s on s.p_partkey = p.p_partkey group by all""")
def mapped_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.map_product(products(spark, sf_dir), ["p_partkey"])
    return out.select("p_partkey", "title", "sku", "brand", "category", "price", "stock", F.size("plausibility").cast("long").alias("n_signals"))


@query(f"""with {OFFERS_SQL} select l_partkey, count(*) as n_offers, count(distinct seller_id) as n_sellers,
    arg_min(seller_id, (l_orderkey, l_linenumber)) as first_seller, arg_min(case availability when 'sold out' then 'Out of Stock' else 'In Stock' end, (l_orderkey, l_linenumber)) as first_stock,
    count(*) filter (availability <> 'sold out') as n_in_stock from offers group by l_partkey""")
def offer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers by product; the first one fills in for the product's own price and stock."""
    o = offers(spark, sf_dir).withColumn("stock", X.normalize_stock(F.col("availability")))
    order = F.struct("l_orderkey", "l_linenumber")
    return o.groupBy("l_partkey").agg(F.count("*").alias("n_offers"), F.count_distinct("seller_id").alias("n_sellers"), F.min_by("seller_id",
        order).alias("first_seller"), F.min_by("stock", order).alias("first_stock"), F.count_if(F.col("stock") == "In Stock").alias("n_in_stock"))


@query("""with t as (select l_orderkey * 10 + l_linenumber as k, case l_returnflag when 'N' then 'Stock: ' when 'R' then 'availability - ' else '' end ||
      case l_linenumber % 7 when 0 then 'Sold  Out' when 1 then 'In-Stock' when 2 then 'Unavailable' when 3 then '0' when 4 then '12'
        when 5 then 'Pre-Order now' else 'discontinued' end as text from lineitem)
    select text, case when text ilike '%unavailable%' or text ilike '%in-stock%' then 'In Stock' when text ilike '%sold  out%' then 'Out of Stock'
        when text like '%12' then 'In Stock' when text like '%0' then 'Out of Stock'
      when text ilike '%pre-order%' then 'Pre-Book' else 'Discontinued' end as label, count(*) as n from t group by all""")
def stock_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, i = load(spark, sf_dir, "lineitem"), F.col("l_linenumber") % 7
    tail = F.when(i == 0, "Sold  Out").when(i == 1, "In-Stock").when(i == 2, "Unavailable").when(i == 3, "0").when(i == 4, "12").when(i == 5, "Pre-Order now").otherwise("discontinued")
    head = F.when(F.col("l_returnflag") == "N", "Stock: ").when(F.col("l_returnflag") == "R", "availability - ").otherwise("")
    counts = li.groupBy(F.concat(head, tail).alias("text")).agg(F.count("*").alias("n"))
    return counts.select("text", X.normalize_stock(F.col("text")).alias("label"), "n")


@query(f"with {PRODUCTS_SQL}, {SIGNALS_SQL} select p_partkey, code, severity, field from signals")
def plausibility_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.map_product(products(spark, sf_dir), ["p_partkey"])
    return out.select("p_partkey", F.explode("plausibility").alias("s")).select("p_partkey", "s.*")


CANONICAL_SQL = """c as (select page_id, url, case when regexp_matches(url, '^(?i)https?://[^/?#]+') then
      lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) || case when regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' then '/'
        else regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) end
      || regexp_extract(url, '^[^?#]*(\\?[^#]*)?', 1) end as canonical from pages)"""


@query(f"with {CANONICAL_SQL} select page_id, canonical from c")
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


@query(f"""with {CANONICAL_SQL}, v as (select page_id, case page_id % 5 when 0 then url when 1 then replace(url, '://', '://u:p@') when 2 then replace(url, 'http', 'ftp')
      when 3 then 'http://10.0.' || page_id % 250 || '.1/x' else replace(url, '://', '://www.') end as url, page_id % 5 as k, canonical from c)
    select page_id, case k when 0 then canonical when 4 then replace(canonical, '://', '://www.') end as safe_url,
      case k when 1 then 'userinfo in URL is not allowed' when 2 then 'only http and https URLs are allowed' when 3 then 'target host is not allowed' end as reason from v""")
def url_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe form or refusal of each page URL and of unsafe variants of it."""
    i, url = F.col("page_id") % 5, F.col("url")
    made = F.when(i == 0, url).when(i == 1, F.replace(url, F.lit("://"), F.lit("://u:p@"))).when(i == 2, F.replace(url, F.lit("http"),
        F.lit("ftp"))).when(i == 3, F.concat(F.lit("http://10.0."), (F.col("page_id") % 250).cast("string"), F.lit(".1/x"))).otherwise(F.replace(url,
        F.lit("://"), F.lit("://www.")))
    checked = load(spark, sf_dir, "pages").select("page_id", U.safe_url(made).alias("s"))
    return checked.select("page_id", F.col("s.url").alias("safe_url"), F.col("s.reason").alias("reason"))


@query(f"with {CANONICAL_SQL} select min(page_id) as page_id, canonical, count(*) as n_targets from c where canonical is not null group by canonical")
def target_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets by canonical URL; the first of each stays."""
    t = load(spark, sf_dir, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical")).where("canonical is not null")
    return t.groupBy("canonical").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n_targets"))


@query(f"""with {CANONICAL_SQL} select (('0x' || substr(sha256(canonical), 1, 16))::ubigint % 16)::integer as shard, count(*) as n from c where canonical is not null group by 1""")
def shard_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = U.target_key(F.col("url"))
    return load(spark, sf_dir, "pages").where(key.isNotNull()).groupBy(U.shard_of(key, 16).alias("shard")).agg(F.count("*").alias("n"))


#: Case folding of the letters that the tables have: lower case, and the sharp s as two.
FOLDED_SQL = "replace(lower(t), 'ß', 'ss')"


@query(rf"""with d as (select doc_id, trim(regexp_replace(translate(replace(replace(replace(coalesce(text, ''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') || case when doc_id % 3 = 0 then ' &eacute;tude ＡＢＣ ﬁn' else '' end, '‐‑‒–—−', '------'), '[\s\x{{A0}}]+', ' ', 'g')) as t from documents),
    n as (select doc_id, replace(replace(replace(t, '&eacute;', 'é'), 'ＡＢＣ', 'ABC'), 'ﬁ', 'fi') as t from d), f as (select doc_id, t, {FOLDED_SQL} as low from n),
    w as (select doc_id, list_distinct(list_filter(string_split(regexp_replace(low, '[^a-z0-9+./_-]+', ' ', 'g'), ' '), lambda x: length(x) > 1 and x not in ('buy','online','india','best','price','new','sale','official','store','shop','free','shipping','warranty','the','and','with','for','offer','offers','deal','deals'))) as w from f)
    select doc_id, sha256(t) as cleaned, sha256(low) as folded, sha256(rtrim(ltrim(low, ' ._-' || chr(9)), ' ._-' || chr(9))) as brand, len(w) as n_tokens, sha256(array_to_string(list_sort(w), ' ')) as tokens from f join w using (doc_id)""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of documents in the forms that names and titles are compared in; every third ends with an entity, wide letters and a ligature."""
    more = F.when(F.col("doc_id") % 3 == 0, " &eacute;tude ＡＢＣ ﬁn").otherwise("")
    d = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), more).alias("t"))
    of = lambda c: F.sha2(c, 256)
    # one step each, so that a form isn't worked out again for the next
    folded = d.select("doc_id", X.clean_text(F.col("t")).alias("c")).select("doc_id", "c", X.fold(F.col("c")).alias("f"))
    words = folded.select("doc_id", "c", "f", X.folded_words(F.col("f")).alias("w"))
    out = words.select("doc_id", of(F.col("c")).alias("cleaned"), of(F.col("f")).alias("folded"), of(X.folded_brand(F.col("f"))).alias("brand"), F.size("w").cast("long").alias("n_tokens"), of(F.array_join(F.array_sort("w"), " ")).alias("tokens"))
    # texts run up to megabytes: only few may wait in a Python worker, so the digests are written while the batches are small
    with small_batches(spark):
        return written(out, work_folder(spark, "forms"))


@query("""with w as (select p_partkey, unnest(string_split(regexp_replace(lower(p_name), '[^a-z0-9+./_-]+', ' ', 'g'), ' ')) as t, generate_subscripts(string_split(regexp_replace(lower(p_name), '[^a-z0-9+./_-]+', ' ', 'g'), ' '), 1) as i from part),
    k as (select p_partkey, t, min(i) as i from w where length(t) > 1 and t not in
        ('buy','online','india','best','price','new','sale','official','store','shop','free','shipping','warranty','the','and','with','for','offer','offers','deal','deals') group by all)
    select p.p_partkey, coalesce(string_agg(t, ' ' order by i), '') as tokens, count(t) as n_tokens from part p left join k on k.p_partkey = p.p_partkey group by p.p_partkey""")
def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = X.title_words(F.col("p_name"), ascii_only=True)
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(words, " ").alias("tokens"), F.size(words).cast("long").alias("n_tokens"))


@query("""with b as (select p_partkey, p_brand, case p_partkey % 4 when 0 then ' ASUSTeK ' when 1 then 'Western  Digital.' when 2 then 'hewlett-packard' else p_brand end as brand,
      case p_partkey % 5 when 0 then 'Gaming_Laptop' when 1 then 'replacement tips' when 2 then '27 inch display panel' when 3 then 'RGB mousepad' else p_type end as category, p_type from part)
    select p_partkey, case p_partkey % 4 when 0 then 'asus' when 1 then 'western digital' when 2 then 'hp' else lower(p_brand) end as brand,
      case p_partkey % 5 when 0 then 'laptop' when 1 then 'other' when 2 then 'monitor' when 3 then 'mousepad' else lower(p_type) end as category from b""")
def brand_category_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand and category labels; the few distinct labels are normalized once and joined back."""
    i, j = F.col("p_partkey") % 4, F.col("p_partkey") % 5
    rows = load(spark, sf_dir, "part").select("p_partkey", F.when(i == 0, " ASUSTeK ").when(i == 1, "Western  Digital.").when(i == 2,
        "hewlett-packard").otherwise(F.col("p_brand")).alias("b"), F.when(j == 0, "Gaming_Laptop").when(j == 1, "replacement tips").when(j == 2,
        "27 inch display panel").when(j == 3, "RGB mousepad").otherwise(F.col("p_type")).alias("c"))
    brands = rows.select("b").distinct().select("b", X.normalize_brand(F.col("b"), True).alias("brand"))
    categories = rows.select("c").distinct().select("c", X.normalize_category(F.col("c"), True).alias("category"))
    return rows.join(brands, "b").join(categories, "c").select("p_partkey", "brand", "category")


@query("""with i as (select p_partkey, case p_partkey % 6 when 0 then 'N/A' when 1 then ' ab_' || p_partkey || ' x' when 2 then 'model' else p_name end as v, case p_partkey % 3 when 0 then 'mpn' when 1 then 'sku' else 'variant_id' end as kind from part)
    select p_partkey, kind, case when v = 'N/A' then '' when kind = 'mpn' and upper(v) = 'MODEL' then ''
      else substr(case when kind = 'mpn' then replace(regexp_replace(upper(trim(v)), '\\s+', '', 'g'), '_', '-') else regexp_replace(upper(trim(v)), '\\s+', '', 'g') end, 1, case when kind = 'variant_id' then 96 else 80 end) end as identifier from i""")
def identifier_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, j = F.col("p_partkey") % 6, F.col("p_partkey") % 3
    rows = load(spark, sf_dir, "part").select("p_partkey", F.when(i == 0, "N/A").when(i == 1, F.concat(F.lit(" ab_"),
        F.col("p_partkey").cast("string"), F.lit(" x"))).when(i == 2, "model").otherwise(F.col("p_name")).alias("v"), F.when(j == 0,
        "mpn").when(j == 1, "sku").otherwise("variant_id").alias("kind"))
    return rows.select("p_partkey", "kind", X.normalize_identifier(F.col("v"), F.col("kind"), True).alias("identifier"))


@query("""with g as (select p_partkey, lpad(cast(400000000000 + p_partkey * 7919 as varchar), 12, '0') as d from part),
    s as (select p_partkey, d, (10 - (select sum(cast(substr(d, i, 1) as integer) * case when i % 2 = 0 then 3 else 1 end) from range(1, 13) t(i)) % 10) % 10 as chk from g)
    select p_partkey, case p_partkey % 3 when 2 then '' else '0' || d || chk end as gtin from s""")
def gtin_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EAN-13 codes made from part keys, a third of them with a wrong check digit."""
    d = F.lpad((F.lit(400000000000) + F.col("p_partkey") * 7919).cast("string"), 12, "0")
    total = sum((F.substring("d", i, 1).cast("int") * (3 if i % 2 == 0 else 1) for i in range(1, 13)), F.lit(0))
    rows = load(spark, sf_dir, "part").select("p_partkey", d.alias("d")).withColumn("chk", (10 - total % 10) % 10)
    wrong = F.when(F.col("p_partkey") % 3 == 2, (F.col("chk") + 1) % 10).otherwise(F.col("chk"))
    return rows.select("p_partkey", X.normalize_gtin(F.concat(F.lit("EAN13: "), "d", wrong.cast("string")), True, True).alias("gtin"))


PAIRS_SQL = """t as (select p_partkey as id, 's' || p_partkey as sku, lower(trim(p_brand)) as brand, lower(trim(p_name)) as title, case when p_partkey % 2 = 0 then 'in' else 'us' end as region from part),
    c as (select id + 1000000 as id, case when id % 3 = 0 or id % 7 = 0 then null else sku end as sku, brand, title, case when id % 7 = 0 then null when id % 5 = 0 then 'eu' else region end as region from t),
    tk as (select sku, brand, title, region, min(id) as rep, count(*) as n from t group by all), ck as (select sku, brand, title, region, min(id) as rep, count(*) as n from c group by all),
    tg as (select brand, title, region, sku is not null as has, min(rep) as grp, sum(n) as n from tk group by all), cg as (select brand, title, region, sku is not null as has, min(rep) as grp, sum(n) as n from ck group by all),
    st as (select a.*, b.rep as c_rep, b.n as c_n, b.brand as c_brand, b.title as c_title, b.region as c_region from tk a join ck b on a.sku = b.sku),
    listed as (select tg.grp as t_grp, cg.grp as c_grp, sum(st.n * st.c_n) as listed from st join tg on tg.brand = st.brand and tg.title = st.title and tg.region is not distinct from st.region and tg.has
      join cg on cg.brand = st.c_brand and cg.title = st.c_title and cg.region is not distinct from st.c_region and cg.has where st.brand = st.c_brand and st.title = st.c_title group by all)"""
REASON_SQL = "case when x <> '' then 'identity conflict' when contains(m, 'sku') then 'exact identity match' else 'exact brand and title match' end"


@query(f"""with {PAIRS_SQL},
    d as (select 'strong' as kind, rep as t_rep, c_rep, n * c_n as n_pairs, 'sku' || case when brand = c_brand then ',brand' else '' end || case when region = c_region then ',region' else '' end as m,
        ltrim(case when brand <> c_brand then ',brand' else '' end || case when region <> c_region then ',region' else '' end, ',') as x from st
      union all select 'soft', a.grp, b.grp, a.n * b.n - coalesce(listed, 0), 'brand' || case when a.region = b.region then ',region' else '' end,
        ltrim(case when a.has and b.has then ',sku' else '' end || case when a.region <> b.region then ',region' else '' end, ',')
      from tg a join cg b on a.brand = b.brand and a.title = b.title left join listed on t_grp = a.grp and c_grp = b.grp where a.n * b.n > coalesce(listed, 0))
    select kind, null::bigint as id, t_rep, c_rep, null::bigint as "group", n_pairs::bigint as n_pairs, m as matched, x as conflicts, x = '' as accepted, {REASON_SQL} as reason from d
    union all select 'target', t.id, tk.rep, null, tg.grp, null, null, null, null, null from t join tk using (sku, brand, title, region) join tg on tg.has and tg.brand = t.brand and tg.title = t.title and tg.region = t.region
    union all select 'candidate', c.id, null, ck.rep, cg.grp, null, null, null, null, null from c join ck on ck.sku is not distinct from c.sku and ck.brand = c.brand and ck.title = c.title and ck.region is not distinct from c.region
      join cg on cg.has = (c.sku is not null) and cg.brand = c.brand and cg.title = c.title and cg.region is not distinct from c.region""")
def entity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts matched with a copy that lost or changed some fields: decisions between classes and groups, and the class and group of each record of both sides, so that no pair is lost."""
    found = I.match_classes(*entity_sides(spark, sf_dir))
    out = found.decisions.select("kind", "t_rep", "c_rep", "n_pairs", F.array_join("matched", ",").alias("matched"), F.array_join("conflicts", ",").alias("conflicts"), "accepted", "reason")
    member = lambda df, kind, rep: df.select(F.lit(kind).alias("kind"), "id", F.col("rep").alias(rep), "group")
    members = member(found.t_members, "target", "t_rep").unionByName(member(found.c_members, "candidate", "c_rep"), allowMissingColumns=True)
    return out.unionByName(members, allowMissingColumns=True).select("kind", "id", "t_rep", "c_rep", "group", "n_pairs", "matched", "conflicts", "accepted", "reason")


@query(f"""with {PAIRS_SQL} select c.id, ck.rep, cg.grp as "group" from c join ck on ck.sku is not distinct from c.sku and ck.brand = c.brand and ck.title = c.title and ck.region is not distinct from c.region
    join cg on cg.has = (c.sku is not null) and cg.brand = c.brand and cg.title = c.title and cg.region is not distinct from c.region""")
def entity_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate's class and group."""
    return I.match_classes(*entity_sides(spark, sf_dir)).c_members


def entity_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, i = F.col("p_partkey"), F.col("id")
    t = load(spark, sf_dir, "part").select(k.alias("id"), F.concat(F.lit("S"), k.cast("string")).alias("sku"), F.col("p_brand").alias("brand"),
        F.col("p_name").alias("title"), F.when(k % 2 == 0, "in").otherwise("us").alias("region"))
    c = t.select((i + 1000000).alias("id"), F.when((i % 3 != 0) & (i % 7 != 0), F.col("sku")).alias("sku"), "brand", "title", F.when(i % 7 == 0,
        None).when(i % 5 == 0, "eu").otherwise(F.col("region")).alias("region"))
    return t, c
