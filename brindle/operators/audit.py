"""Corpus audit: duplicate and conflicting lines, disclosure, hygiene, similarity, set differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A line counts as a possible duplicate from this length on.
LEAST_LINE = 24


def line_key(line: Column) -> Column:
    """Trimmed, lower-cased line without list marks, white space collapsed."""
    plain = F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))
    return F.when(plain.startswith("-") | plain.startswith("*"), F.trim(F.regexp_replace(plain, r"^([-*]\s*)+", ""))).otherwise(plain)


def lines_of(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, line (from 1), raw, key of each line that isn't blank or a fence."""
    # keys are made before the lines are exploded, so that later filters don't make them again
    keyed = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda x: F.struct(x.alias("raw"), line_key(x).alias("key")))
    rows = docs.select(F.col(doc).alias("doc"), F.posexplode(keyed).alias("i", "x"))
    return rows.select("doc", (F.col("i") + 1).alias("line"), "x.raw", "x.key").where((F.col("key") != "") & ~F.col("key").startswith("```"))


def duplicate_lines(lines: DataFrame) -> DataFrame:
    """(doc, line, owner_doc, owner_line) of lines that an earlier document has: its last occurrence there owns them.

    Lines meet by two hashes of their keys, 128 bits together, and are
    aggregated by key and document before anything of a key comes together.
    """
    long = lines.where(F.length("key") >= LEAST_LINE).select("doc", "line", F.xxhash64("key").alias("h"), F.xxhash64(F.reverse("key"), F.lit(1)).alias("h2"))
    # of each key and document the last line, the number of lines and their places
    last = long.groupBy("h", "h2", "doc").agg(F.max("line").alias("owner_line"), F.array_sort(F.collect_list("line")).alias("places"))
    owner = last.groupBy("h", "h2").agg(F.min(F.struct("doc", "owner_line")).alias("o"), F.count("*").alias("docs")).where("docs > 1")
    again = last.select("h", "h2", "doc", "places").join(owner, ["h", "h2"]).where(F.col("doc") != F.col("o.doc"))
    return again.select("doc", F.explode("places").alias("line"), F.col("o.doc").alias("owner_doc"), F.col("o.owner_line").alias("owner_line"))


def conflicting_lines(lines: DataFrame) -> DataFrame:
    """(doc, line, subject) of must and must-not lines on the same subject."""
    no, yes = F.col("key").contains("must not "), F.col("key").contains("must ")
    after = lambda mark: F.expr(f"substring(key, locate('{mark}', key) + {len(mark)})")
    subject = F.when(no, after("must not ")).when(yes, after("must "))
    said = lines.select("doc", "line", subject.alias("subject"), (~no).alias("positive")).where("subject is not null")
    both = said.groupBy("subject").agg(F.count_distinct("positive").alias("n")).where("n = 2")
    return said.join(both, "subject").select("doc", "line", "subject")


def scan_rules(docs: DataFrame, doc: str, text: str, rules: list[tuple[str, str, str]], exempt: DataFrame | None = None) -> DataFrame:
    """(doc, severity, label, fingerprint) for each rule (pattern, severity, label) that a text matches."""
    # most texts match no rule, which one pattern tells; no rule matches an empty text, so what is extracted tells which do
    docs = docs.where(F.col(text).rlike("|".join(f"(?:{p})" for p, _, _ in rules)))
    every = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(name).alias("label"), F.regexp_extract(text, f"({p})", 1).alias("hit")) for p, s, name in rules])
    hits = F.filter(every, lambda x: x["hit"] != "")
    found = docs.select(F.col(doc).alias("doc"), F.explode(hits).alias("h")).select("doc", "h.severity", "h.label", F.left(F.sha2("h.hit", 256), F.lit(16)).alias("fingerprint"))
    return found if exempt is None else found.join(exempt, ["doc", "label"], "left_anti")


def text_hygiene(docs: DataFrame, doc: str, text: str, max_bytes: int = 1 << 20) -> DataFrame:
    """One row of flags a document."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc).alias("doc"),
        t.contains("\x00").alias("has_nul"),
        t.contains("\r").alias("has_cr"),
        (~t.endswith("\n")).alias("no_final_newline"),
        t.rlike(r"[ \t](\n|$)").alias("trailing_space"),
        t.rlike(r"(^|\n)\t").alias("tab_indent"),
        (F.octet_length(t) > max_bytes).alias("oversize"),
        F.octet_length(t).cast("long").alias("n_bytes"),
    )


def collisions(cases: DataFrame, key: str, id_col: str, known: DataFrame | None = None) -> DataFrame:
    """(id, key, first_id) of rows whose key an earlier row has; ``known`` keys collide from the first row on."""
    first = cases.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_col).alias("first_id"), F.count("*").alias("n"))
    again = cases.join(first.where("n > 1"), key).where(F.col(id_col) > F.col("first_id")).select(F.col(id_col).alias("id"), key, "first_id")
    if known is None:
        return again
    old = cases.join(known.select(key).distinct(), key, "left_semi").select(F.col(id_col).alias("id"), key, F.lit(None).cast(cases.schema[id_col].dataType).alias("first_id"))
    return again.join(old, ["id"], "left_anti").unionByName(old)


def policy_diff(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key, relation: exact, divergent, left_only or right_only."""
    r = right.select(key, F.col(value).alias("__r"), F.lit(True).alias("__in_r"))
    both = left.select(key, F.col(value).alias("__l"), F.lit(True).alias("__in_l")).join(r, key, "full_outer")
    relation = F.when(F.col("__in_r").isNull(), "left_only").when(F.col("__in_l").isNull(), "right_only").when(F.col("__l").eqNullSafe(F.col("__r")), "exact").otherwise("divergent")
    return both.select(key, relation.alias("relation"))


def similar_pairs(left: DataFrame, right: DataFrame, sets: list[str], at_least: float) -> DataFrame:
    """(left_id, right_id, score): mean Jaccard of the array columns ``sets``, over a positive bound.

    A mean reaches the bound only if one of the sets does, and two sets reach it
    only if their sizes are near enough and they share one of their rarest
    tokens, so many that the others can't make the bound. Pairs meet by those
    tokens only and are scored by their whole sets.
    """
    own = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), *[F.array_distinct(F.coalesce(F.col(s), F.array().cast("array<string>"))).alias(f"{p}_{s}") for s in sets])
    l, r = own(left, "left"), own(right, "right")  # noqa: E741

    def found(s: str) -> DataFrame:
        tokens = lambda df, p: df.select(f"{p}_id", F.size(f"{p}_{s}").alias(f"{p}_n"), F.explode(f"{p}_{s}").alias("t"))
        a, b = tokens(l, "left"), tokens(r, "right")
        often = a.select("t").unionAll(b.select("t")).groupBy("t").agg(F.count("*").alias("c"))

        def rarest(rows: DataFrame, p: str) -> DataFrame:
            n = F.col(f"{p}_n")
            # a hair less than the bound asks for, so that rounding of floats never loses a pair
            first = n - F.ceil(n * at_least - 1e-9).cast("int") + 1
            ordered = rows.join(often, "t").groupBy(f"{p}_id", f"{p}_n").agg(F.array_sort(F.collect_list(F.struct("c", "t"))).alias("x"))
            return ordered.select(f"{p}_id", f"{p}_n", F.explode(F.slice("x", 1, F.greatest(first, F.lit(1)))).alias("x")).select(f"{p}_id", f"{p}_n", "x.t")

        near = (F.col("left_n") >= F.col("right_n") * at_least - 1e-9) & (F.col("right_n") >= F.col("left_n") * at_least - 1e-9)
        return rarest(a, "left").join(rarest(b, "right"), "t").where(near).select("left_id", "right_id")

    pairs = reduce(DataFrame.unionByName, [found(s) for s in sets]).distinct()
    j = pairs.join(l, "left_id").join(r, "right_id")

    def one(s: str) -> Column:
        both = F.size(F.array_intersect(f"left_{s}", f"right_{s}"))
        return F.coalesce(both / F.nullif(F.size(f"left_{s}") + F.size(f"right_{s}") - both, F.lit(0)), F.lit(0.0))

    scored = j.select("left_id", "right_id", F.round(sum((one(s) for s in sets), F.lit(0.0)) / len(sets), 6).alias("score"))
    return scored.where(F.col("score") >= at_least)


def token_classes(rows: DataFrame, sets: list[str]) -> tuple[DataFrame, DataFrame]:
    """(id, *sets, n): rows of equal token sets as one class, named by its smallest id; and (id, class_id) of every row."""
    keyed = rows.select("id", *[F.array_sort(F.array_distinct(F.coalesce(F.col(s), F.array().cast("array<string>")))).alias(s) for s in sets])
    classes = keyed.groupBy(*sets).agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
    return classes.withColumnRenamed("class_id", "id"), keyed.join(classes, sets).select("id", "class_id")


def similar_classes(rows: DataFrame, sets: list[str], at_least: float) -> DataFrame:
    """(left_id, right_id, score, n_left, n_right): all similar pairs of ``rows`` as pairs of classes, each once.

    A class of several rows is listed with itself, as its rows resemble each
    other. Tokens meet once a class, so a token of many equal rows stays small.
    """
    classes, _ = token_classes(rows, sets)
    size = lambda side: classes.select(F.col("id").alias(f"{side}_id"), F.col("n").alias(f"n_{side}"))
    pairs = similar_pairs(classes, classes, sets, at_least).where("left_id <= right_id").join(size("left"), "left_id").join(size("right"), "right_id")
    return pairs.where("left_id < right_id or n_left > 1").select("left_id", "right_id", "score", "n_left", "n_right")


def similar_links(rows: DataFrame, sets: list[str], at_least: float) -> DataFrame:
    """(id, class_id, n_links) of every row: how many other rows resemble it; 0 where it pairs with none."""
    _, members = token_classes(rows, sets)
    pairs = similar_classes(rows, sets, at_least)
    own = F.when(F.col("left_id") == F.col("right_id"), F.col("n_left") - 1).otherwise(F.col("n_right"))
    ends = pairs.select(F.col("left_id").alias("class_id"), own.alias("k")).unionByName(pairs.where("left_id < right_id").select(F.col("right_id").alias("class_id"), F.col("n_left").alias("k")))
    links = ends.groupBy("class_id").agg(F.sum("k").alias("n_links"))
    return members.join(links, "class_id", "left").select("id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def longest_prefix(paths: DataFrame, path: str, table: DataFrame) -> DataFrame:
    """path, prefix, surface of the longest prefix of a rules table (prefix, surface); ambiguous ones flagged.

    Beginnings of the paths join the prefixes, so the table may be of any size.
    """
    hits = paths.select(path).distinct().withColumn("prefix", F.explode(beginnings(F.col(path), table))).join(table, "prefix")
    w = Window.partitionBy(path)
    best = hits.withColumn("len", F.length("prefix")).withColumn("most", F.max("len").over(w)).where("len = most")
    return best.groupBy(path).agg(F.min("prefix").alias("prefix"), F.min("surface").alias("surface"), (F.count_distinct("surface") > 1).alias("ambiguous"))


def beginnings(path: Column, table: DataFrame) -> Column:
    """The beginnings of a path that are as long as some prefix of ``table``; there are as many lengths as a path has characters at most."""
    sizes = [r[0] for r in table.where("prefix is not null").select(F.length("prefix")).distinct().collect()]
    every = F.array(*[F.lit(n) for n in sorted(sizes)]).cast("array<int>")
    return F.transform(F.filter(every, lambda n: n <= F.length(path)), lambda n: F.left(path, n))


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side: shared, left_only or right_only, over distinct keys."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("r").isNull(), "left_only").when(F.col("l").isNull(), "right_only").otherwise("shared").alias("side"))


def graph_findings(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, problem) of edges with an unknown end or a blank contract."""
    ids = nodes.select(F.col("id"))
    lost = lambda end, name: edges.join(ids, edges[end] == ids["id"], "left_anti").select("source", "target", F.lit(name).alias("problem"))
    blank = edges.where(F.trim(F.coalesce("contract", F.lit(""))) == "").select("source", "target", F.lit("blank_contract").alias("problem"))
    return lost("source", "unknown_source").unionByName(lost("target", "unknown_target")).unionByName(blank)


def probe_findings(probes: DataFrame, materials: DataFrame, repositories: list[str]) -> DataFrame:
    """(probe, item, problem) of probes (probe, materials, targets) against a registry of materials (material, items).

    A probe needs materials and targets; each material must be in the registry
    with at least one item, and a target is ``<repository>#<number>``. Null lists
    are empty; an item is null where the whole list is meant.
    """
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    bare = lambda c, name: probes.where(size(F.col(c)) < 1).select("probe", F.lit(None).cast("string").alias("item"), F.lit(name).alias("problem"))
    known = materials.groupBy(F.col("material").alias("item")).agg(F.max(size(F.col("items"))).alias("n"))
    asked = probes.select("probe", F.explode(F.array_distinct("materials")).alias("item")).join(known, "item", "left")
    odd = F.when(F.col("n").isNull(), "unknown_material").when(F.col("n") < 1, "empty_material")
    aimed = probes.select("probe", F.explode("targets").alias("item")).distinct()
    repository, number = F.regexp_extract("item", "(?s)^(.*)#[^#]*$", 1), F.regexp_extract("item", "(?s)#([^#]*)$", 1)
    formed = F.coalesce(repository.isin(*repositories) & number.rlike("^[0-9]+$"), F.lit(False))
    lost = asked.select("probe", "item", odd.alias("problem")).where("problem is not null")
    wrong = aimed.where(~formed).select("probe", "item", F.lit("bad_target").alias("problem"))
    return bare("materials", "no_materials").unionByName(bare("targets", "no_targets")).unionByName(lost).unionByName(wrong)


def select_evidence(claims: DataFrame, keys: list[str], max_items: int, max_tokens: int) -> DataFrame:
    """Evidence within budget: repeats of a claim text dropped, then by source rank and relevance while items and tokens last."""
    once = claims.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "claim").orderBy("source_rank", F.desc("relevance"), "id"))).where("__n = 1").drop("__n")
    order = Window.partitionBy(*keys).orderBy("source_rank", F.desc("relevance"), "id")
    ranked = once.withColumn("place", F.row_number().over(order)).withColumn("used", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where((F.col("place") <= max_items) & (F.col("used") <= max_tokens))


def contradictions(claims: DataFrame, bucket: list[str], tolerance: float) -> DataFrame:
    """Buckets whose known values differ by more than the relative tolerance: bucket, n_claims, low, high, low_id, high_id.

    The extremes decide, so no pairs are made within a bucket.
    """
    known = claims.where(F.col("value").isNotNull())
    g = known.groupBy(*bucket).agg(F.count("*").alias("n_claims"), F.min("value").alias("low"), F.max("value").alias("high"), F.min(F.struct("value",
        "id")).alias("a"), F.max(F.struct("value", (-F.col("id")).alias("i"))).alias("b"))
    far = F.col("high") - F.col("low") > tolerance * F.greatest(F.abs("high"), F.abs("low"))
    return g.where(far).select(*bucket, "n_claims", "low", "high", F.col("a.id").alias("low_id"), (-F.col("b.i")).alias("high_id"))


def independence(rows: DataFrame, claim: str, content: Column, family: str, seen_at: str, now: Column, max_days: int) -> DataFrame:
    """Per claim: rows, independent families (copies of one text count as one family), and freshness; unknown times stay unknown."""
    own = rows.groupBy(claim, F.sha2(content, 256).alias("d")).agg(F.min(family).alias("f"), F.count("*").alias("n"), F.max(seen_at).alias("t"))
    fresh = F.when(F.max("t").isNull(), "unknown").when(F.timestamp_diff("DAY", F.max("t"), now) <= max_days, "fresh").otherwise("stale")
    return own.groupBy(claim).agg(F.sum("n").alias("n_rows"), F.count_distinct("f").alias("n_families"), fresh.alias("freshness"))


def lineage_findings(artifacts: DataFrame) -> DataFrame:
    """(id, problem): a parent that isn't there, or a digest that isn't the parent's, unless the mapping is marked lost."""
    p = artifacts.select(F.col("id").alias("parent_id"), F.col("digest").alias("real"))
    j = artifacts.where("parent_id is not null").join(p, "parent_id", "left")
    problem = F.when(F.col("real").isNull(), "missing_parent").when(F.col("real") != F.col("parent_digest"), F.when(F.col("span_map") == "MAPPING_LOST", "mapping_lost").otherwise("digest_mismatch"))
    return j.select("id", problem.alias("problem")).where("problem is not null")
