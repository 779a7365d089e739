"""Evidence tiers and the claims they allow, observation contracts, source families, and loosely shaped JSON values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.operators.records import filled
from brindle.operators.tiers import rank

# The evidence tier that each class of claims needs.
CLAIMS = {
    "deterministic_contract": "deterministic_contract", "contract_coverage": "deterministic_contract", "benchmark_regression": "deterministic_contract",
    "simulated_provider": "simulated_provider", "mocked_provider": "simulated_provider",
    "live_source_acquisition": "live_source_acquisition", "source_retrieval": "live_source_acquisition", "transport": "live_source_acquisition",
    "live_provider": "live_provider", "provider_availability": "live_provider", "provider_latency": "live_provider", "provider_fallback": "live_provider",
    "integration_runtime": "integration_runtime", "end_to_end_runtime": "integration_runtime",
    "production": "production", "production_readiness": "production", "production_capability": "production",
}
# Roles, lanes and counters of an observed run.
ROLES = ("main", "explorer", "worker", "researcher", "advisor")
LANES = ("A", "B", "C", "D", "E", "F")
ENVELOPE = ("run_id", "provider", "model", "task_id", "fixture_version", "repository_revision", "tool_policy_version", "evidence_tier")
COUNTERS = (
    "input_tokens", "output_tokens", "cached_tokens", "thinking_tokens", "tool_calls", "useful_tool_calls", "relevant_sources", "sources_used", "files_read",
    "duplicate_actions", "irrelevant_actions", "compaction_events", "context_peak_tokens", "required_claims", "supported_claims", "correct_claims",
    "missed_requirements", "unsupported_claims", "self_corrections", "successful_actions",
)
# Sources and the family that each belongs to.
SOURCE_ALIASES = {
    "bilibili": "chinese_communities", "zhihu": "chinese_communities", "baidu_tieba": "chinese_communities", "douban": "chinese_communities", "ptt": "chinese_communities",
    "social_communities": "social_communities", "regional_communities": "social_communities", "social_media": "social_media",
    "x_twitter": "social_media", "instagram": "social_media", "facebook": "social_media", "tiktok": "social_media", "meta_ai": "social_media",
    "search_trends": "search_trends", "retailers": "retailers", "professional_reviews": "professional_reviews", "price_stock": "price_stock",
    "oem": "oem", "amazon": "amazon", "flipkart": "flipkart", "reddit": "reddit", "youtube": "youtube",
    "project_docs": "github", "github_issues": "github", "github_actions": "github", "operations": "github",
}


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def allows(tier: Column, claim: Column) -> Column:
    """Whether a tier may support a class of claims; null where either is unknown."""
    needed = F.try_element_at(literal_map(CLAIMS), F.translate(F.lower(F.trim(claim)), "-", "_"))
    return rank(tier) >= rank(needed)


def envelope_rules(schema: str) -> dict[str, Column]:
    """An observation's envelope: its schema, known role and lane, filled texts, and an observation, a JSON object."""
    return filled(*ENVELOPE) | {
        "unknown:schema": F.col("schema") == schema,
        "unknown:agent_role": F.col("agent_role").isin(*ROLES),
        "unknown:lane": F.col("lane").isin(*LANES),
        "not_an_object:observation": F.schema_of_variant(F.try_parse_json("observation")).rlike("^OBJECT"),
    }


def counter_rules() -> dict[str, Column]:
    """An observed run: filled identity, counters that aren't negative."""
    return filled("run_id", "provider", "model", "task_id") | {f"negative:{n}": F.col(n) >= 0 for n in COUNTERS}


def source_families(sources: Column) -> Column:
    """Sorted families of an array of sources, each once; a source without a family stands for itself."""
    named = F.transform(sources, lambda s: F.coalesce(F.try_element_at(literal_map(SOURCE_ALIASES), s), s))
    return F.array_sort(F.array_distinct(F.filter(named, lambda s: s.isNotNull())))


def _text(value: Column) -> Column:
    """A variant as text: strings as they are, all else as JSON; null and empty texts are null."""
    plain = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))
    return F.nullif(F.when(F.schema_of_variant(value) != "VOID", plain), F.lit(""))


def _first(value: Column, *fields: str) -> Column:
    return F.coalesce(*[_text(F.try_variant_get(value, f"$.{f}", "variant")) for f in fields])


def spec_map(value: Column) -> Column:
    """Specifications in JSON, an object or a list, as a map of texts; a later entry of a key replaces an earlier one.

    Of an object each value counts, of a nested object its value, text or
    displayValue, else it whole. Of a list, objects give their key, name or
    label, and lists their first two items. Other shapes give an empty map.
    """
    v = F.try_parse_json(value)
    kind = F.schema_of_variant(v)
    of = lambda x: F.when(F.schema_of_variant(x).rlike("^OBJECT"), F.coalesce(_first(x, "value", "text", "displayValue"), F.to_json(x))).otherwise(_text(x))
    entry = lambda k, x: F.struct(k.alias("k"), x.alias("v"))
    fields = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: entry(e["key"], of(e["value"])))
    item = lambda x, i: _text(F.try_variant_get(x, f"$[{i}]", "variant"))
    listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.when(F.schema_of_variant(x).rlike("^ARRAY"), entry(item(x, 0),
        item(x, 1))).otherwise(entry(_first(x, "key", "name", "label"), _first(x, "value", "text", "displayValue"))))
    entries = F.filter(F.when(kind.rlike("^OBJECT"), fields).when(kind.rlike("^ARRAY"), listed), lambda e: e["k"].isNotNull() & e["v"].isNotNull())
    nothing = F.create_map().cast("map<string,string>")
    put = lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"]))
    return F.coalesce(F.aggregate(entries, nothing, put), nothing)


def image_urls(value: Column) -> Column:
    """Image addresses in JSON: a text, an object with url, src or contentUrl, or a list of these."""
    v = F.try_parse_json(value)
    kind = F.schema_of_variant(v)
    one = lambda x: F.when(F.schema_of_variant(x).rlike("^OBJECT"), _first(x, "url", "src", "contentUrl")).otherwise(F.nullif(F.trim(_text(x)), F.lit("")))
    several = F.transform(F.try_variant_get(v, "$", "array<variant>"), one)
    found = F.when(kind.rlike("^ARRAY"), several).when(kind.rlike("^OBJECT") | (kind == "STRING"), F.array(one(v)))
    return F.coalesce(F.filter(found, lambda x: x.isNotNull()), F.array().cast("array<string>"))
