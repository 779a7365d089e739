"""Row contracts of record tables: what each kind of record must fulfil, as named rules.

A rule is a condition that a good row meets; ``check`` of the records module,
or ``quarantine`` of the evaluation module, turns rules into errors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.urls import safe_host
from brindle.operators.records import filled

# Enumerations and limits of the contracts.
EXECUTION_STATES = ("completed", "partial", "partial_or_failed", "failed", "cancelled", "unknown")
SENSITIVE_KEYS = ("password", "secret", "token", "private_key", "api_key", "authorization", "prompt")
VISIT_RESULTS = ("useful", "duplicate", "blocked", "irrelevant", "stale", "contradictory", "failed")
FEEDBACK_KINDS = ("correction", "evidence_correction", "preference", "task_success", "task_failure", "ui", "disagreement", "rating", "behavioral")
OUTCOMES = ("completed", "blocked", "retryable_failure", "permanent_failure", "invalid_input", "partial", "evidence_incomplete", "cancelled")
RETRYABLE = ("retryable_failure",)
PROGRAM_STATUS = ("completed", "partial", "blocked", "failed")
RESEARCH_TYPES = ("acquisition", "mapper", "chatbot", "search", "models", "agents", "architecture", "infrastructure", "performance", "alternatives", "evaluation")
RECORD_KEYS = ("schema", "program_id", "lane", "slot", "status", "research_type", "topic", "measurement", "findings")
MEASUREMENT_KEYS = (
    "allocated_agents", "completed_agents", "failed_agents", "wall_clock_seconds", "agent_seconds", "useful_findings", "unique_sources",
    "duplicate_rate", "answer_quality_0_to_10", "follow_up_questions",
)
FINDING_KEYS = ("claim", "source_url", "source_family", "acquisition_method", "evidence_status")
CREDENTIAL = r"(?i)(?:api[_-]?key|access[_-]?token|private[_-]?key|password|authorization)\s*[:=]\s*\S+"
STAGE_LIMITS = {"request_fingerprint": 128, "stage": 64, "input_fingerprint": 128, "output_fingerprint": 128, "method": 96, "provider": 64, "status": 32}
COMPARED = ("repository", "suite", "suite_version", "configuration_digest", "evidence_tier", "corpus_id", "corpus_version")
LANES, PROGRAMS = 3, 8
ARTIFACT_STATES = ("live_research_executed", "dry_run", "lane_failure", "blocked_before_execution")


def blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) == ""


def case_rules() -> dict[str, Column]:
    """An evaluation case: filled fields, a SHA-256 hex digest, invariants, the reference that its replay needs, an honest label."""
    says = lambda part: F.lower("category").contains(part)
    return filled("case_id", "corpus_id", "corpus_version", "category", "population", "source_family") | {
        "bad_digest": F.lower("input_digest").rlike("^[0-9a-f]{64}$"),
        "bad_invariants": (F.size("expected_invariants") > 0) & F.forall("expected_invariants", lambda x: F.trim(x) != ""),
        "missing_snapshot": (F.col("replay_mode") != "snapshot") | ~blank("snapshot_ref"),
        "missing_oracle": (F.col("replay_mode") != "live_source") | ~blank("oracle_ref"),
        "mislabelled_leakage": (F.col("leakage_class") != "clean") | ~(says("leakage") | says("contaminat")),
    }


def manifest_errors(cases: DataFrame, manifests: DataFrame, most: int) -> DataFrame:
    """corpus_id, errors of each manifest (corpus_id, corpus_version, approval_status, approval_ref) by the ``cases`` that name it.

    no_cases, too_many_cases (over ``most``), repeated_ids, other_version and
    missing_approval. Counts are aggregated first; no corpus is gathered.
    """
    by_id = cases.groupBy("corpus_id", "case_id").agg(F.count("*").alias("n"), F.min("corpus_version").alias("v0"), F.max("corpus_version").alias("v1"))
    by_corpus = by_id.groupBy("corpus_id").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.min("v0").alias("v0"), F.max("v1").alias("v1"))
    j = manifests.join(by_corpus, "corpus_id", "left")
    same = F.col("v0").eqNullSafe(F.col("corpus_version")) & F.col("v1").eqNullSafe(F.col("corpus_version"))
    found = [F.when(F.col("n").isNull(), "no_cases"), F.when(F.col("n") > most, "too_many_cases"), F.when(F.col("most") > 1, "repeated_ids"), F.when(F.col("n").isNotNull() & ~same, "other_version"),
             F.when((F.col("approval_status") != "unapproved") & blank("approval_ref"), "missing_approval")]
    return j.select("corpus_id", F.array_sort(F.array_compact(F.array(*found))).alias("errors"))


def dimension_rules() -> dict[str, Column]:
    """A scorecard's dimension: scores from 0 to 1, latency from 0 on, bounds not negative, a source."""
    late = F.col("dimension") == "latency"
    return filled("source") | {
        "out_of_range": F.col("value").isNull() | late | F.col("value").between(0, 1),
        "negative_latency": F.col("value").isNull() | ~late | (F.col("value") >= 0),
        "negative_baseline": F.col("baseline").isNull() | (F.col("baseline") >= 0),
        "negative_regression": F.col("max_regression").isNull() | (F.col("max_regression") >= 0),
    }


def repeated(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with column ``name``: whether another row has the same ``keys``; counted first, so hot keys aren't gathered."""
    n = rows.groupBy(*keys).agg((F.count("*") > 1).alias(name))
    return rows.join(n, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def stage_rules() -> dict[str, Column]:
    """A stage receipt: bounded non-blank texts, units and attempts, ISO timestamps with a zone, expiry after creation."""
    zone = r"(?:Z|[+-]\d{2}:?\d{2})$"
    stamp = lambda n: F.try_to_timestamp(F.col(n))
    rules = {f"blank:{n}": ~blank(n) for n in STAGE_LIMITS} | {f"too_long:{n}": F.length(n) <= m for n, m in STAGE_LIMITS.items()}
    for n in ("created_at", "expires_at"):
        rules[f"bad_time:{n}"] = F.col(n).isNull() | (stamp(n).isNotNull() & (F.length(n) <= 64))
    both = F.col("created_at").isNotNull() & F.col("expires_at").isNotNull()
    return rules | {
        "blank:parent": F.col("parent_receipt_fingerprint").isNull() | ~blank("parent_receipt_fingerprint"),
        "negative:resource_units": F.col("resource_units") >= 0,
        "bad_attempt": F.col("attempt") >= 1,
        "no_zone": ~both | (F.col("created_at").rlike(zone) & F.col("expires_at").rlike(zone)),
        "expired_at_once": ~both | F.coalesce(stamp("expires_at") > stamp("created_at"), F.lit(True)),
    }


def sensitive_keys(config: Column) -> Column:
    """Sorted key names anywhere in a JSON text that hold a sensitive word, in lower case with - as _."""
    keys = F.regexp_extract_all(F.coalesce(config, F.lit("")), F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1))
    named = F.transform(keys, lambda k: F.translate(F.lower(k), "-", "_"))
    return F.array_sort(F.array_distinct(F.filter(named, lambda k: reduce(lambda a, b: a | b, [k.contains(w) for w in SENSITIVE_KEYS]))))


def receipt_rules() -> dict[str, Column]:
    """A reproducibility receipt: filled fields, a known execution state, no blank workflow ids, no sensitive key in its configuration."""
    needed = ("repository", "revision", "artifact_id", "suite", "suite_version", "configuration_digest", "evidence_tier", "corpus_id", "corpus_version", "generated_at")
    optional = {f"blank:{n}": F.col(n).isNull() | ~blank(n) for n in ("workflow_id", "workflow_run_id")}
    return filled(*needed) | optional | {"unknown_state": F.col("execution_state").isin(*EXECUTION_STATES), "sensitive_key": F.size(sensitive_keys(F.col("configuration"))) == 0}


def compatibility(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """key, compatible, problems: fields of two receipts that must be equal and aren't, and a baseline that wasn't run to an end.

    A current receipt without a previous one has the problem no_baseline.
    """
    p = previous.select(key, F.struct(*COMPARED, "execution_state").alias("p"))
    j = current.join(p, key, "left")
    differ = [F.when(~F.col(n).eqNullSafe(F.col(f"p.{n}")), n) for n in COMPARED]
    states = [F.when(~F.coalesce(F.col("execution_state").isin(*EXECUTION_STATES), F.lit(False)), "current_state"),
              F.when(~F.coalesce(F.col("p.execution_state").isin("completed", "partial_or_failed"), F.lit(False)), "baseline_state")]
    problems = F.when(F.col("p").isNull(), F.array(F.lit("no_baseline"))).otherwise(F.array_compact(F.array(*differ, *states)))
    return j.select(key, problems.alias("problems")).select(key, (F.size("problems") == 0).alias("compatible"), "problems")


def record_rules(lane: int | None = None, schema: str | None = None) -> dict[str, Column]:
    """A publishable program record, given as JSON text ``record``: public keys only, known values, numbers as measures, no credential, public URLs.

    A text that is no JSON object breaks not_an_object, and all rules that need a field.
    """
    value = F.try_parse_json("record")
    kind = F.schema_of_variant(value)
    text = lambda path: F.try_variant_get(value, path, "string")
    number = lambda path: F.try_variant_get(value, path, "int")
    typed = lambda path: F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    keys = F.json_object_keys(F.to_json(value))
    allowed = lambda names: F.array(*[F.lit(n) for n in names])
    measures = F.try_variant_get(value, "$.measurement", "map<string,variant>")
    findings = F.try_variant_get(value, "$.findings", "array<map<string,string>>")
    secret = lambda c: c.rlike(CREDENTIAL) | (F.upper(c).contains("-----BEGIN ") & F.upper(c).contains("PRIVATE KEY-----"))
    safe = lambda c: c.isNull() | (~secret(c) & (F.length(F.trim(c)) <= 12000))
    host = lambda url: F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]+)", 1)), r"\.$", "")
    literal = lambda h: h.rlike(r"^\d+(\.\d+){3}$") | h.contains(":")
    local = lambda h: h.isin("localhost", "host.docker.internal") | (literal(h) & ~safe_host(h))
    public = lambda url: url.isNull() | ((host(url) != "") & ~local(host(url)))
    kinds = F.transform_values(measures, lambda k, v: F.schema_of_variant(v))
    numeric = F.forall(F.map_entries(kinds), lambda e: e["value"].rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$") | ((e["key"] == "answer_quality_0_to_10") & (e["value"] == "VOID")))
    inside = lambda rule: F.forall(findings, rule)
    version = {"other_schema": text("$.schema") == schema} if schema is not None else {}
    return version | {
        "not_an_object": kind.rlike("^OBJECT"),
        "private_fields": F.size(F.array_except(keys, allowed(RECORD_KEYS))) == 0,
        "blank:program_id": F.trim(text("$.program_id")) != "",
        "blank:topic": F.trim(text("$.topic")) != "",
        "bad_lane": typed("$.lane").eqNullSafe("BIGINT") & (number("$.lane").between(0, LANES - 1) if lane is None else number("$.lane") == lane),
        "bad_slot": typed("$.slot").eqNullSafe("BIGINT") & number("$.slot").between(0, PROGRAMS - 1),
        "unknown:status": text("$.status").isin(*PROGRAM_STATUS),
        "unknown:research_type": text("$.research_type").isin(*RESEARCH_TYPES),
        "private_measures": typed("$.measurement").rlike("^OBJECT") & (F.size(F.array_except(F.map_keys(measures), allowed(MEASUREMENT_KEYS))) == 0),
        "measure_not_a_number": numeric,
        "findings_not_a_list": typed("$.findings").rlike("^ARRAY"),
        "private_finding_fields": inside(lambda f: F.size(F.array_except(F.map_keys(f), allowed(FINDING_KEYS))) == 0),
        "blank:claim": inside(lambda f: F.coalesce(F.trim(f["claim"]) != "", F.lit(False))),
        "credential": safe(text("$.topic")) & safe(text("$.program_id")) & inside(lambda f: F.forall(F.map_values(f), safe)),
        "private_url": inside(lambda f: public(f["source_url"])),
    }


def visit_rules(lists: tuple[str, ...] = ("tasks", "visits", "findings", "next_tasks")) -> dict[str, Column]:
    """A research ledger's visit: a known result, and the ledger's lists there."""
    return {"unknown:result": F.col("result").isin(*VISIT_RESULTS)} | {f"missing:{n}": F.col(n).isNotNull() for n in lists}


def feedback_rules() -> dict[str, Column]:
    """A feedback row: known kind, no rating or one from 1 to 5, at most 64 receipts."""
    return {
        "unknown:kind": F.col("kind").isin(*FEEDBACK_KINDS),
        "bad_rating": F.col("rating").isNull() | (F.col("rating").between(1, 5) & (F.col("rating") == F.floor("rating"))),
        "too_many_receipts": F.coalesce(F.size("receipt_ids"), F.lit(0)) <= 64,
    }


def outcome_flags(value: Column) -> tuple[Column, Column, Column]:
    """(outcome or null where it is unknown, retryable, terminal)."""
    known = F.when(value.isin(*OUTCOMES), value)
    return known, F.coalesce(known.isin(*RETRYABLE), F.lit(False)), F.coalesce(~known.isin(*RETRYABLE), F.lit(False))


def contract_rules(contract: list[tuple[str, str, object]]) -> dict[str, Column]:
    """Rules of a contract table of (column, kind, value): required, const, enum, pattern, min, max. Only ``required`` refuses null."""
    out: dict[str, Column] = {}
    for name, kind, value in contract:
        c = F.col(name)
        met = {
            "required": lambda c, v: c.isNotNull(),
            "const": lambda c, v: c == v,
            "enum": lambda c, v: c.isin(*v),
            "pattern": lambda c, v: c.rlike(v),
            "min": lambda c, v: c >= v,
            "max": lambda c, v: c <= v,
        }[kind](c, value)
        out[f"{kind}:{name}"] = met if kind == "required" else c.isNull() | met
    return out


def contract_columns(rows: DataFrame, contract: list[tuple[str, str, object]]) -> dict[str, list[str]]:
    """Columns that the contract asks for and ``rows`` lacks, and those that it doesn't know."""
    named = {c for c, _, _ in contract}
    asked = {c for c, kind, _ in contract if kind == "required"}
    return {"missing": sorted(asked - set(rows.columns)), "extra": sorted(set(rows.columns) - named)}


def run_completeness(shards: DataFrame, lanes: int = LANES, programs: int = PROGRAMS) -> DataFrame:
    """run_id, aggregate, errors by the shard rows (run_id, lane, mode, revision, state, program_ids) of each run.

    Every lane from 0 on must be there, with one valid mode and one revision,
    known states and the programs of its slots; a run has a row for each lane,
    so its groups are small. aggregate is the worst state of the lanes.
    """
    slots = F.sequence(F.lit(0), F.lit(programs - 1))
    wanted = F.transform(slots, lambda s: F.concat(F.lit("lane"), F.col("lane").cast("string"), F.lit("-slot"), s.cast("string")))
    exact = (F.size("program_ids") == programs) & (F.size(F.array_except(wanted, F.coalesce("program_ids", F.array().cast("array<string>")))) == 0)
    state = F.col("state")
    ran = state.isin("live_research_executed", "dry_run")
    known = F.coalesce(state.isin(*ARTIFACT_STATES), F.lit(False))
    g = shards.groupBy("run_id").agg(
        F.count_distinct(F.when(F.col("lane").between(0, lanes - 1), F.col("lane"))).alias("n_lanes"),
        F.count_distinct(F.coalesce("mode", F.lit(""))).alias("n_modes"),
        F.bool_and(F.coalesce(F.col("mode").isin("live", "dry-run"), F.lit(False))).alias("modes"),
        F.count_distinct(F.coalesce("revision", F.lit(""))).alias("n_revisions"),
        F.bool_and(~blank("revision")).alias("revisions"),
        F.bool_and(known).alias("states"),
        F.bool_and(~ran | F.coalesce(exact, F.lit(False))).alias("programs"),
        F.bool_or(F.col("mode").eqNullSafe("live") & state.eqNullSafe("dry_run")).alias("dry_live"),
        F.bool_or(state.eqNullSafe("lane_failure")).alias("failed"),
        F.bool_or(state.eqNullSafe("blocked_before_execution")).alias("blocked"),
        F.bool_and(state.eqNullSafe("dry_run")).alias("dry"),
        F.bool_and(state.eqNullSafe("live_research_executed")).alias("live"),
    )
    aggregate = F.when(F.col("failed"), "lane_specific_failure").when(F.col("blocked"), "blocked_before_execution").when(F.col("dry"),
        "dry_run").when(F.col("live"), "live_research_executed").otherwise("partial_or_mixed")
    broken = {
        "missing_lane": F.col("n_lanes") < lanes, "mixed_mode": (F.col("n_modes") > 1) | ~F.col("modes"), "mixed_revision": (F.col("n_revisions") > 1) | ~F.col("revisions"),
        "unknown_state": ~F.col("states"), "wrong_programs": ~F.col("programs"), "dry_run_in_live": F.col("dry_live"),
    }
    return g.select("run_id", aggregate.alias("aggregate"), F.array_sort(F.array_compact(F.array(*[F.when(c, n) for n, c in broken.items()]))).alias("errors"))


def source_counts(jobs: DataFrame, sources: list[str], expected: DataFrame, job: str, digest: str) -> DataFrame:
    """One row: successful jobs of each source, jobs that are missing or have no successful source, distinct lineage digests."""
    ok = [F.coalesce(F.col(s) == 200, F.lit(False)) for s in sources]
    found = jobs.agg(
        *[F.count_if(c).alias(f"ok_{s}") for c, s in zip(ok, sources, strict=True)],
        F.count_if(~reduce(lambda a, b: a | b, ok)).alias("jobs_without_source"),
        F.count_distinct(digest).alias("lineage_digests"),
        F.count_if(F.col(digest).isNull()).alias("jobs_without_lineage"),
    )
    missing = expected.select(job).distinct().join(jobs.select(job).distinct(), job, "left_anti").agg(F.count("*").alias("missing_jobs"))
    both = found.unionByName(missing, allowMissingColumns=True)  # one row each
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
