"""Receipt chains, revisits, lifecycle states, framed events, retention plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.catalog import first_seen

# Reasons that allow a second visit.
FORCE_REASONS = ("freshness_expired", "previous_failure_retry", "contradiction_check", "new_revision_or_region", "material_question_change", "high_churn_source")
# Raw state -> shown state.
STATE_NAMES = {
    "new": "NEW_CHAT", "new_chat": "NEW_CHAT", "submitting": "SUBMITTING", "submitted": "QUEUED", "queued": "QUEUED",
    "running": "RUNNING", "streaming": "STREAMING", "complete": "COMPLETE", "completed": "COMPLETE", "success": "COMPLETE",
    "succeeded": "COMPLETE", "partial": "PARTIAL", "cancelled": "CANCELLED", "failed": "FAILED", "blocked": "BLOCKED",
    "rejected": "REJECTED", "unavailable": "UNAVAILABLE", "unknown": "UNKNOWN", "reconnecting": "RECONNECTING",
    "resumed": "RESUMED", "replayed": "REPLAYED", "auth_expired": "AUTH_EXPIRED", "unauthorized": "AUTH_EXPIRED",
    "forbidden": "AUTH_EXPIRED", "paused": "RECONNECTING",
}
# States that may follow each state.
NEXT_STATES = {
    "CANCELLED": ["REPLAYED", "NEW_CHAT"],
    "FAILED": ["REPLAYED", "NEW_CHAT"],
    "NEW_CHAT": ["SUBMITTING", "QUEUED"],
    "SUBMITTING": [
        "QUEUED", "RUNNING", "STREAMING", "COMPLETE", "PARTIAL", "CANCELLED",
        "FAILED", "BLOCKED", "REJECTED", "UNAVAILABLE", "UNKNOWN", "AUTH_EXPIRED",
    ],
    "QUEUED": [
        "RUNNING", "STREAMING", "COMPLETE", "PARTIAL", "CANCELLED", "FAILED",
        "BLOCKED", "REJECTED", "UNAVAILABLE", "UNKNOWN", "RECONNECTING", "AUTH_EXPIRED",
    ],
    "RUNNING": [
        "STREAMING", "COMPLETE", "PARTIAL", "CANCELLED", "FAILED", "BLOCKED",
        "REJECTED", "UNAVAILABLE", "UNKNOWN", "RECONNECTING", "AUTH_EXPIRED",
    ],
    "STREAMING": ["COMPLETE", "PARTIAL", "CANCELLED", "FAILED", "BLOCKED", "REJECTED", "UNAVAILABLE", "UNKNOWN", "RECONNECTING", "AUTH_EXPIRED"],
    "COMPLETE": ["REPLAYED", "NEW_CHAT"],
    "PARTIAL": ["RECONNECTING", "RESUMED", "REPLAYED", "COMPLETE", "UNKNOWN", "UNAVAILABLE"],
    "BLOCKED": ["RECONNECTING", "RESUMED", "NEW_CHAT"],
    "REJECTED": ["SUBMITTING", "NEW_CHAT"],
    "UNAVAILABLE": ["RECONNECTING", "RESUMED", "NEW_CHAT", "UNKNOWN"],
    "UNKNOWN": [
        "RECONNECTING", "RESUMED", "REPLAYED", "RUNNING", "STREAMING", "COMPLETE",
        "PARTIAL", "BLOCKED", "REJECTED", "UNAVAILABLE", "AUTH_EXPIRED",
    ],
    "RECONNECTING": ["RESUMED", "REPLAYED", "RUNNING", "STREAMING", "COMPLETE", "PARTIAL", "UNAVAILABLE", "UNKNOWN", "AUTH_EXPIRED"],
    "RESUMED": ["RUNNING", "STREAMING", "COMPLETE", "PARTIAL", "UNKNOWN", "RECONNECTING"],
    "REPLAYED": ["RUNNING", "STREAMING", "COMPLETE", "PARTIAL", "UNKNOWN", "RECONNECTING"],
    "AUTH_EXPIRED": ["SUBMITTING", "RECONNECTING", "NEW_CHAT"],
}
#: A state may always follow itself.
ALLOWED = {(a, b) for a, after in NEXT_STATES.items() for b in (a, *after)}


def shown_state(raw: Column) -> Column:
    """The shown state of a raw one, null if there is none."""
    key = F.regexp_replace(F.lower(F.trim(raw)), r"[-\s]+", "_")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in STATE_NAMES.items() for x in kv]), key)


def backend_state(body: Column) -> Column:
    """The shown state of a backend's JSON answer: the first that is there of ui_state, state and status, then of those of run; UNKNOWN where none is known."""
    value = F.try_parse_json(body)
    names = ("ui_state", "state", "status")
    first = F.coalesce(*[F.try_variant_get(value, f"$.{outer}{n}", "string") for outer in ("", "run.") for n in names])
    return F.coalesce(shown_state(first), F.lit("UNKNOWN"))


def advance(current: Column, state: Column) -> Column:
    """State after ``state`` arrives in ``current`` (null: none yet); UNKNOWN if it may not."""
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, b in sorted(ALLOWED)])
    legal = F.array_contains(pairs, F.concat(current, F.lit(">"), state))
    return F.when(state.isNull(), "UNKNOWN").when(current.isNull(), state).otherwise(F.when(legal, state).otherwise("UNKNOWN"))


def fold_lifecycle(events: DataFrame, key: str, order: list[str], raw: str) -> DataFrame:
    """key, state after all events in order, n_events. A refused event leaves UNKNOWN, from which later ones are judged.

    The fold composes: each event is a function of the state, a small array of
    state numbers that depends on the raw state only. Functions of pieces are
    combined in order, so a key's events needn't be gathered in one row. The
    number of levels follows from the largest key, which is counted first.
    """
    states = ["", *sorted(NEXT_STATES)]
    unknown = states.index("UNKNOWN") + 1

    def after(shown: str) -> Column:
        """Number of the state after ``shown`` arrives in each state; the first stands for none yet."""
        return F.array(*[F.lit(states.index(shown) + 1 if not s or (s, shown) in ALLOWED else unknown).cast("tinyint") for s in states])

    table = F.create_map(*[x for s in states[1:] for x in (F.lit(s), after(s))])
    step = F.coalesce(F.try_element_at(table, shown_state(F.col(raw))), F.array_repeat(F.lit(unknown).cast("tinyint"), len(states)))
    piece = 64
    most = events.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    numbered = events.withColumn("__i", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).select(key, "__i", step.alias("f"), F.lit(1).cast("long").alias("n"))
    while True:  # 64 events or pieces become one piece
        grouped = numbered.groupBy(key, F.floor(F.col("__i") / piece).alias("__i")).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i",
            "f"))), lambda x: x["f"]).alias("fs"), F.sum("n").alias("n"))
        whole = F.aggregate(F.slice("fs", 2, piece), F.element_at("fs", 1), lambda acc, f: F.transform(acc, lambda s: F.element_at(f, s.cast("int"))))
        numbered = grouped.select(key, "__i", whole.alias("f"), "n")
        most = -(-most // piece)
        if most == 1:
            break
    names = F.array(*[F.lit(s) for s in states])
    return numbered.select(key, F.element_at(names, F.element_at("f", 1).cast("int")).alias("state"), F.col("n").alias("n_events"))


def validate_chain(receipts: DataFrame, key: str, seq: str, max_units: int | None = None) -> DataFrame:
    """key, n_receipts, linked (each names the one before), units, within (units never over the bound)."""
    by = Window.partitionBy(key).orderBy(seq)
    prior = F.lag("fingerprint").over(by)
    r = receipts.withColumn("ok", prior.isNull() | F.col("parent_fingerprint").eqNullSafe(prior)).withColumn("running", F.sum("units").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    bound = F.lit(True) if max_units is None else F.max("running") <= max_units
    return r.groupBy(key).agg(F.count("*").alias("n_receipts"), F.bool_and("ok").alias("linked"), F.sum("units").alias("units"), bound.alias("within"))


def visit_key(task: Column, url: Column) -> Column:
    return F.sha2(F.concat(task, F.lit("\n"), url), 256)


def revisit_gate(proposed: DataFrame, ledger: DataFrame) -> DataFrame:
    """proposed (task_id, url, force_reason, ...) with allowed and reason; the ledger's last row of a key counts."""
    known = ledger.select(visit_key(F.col("task_id"), F.col("url")).alias("visit_key")).distinct().withColumn("seen", F.lit(True))
    p = proposed.withColumn("visit_key", visit_key(F.col("task_id"), F.col("url"))).join(known, "visit_key", "left")
    forced = F.coalesce(F.col("force_reason").isin(*FORCE_REASONS), F.lit(False))
    return p.withColumn("allowed", F.col("seen").isNull() | forced).withColumn("reason", F.when(F.col("seen").isNull(), "new_source").when(forced,
        F.col("force_reason")).otherwise("already_visited_for_task")).drop("seen")


def resume_eligible(receipts: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """requests (request, input) with eligible: a completed, unexpired, resumable receipt of the same fingerprints exists."""
    good = receipts.where("resume_eligible and status = 'completed'").where(F.col("expires_at").isNull() | (now < F.col("expires_at"))).select("request", "input").distinct().withColumn("eligible", F.lit(True))
    return requests.join(good, ["request", "input"], "left").withColumn("eligible", F.coalesce("eligible", F.lit(False)))


def deletion_plan(versions: DataFrame, keep: DataFrame, prefix: str) -> DataFrame:
    """Versions (key, version_id, is_latest) to delete: all below ``prefix`` but the latest of kept keys."""
    v = versions.where(F.col("key").startswith(prefix) & (F.col("version_id") != ""))
    v = v.join(keep.select("key").distinct().withColumn("kept", F.lit(True)), "key", "left")
    return v.where(~F.coalesce(F.col("kept") & F.col("is_latest"), F.lit(False))).select("key", "version_id")


def retirement_plan(refs: DataFrame, now: Column, min_age_days: int) -> DataFrame:
    """name, action and reason of each ref: keep the group's keeper, protected, used and young ones; retire merged or identical ones."""
    order = [F.when(F.col("is_default"), 0).when(F.col("has_open_pr"), 1).when(F.col("is_protected"), 2).otherwise(3), F.length("name"), F.col("name")]
    r = refs.withColumn("n", F.row_number().over(Window.partitionBy("sha").orderBy(*order))).withColumn("keeper", F.first("name").over(Window.partitionBy("sha").orderBy(*order)))
    young = F.timestamp_diff("DAY", F.col("committed_at"), now) < min_age_days
    reason = F.when(F.col("is_protected"), "protected").when(F.col("has_open_pr"), "open_pr").when(F.col("n") == 1,
        F.when(F.col("is_ancestor") & ~F.col("is_default") & ~young, "merged").otherwise("keeper")).when(young,
        "too_young").otherwise("duplicate_tip")
    return r.select("name", "sha", "keeper", reason.alias("reason"), F.when(reason.isin("merged", "duplicate_tip"), "retire").otherwise("keep").alias("action"))


def frame_events(results: DataFrame, chunk: int = 256, max_bytes: int = 1 << 20) -> DataFrame:
    """Event rows (response_id, seq, event, text, status, digest) of response texts.

    start, then deltas of at most ``chunk`` characters, usage if tokens are
    known, and done with the text's digest. Blocked results, blank ids, unknown
    states and texts whose frames exceed ``max_bytes`` give no rows.
    Characters are code points here.
    """
    status = F.create_map(*[F.lit(x) for kv in {"COMPLETE": "completed", "PARTIAL": "partial", "CANCELLED": "cancelled", "FAILED": "failed", "ERROR": "failed"}.items() for x in kv])
    r = results.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("response_id", F.trim("response_id")).withColumn("end", F.try_element_at(status, F.upper("result_state")))
    r = r.where((F.col("response_id") != "") & F.col("end").isNotNull() & (F.octet_length("text") <= max_bytes))
    row = lambda event, text=None, state=None, digest=None: F.struct(F.lit(event).alias("event"), (text if text is not None else F.lit(None).cast("string")).alias("text"), (state if state is not None else F.lit(None).cast("string")).alias("status"), (digest if digest is not None else F.lit(None).cast("string")).alias("digest"))
    n = F.ceil(F.length("text") / chunk).cast("int")
    deltas = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: row("delta", F.substring(F.col("text"), i * chunk + 1,
        F.lit(chunk))))).otherwise(F.slice(F.array(row("delta", F.col("text"))), 1, 0))
    usage = F.filter(F.array(row("usage", F.concat_ws("/", F.col("input_tokens").cast("string"), F.col("output_tokens").cast("string")))),
        lambda x: F.col("input_tokens").isNotNull()) if "input_tokens" in results.columns else None
    parts = [F.array(row("start", None, F.lit("streaming"))), deltas, *([usage] if usage is not None else []), F.array(row("done", None, F.col("end"), F.sha2("text", 256)))]
    return r.select("response_id", F.posexplode(F.concat(*parts)).alias("seq", "e")).select("response_id", "seq", "e.*")


def reassemble(frames: DataFrame) -> DataFrame:
    """response_id, text, status and whether the digest of the reassembled text is the one that done names."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("event") == "delta", F.struct("seq", "text")))), lambda x: x["text"]), "")
    out = frames.groupBy("response_id").agg(text.alias("text"), F.max(F.when(F.col("event") == "done", F.col("status"))).alias("status"),
        F.max(F.when(F.col("event") == "done", F.col("digest"))).alias("digest"))
    return out.select("response_id", "text", "status", F.coalesce(F.sha2("text", 256) == F.col("digest"), F.lit(False)).alias("intact"))


def compact_messages(turns: DataFrame, limit: int = 11800) -> DataFrame:
    """conv_id, prompt: system texts first, then ``role: text`` in turn order, cut to ``limit`` characters.

    Only the turns that reach into the limit are gathered, whatever a conversation's length.
    """
    rank = F.when(F.lower(F.trim("role")) == "system", 0).otherwise(1)
    t = turns.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("rank", rank)
    line = F.when(F.col("rank") == 0, F.trim("text")).otherwise(F.concat(F.coalesce(F.nullif(F.lower(F.trim("role")), F.lit("")), F.lit("user")), F.lit(": "), F.trim("text")))
    t = t.withColumn("line", F.left(line, F.lit(limit)))
    before = F.coalesce(F.sum(F.length("line") + 2).over(Window.partitionBy("conv_id").orderBy("rank", "turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = t.withColumn("before", before).where((F.col("before") < limit) | (F.col("rank") == 1) & (F.col("before") < limit))
    parts = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") == k, F.struct("turn", "line")))), lambda x: x["line"]), "\n\n")
    g = near.groupBy("conv_id").agg(parts(0).alias("s"), parts(1).alias("c"))
    head = F.when(F.col("s") != "", F.concat(F.lit("Research execution instructions:\n"), "s", F.lit("\n\n"))).otherwise("")
    return g.select("conv_id", F.left(F.trim(F.concat(head, F.lit("Research request:\n"), "c")), F.lit(limit)).alias("prompt"))


def latest_ledger_rows(ledger: DataFrame) -> DataFrame:
    """The last row of each (task_id, url) by seq."""
    return first_seen(ledger, ["task_id", "url"], ["seq"], last=True)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Findings of several scanners in one table; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
