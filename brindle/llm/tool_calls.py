"""Tool-call linking for chat data, in DataFrame functions only.

Calls and results meet in a hash join on their identifiers. Calls are ordered
topologically by the calls they wait for, arguments are checked against the
tools' schemas, and every linked call becomes one line of canonical JSON:
keys sorted, no spaces, the same text for the same content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import drop_dir, work_dir, written

#: Schema types and the names that Spark gives such variant values.
TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "number": "BIGINT|DOUBLE|DECIMAL.*", "object": "OBJECT.*", "array": "ARRAY.*"}

#: By tool: argument -> (type, required). Further arguments are errors.
Schemas = dict[str, dict[str, tuple[str, bool]]]


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted array of what is wrong with a call's arguments; empty if nothing is."""
    value = F.try_parse_json(arguments)
    shape = F.schema_of_variant(value)
    found: list[Column] = [F.when(value.isNull(), "bad_json"), F.when(value.isNotNull() & ~shape.rlike("^OBJECT"), "not_an_object")]
    known = F.lit(False)
    is_object = shape.rlike("^OBJECT")
    keys = F.json_object_keys(F.to_json(value))
    for tool, fields in sorted(schemas.items()):
        mine = name.eqNullSafe(tool)
        known = known | mine
        for field, (kind, required) in sorted(fields.items()):
            part = F.schema_of_variant(F.try_variant_get(value, f"$['{field}']", "variant"))
            absent = part.isNull() | (part == "VOID")
            if required:
                found.append(F.when(mine & is_object & absent, f"missing:{field}"))
            found.append(F.when(mine & is_object & ~absent & ~part.rlike(f"^({TYPES[kind]})$"), f"type:{field}"))
        extra = F.array_except(keys, F.array(*[F.lit(f) for f in sorted(fields)]))
        found.append(F.when(mine & is_object & (F.size(extra) > 0), F.concat(F.lit("extra:"), F.array_join(F.array_sort(extra), ","))))
    found.append(F.when(~known, "unknown_tool"))
    return F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull()))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 for calls that wait for none, else one more than the deepest they wait for.

    ``calls`` has ``after``, an array of call ids of the same conversation; ids
    that no call has don't count. Calls that wait for one other first skip to
    the call that begins their chain, in steps that double each round. What is
    left, chains' beginnings that wait for several calls, is settled round by
    round once all of those are. Calls on a cycle, or behind one, stay out.
    """
    base, key = work_dir(calls.sparkSession), ["conv_id", "call_id"]
    nodes = calls.select(*key).distinct()
    edges = calls.select(*key, F.explode("after").alias("before_id")).distinct()
    edges = written(edges.join(nodes.select("conv_id", F.col("call_id").alias("before_id")), ["conv_id", "before_id"], "left_semi"), f"{base}/edges")
    waits = nodes.join(edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("before_id").alias("p")), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    one = F.col("n") == 1
    steps = waits.select(*key, "n", F.when(one, F.col("p")).otherwise(F.col("call_id")).alias("top"), one.cast("long").alias("dist"), (~one).alias("done"))
    steps, turn = written(steps, f"{base}/steps-0"), 0
    open_ = steps.where(~F.col("done")).count()
    while open_:
        turn += 1
        up = steps.select("conv_id", F.col("call_id").alias("top"), F.col("top").alias("top2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"))
        longer = steps.where(~F.col("done")).join(up, ["conv_id", "top"]).select(*key, "n", F.col("top2").alias("top"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("done2").alias("done"))
        steps = written(steps.where("done").unionByName(longer), f"{base}/steps-{turn}")
        drop_dir(calls.sparkSession, f"{base}/steps-{turn - 1}")
        left = steps.where(~F.col("done")).count()
        if left == open_:  # each round settles the calls of twice the depth; what none settles hangs on a cycle
            break
        open_ = left
    tops = steps.where("done")
    settled = written(tops.where("n = 0").select(*key, F.lit(0).cast("long").alias("level")), f"{base}/level-0")
    joins = edges.join(tops.where("n > 1").select(*key), key, "left_semi").join(tops.select("conv_id", F.col("call_id").alias("before_id"), "top", "dist"), ["conv_id", "before_id"], "left")
    joins, turn = written(joins.select(*key, "top", (F.col("dist") + 1).alias("dist")), f"{base}/joins"), 0
    # all levels so far are one read of their folders, so the plan doesn't grow with the rounds
    done = lambda: calls.sparkSession.read.schema(settled.schema).parquet(*[f"{base}/level-{i}" for i in range(turn + 1)])
    waiting = not joins.isEmpty()
    while waiting:
        known = done()
        deep = joins.join(known.select("conv_id", F.col("call_id").alias("top"), "level"), ["conv_id", "top"], "left").join(known.select(*key), key, "left_anti")
        ready = deep.groupBy(*key).agg(F.max(F.col("level") + F.col("dist")).alias("level"), F.bool_and(F.col("level").isNotNull()).alias("all")).where("all").drop("all")
        waiting = not written(ready.select(*settled.columns), f"{base}/level-{turn + 1}").isEmpty()
        turn += 1
    known = done().select("conv_id", F.col("call_id").alias("top"), "level")
    return tops.join(known, ["conv_id", "top"]).select(*key, (F.col("level") + F.col("dist")).cast("int").alias("level"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row a call, and one for each result whose call is missing, in topological order.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), after (array
    of call ids). ``results``: conv_id, turn, call_id, content. Out come
    conv_id, call_id, kind (linked, no_result or no_call), level, turn,
    result_turn, n_results, errors and json.

    A call takes the result with the smallest turn; n_results counts them all.
    Calls that repeat a (conv_id, call_id) count by the row with the smallest
    turn, the others are dropped as repeats. Null ids link with nothing: each
    such call is a row without result and level, each such result one without
    call. Of several results of one turn the smallest content is taken, of
    several calls the smallest name and arguments. Unparsable or null arguments
    are written as null with the error bad_json. level is null on a cycle.
    Arguments and contents are taken whole, however long; a call that waits for
    very many others is one row of their ids, and each of them one edge.
    Rows come sorted by conversation, level, turn and id; a conversation of
    any size is spread over the sort's ranges, never gathered. Empty tables
    give no rows; other columns are not read.
    """
    key = ["conv_id", "call_id"]
    lone = F.col("conv_id").isNull() | F.col("call_id").isNull()
    lone_calls, lone_results = calls.where(lone), results.where(lone)
    calls, results = calls.where(~lone), results.where(~lone)
    first = calls.groupBy(*key).agg(F.min_by(F.struct("turn", "name", "arguments", "after"), F.struct("turn", "name", "arguments")).alias("call")).select(*key, "call.*")
    answer = results.groupBy(*key).agg(F.min_by(F.struct("turn", "content"), F.struct("turn", "content")).alias("answer"), F.count("*").alias("n_results"))
    both = first.join(answer, key, "full_outer")
    is_call = F.col("name").isNotNull() | F.col("turn").isNotNull() | F.col("arguments").isNotNull()
    both = both.withColumn("kind", F.when(~is_call, "no_call").when(F.col("answer").isNull(), "no_result").otherwise("linked"))
    both = both.join(levels(calls), key, "left").drop("after")
    more = lone_calls.select(*key, "turn", "name", "arguments", F.lit("no_result").alias("kind"))
    gone = lone_results.select(*key, F.struct("turn", "content").alias("answer"), F.lit(1).cast("long").alias("n_results"), F.lit("no_call").alias("kind"))
    both = both.unionByName(more, allowMissingColumns=True).unionByName(gone, allowMissingColumns=True)
    is_call = F.col("kind") != "no_call"
    errors = F.when(is_call, argument_errors(F.col("name"), F.col("arguments"), schemas)).otherwise(F.array().cast("array<string>"))
    both = both.withColumn("errors", errors)
    # fields in the order of their names; null ones are left out
    line = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("conv_id").alias("conversation"), F.when(F.size("errors") > 0,
        F.col("errors")).alias("errors"), F.col("call_id").alias("id"), "name", F.col("answer.content").alias("result")))
    out = both.select(*key, "kind", "level", F.coalesce("turn", "answer.turn").alias("turn"), F.col("answer.turn").alias("result_turn"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), "errors", line.alias("json"))
    return out.orderBy("conv_id", "level", "turn", "call_id")


#: Tools of the calls that ``calls_of`` derives.
CHAT_TOOLS: Schemas = {
    "search": {"query": ("string", True), "limit": ("integer", True)},
    "translate": {"text": ("string", True), "target": ("string", True), "formal": ("boolean", False)},
}


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of plain chat rows (conv_id, turn, role, text).

    Each user turn is a call: even ones search for the text, odd ones translate
    it. The reply to a call is the assistant's turn after it. Of each eight turns
    the later calls wait for the call before them, the last ones also for the
    two before that; in every ninth conversation the second call waits for the
    third too, so that they and what follows are on a ring. Some calls are made
    faulty on purpose, by the length of their text.
    """
    n = F.coalesce(F.length("text"), F.lit(0))
    id_at = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    user = conversations.where("role = 'user' and conv_id is not null and turn is not null")
    search = F.to_json(F.struct(F.col("text").alias("query"), F.when(n % 7 != 0, F.col("turn")).alias("limit"), F.when(n % 11 == 0, F.lit(1)).alias("page")))
    translate = F.to_json(F.struct(F.col("text").alias("text"), F.lit("en").alias("target"), F.when(n % 5 == 0, F.lit("yes")).alias("formal")))
    calls = user.select("conv_id", "turn", id_at(F.col("turn")).alias("call_id"), F.when(F.col("turn") % 2 == 0,
        "search").otherwise("translate").alias("name"), F.when(F.col("turn") % 2 == 0, search).otherwise(translate).alias("arguments"),
        F.array_compact(F.array(*[F.when(F.col("turn") % 8 >= least, id_at(F.col("turn") - back)) for back, least in ((2, 2), (4, 6), (6, 6))], F.when((F.col("conv_id") % 9 == 4) & (F.col("turn") == 2), id_at(F.lit(4))))).alias("after"))
    results = conversations.where("role = 'assistant' and conv_id is not null and turn is not null").select("conv_id", "turn",
        id_at(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
