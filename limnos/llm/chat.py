"""Chat formatting: tool calls and their results, in DataFrame functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.storage import stage

#: tool -> (argument, type, required); types are those of JSON, with "integer" for whole numbers.
SCHEMAS = {
    "reply": (("text", "string", True), ("turn", "integer", True), ("words", "integer", True), ("after", "string", False)),
}


def faults(tool: Column, arguments: Column, schemas=SCHEMAS) -> Column:
    """What a call's JSON arguments lack or get wrong against its tool's schema, sorted."""
    parsed = F.try_parse_json(arguments)
    kind = lambda name: F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))
    fits = {"string": lambda k: k == "STRING", "integer": lambda k: k == "BIGINT", "number": lambda k: (k == "BIGINT") | (k == "DOUBLE") | k.startswith("DECIMAL"), "boolean": lambda k: k == "BOOLEAN"}
    out = F.array(F.concat(F.lit("unknown tool "), F.coalesce(tool, F.lit("null"))))
    for name, fields in schemas.items():
        found = []
        for field, wanted, required in fields:
            missing = F.when(F.lit(required), F.lit(f"{field} is missing"))
            found.append(F.when(kind(field).isNull(), missing).when(~fits[wanted](kind(field)), F.lit(f"{field} is no {wanted}")))
        out = F.when(tool == name, F.array_sort(F.array_compact(F.array(*found)))).otherwise(out)
    return F.when(parsed.isNull(), F.array(F.lit("no JSON"))).otherwise(out)


def _chains(ids: DataFrame, parents: DataFrame) -> DataFrame:
    """(call_id, root, dist): how far along single predecessors (``parents``: call_id, up) the first call of its chain is.

    Each round looks twice as far back. Calls in or behind a cycle of single
    predecessors have no root.
    """
    start = ids.join(parents, "call_id", "left").select("call_id", "up", F.when(F.col("up").isNull(), F.col("call_id")).alias("root"), F.col("up").isNotNull().cast("long").alias("dist"))
    far = stage(start, "call-chains")
    for _ in range(far.count().bit_length() + 1):
        if far.where("up is not null").isEmpty():
            break
        above = far.select(F.col("call_id").alias("at"), F.col("up").alias("next"), F.col("root").alias("first"), F.col("dist").alias("more"))
        met = far.join(above, F.col("up") == F.col("at"), "left")
        far = stage(met.select("call_id", F.col("next").alias("up"), F.coalesce("root", "first").alias("root"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist")), "call-chains")
    return far.select("call_id", "root", "dist")


def ranked(calls: DataFrame) -> DataFrame:
    """``calls`` (call_id, after) with the longest chain of calls before each as ``level``.

    Chains of calls with one predecessor each are followed by doubling, in as
    many rounds as their length has bits. What is left are the calls with
    several predecessors, each of which waits for the first calls of its
    predecessors' chains: rounds settle those whose predecessors are settled,
    so there are as many as such calls lie on one path. Predecessors that are
    no calls don't count. Calls in or behind a cycle get a null level.
    """
    known = calls.select(F.col("call_id").alias("known")).distinct()
    waits = stage(calls.select("call_id", F.explode("after").alias("needs")).join(known, F.col("needs") == F.col("known"), "left_semi").distinct(), "call-order")
    per_call = waits.groupBy("call_id").agg(F.count("*").alias("n"), F.min("needs").alias("up"))
    chains = _chains(calls.select("call_id").distinct(), per_call.where("n = 1").select("call_id", "up"))
    several = per_call.where("n > 1").select("call_id")
    at = chains.select(F.col("call_id").alias("needs"), F.col("root").alias("first"), (F.col("dist") + 1).alias("steps"))
    behind = waits.join(several, "call_id", "left_semi").join(at, "needs").groupBy("call_id", "first").agg(F.max("steps").alias("steps")).withColumn("level", F.lit(None).cast("long"))
    behind = stage(behind, "calls-behind")
    new = stage(chains.where("dist = 0").select("call_id").join(several, "call_id", "left_anti").withColumn("level", F.lit(0).cast("long")), "call-levels")
    levels = [new]
    while not behind.isEmpty() and not new.isEmpty():
        settled = new.select(F.col("call_id").alias("first"), F.col("level").alias("at"))
        told = stage(behind.join(settled, "first", "left").select("call_id", "first", "steps", F.coalesce("level", F.col("at") + F.col("steps")).alias("level")), "calls-behind")
        new = stage(told.groupBy("call_id").agg(F.count_if(F.col("level").isNull()).alias("open"), F.max("level").alias("level")).where("open = 0").select("call_id", "level"), "call-levels")
        behind = stage(told.join(new.select("call_id"), "call_id", "left_anti"), "calls-behind")
        levels.append(new)
    firsts = reduce(DataFrame.unionByName, levels).select(F.col("call_id").alias("root"), F.col("level").alias("base"))
    settled = chains.join(firsts, "root", "left").select("call_id", (F.col("base") + F.col("dist")).alias("level"))
    return calls.join(settled, "call_id", "left")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """Calls with their results, checked, ordered and serialised.

    ``calls`` has conv_id, call_id, tool, arguments (JSON) and after (call ids);
    ``results`` has call_id and content. Calls meet results by call_id. A call's
    level is the longest chain of calls before it, so sorting a conversation by
    level and call_id is a topological order; no conversation is sorted in one
    task. Arguments are checked against the tool's schema.

    Returns conv_id, call_id, level, status (linked, no result, invalid or
    cyclic), faults and message: canonical JSON of the call and its result.
    Of repeated calls or results of one id the smallest stays. Null ids are
    dropped; null or broken arguments are a fault; results without calls are
    not reported. Empty tables give no rows.
    """
    one_call = calls.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("conv_id", "tool", "arguments", "after")).alias("c")).select("call_id", "c.*")
    one_result = results.where("call_id is not null").groupBy("call_id").agg(F.min("content").alias("content"))
    linked = ranked(stage(one_call, "calls")).join(one_result, "call_id", "left").withColumn("faults", faults(F.col("tool"), F.col("arguments"), schemas))
    status = F.when(F.col("level").isNull(), "cyclic").when(F.size("faults") > 0, "invalid").when(F.col("content").isNull(), "no result").otherwise("linked")
    message = F.to_json(
        F.struct(
            F.try_parse_json("arguments").alias("arguments"),
            F.col("call_id").alias("id"),
            F.col("content").alias("result"),
            F.col("tool").alias("tool"),
        )
    )
    return linked.select("conv_id", "call_id", F.col("level").cast("long").alias("level"), status.alias("status"), F.concat_ws("; ", "faults").alias("faults"), message.alias("message"))


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every user turn as a call of the tool ``reply``, and every assistant turn as the result of the turn before.

    A call names the turn two before as its predecessor, if there is one. Turns
    without a conversation or number are left out; null texts are null arguments.
    """
    known = turns.where("conv_id is not null and turn is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    key = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    users = known.where(F.col("role") == "user").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    asked = users.withColumn("call_id", key(F.col("turn")))
    after = F.when(F.col("turn") >= 2, key(F.col("turn") - 2))
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    calls = asked.select(
        "conv_id",
        "call_id",
        F.lit("reply").alias("tool"),
        F.to_json(F.struct(words.alias("words"), "turn", "text", after.alias("after"))).alias("arguments"),
        F.array_compact(F.array(after)).alias("after"),
    )
    results = known.where(F.col("role") == "assistant").select(key(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


#: DuckDB SQL of link_tool_calls(*turns_as_calls(conversations)).
CHAT_SQL = r"""
with known as (
  select * from conversations where conv_id is not null and turn is not null
), users as (
  select conv_id, turn, min(text) as text, conv_id::varchar || ':' || turn as call_id from known where role = 'user' group by conv_id, turn
), replies as (
  select conv_id, turn - 1 as turn, min(text) as content from known where role = 'assistant' group by conv_id, turn
), runs as (
  select *, case when turn < 0 then turn else turn // 2 - row_number() over (partition by conv_id, turn % 2, turn < 0 order by turn) end as run from users
), levels as (
  select *, row_number() over (partition by conv_id, turn % 2, turn < 0, run order by turn) - 1 as level from runs
)
select l.conv_id, call_id, level::bigint as level,
  case when text is null then 'invalid' when content is null then 'no result' else 'linked' end as status,
  case when text is null then 'text is missing' else '' end as faults,
  '{"arguments":{' || case when turn >= 2 then '"after":"' || conv_id || ':' || (turn - 2) || '",' else '' end
    || coalesce('"text":' || to_json(text)::varchar || ',', '') || '"turn":' || turn || ',"words":' || len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))
    || '},"id":"' || call_id || '"' || coalesce(',"result":' || to_json(content)::varchar, '') || ',"tool":"reply"}' as message
from levels l left join replies r using (conv_id, turn)
"""
