"""Tool calls and their outputs: pairing, rounds, closed prefixes, composition.

Items are one row per item: request_id, idx, type, call_id, text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxledger.functions.text import u16len

CALL, OUTPUT = "function_call", "function_call_output"


def pair_calls(items: DataFrame) -> DataFrame:
    """One row per (request, call id): calls, outputs, first indices, status.

    pair: one call and one output, the call first; open: calls only; orphan:
    outputs only; malformed otherwise. Items without an id bypass the grouping
    (one blank key could hold most rows) and are counted by pair_state.
    """
    tools = items.where(F.col("type").isin(CALL, OUTPUT) & (F.coalesce(F.col("call_id"), F.lit("")) != ""))
    call = F.col("type") == CALL
    sums = tools.groupBy("request_id", "call_id").agg(
        F.count_if(call).alias("calls"), F.count_if(~call).alias("outputs"),
        F.min(F.when(call, F.col("idx"))).alias("call_idx"), F.min(F.when(~call, F.col("idx"))).alias("output_idx"),
    )
    pair = (F.col("calls") == 1) & (F.col("outputs") == 1) & (F.col("call_idx") < F.col("output_idx"))
    status = F.when(pair, "pair").when(F.col("outputs") == 0, "open").when(F.col("calls") == 0, "orphan").otherwise("malformed")
    return sums.withColumn("status", status)


def tool_rounds(items: DataFrame) -> DataFrame:
    """Completed rounds: request_id, end_idx (last call), calls.

    Calls of pairs at adjacent indices form an island ending at e. Its round is the
    largest k for which items e+1..e+k are the outputs of its last k calls, in any
    order: the j-th item after e is such an output and none up to it reaches back
    over k calls.
    """
    pairs = pair_calls(items).where("status = 'pair'").select("request_id", "call_idx", "output_idx")
    order = Window.partitionBy("request_id").orderBy("call_idx")
    islands = pairs.withColumn("island", F.col("call_idx") - F.row_number().over(order))
    islands = islands.withColumn("end_idx", F.max("call_idx").over(Window.partitionBy("request_id", "island")))
    after = islands.where("output_idx > end_idx").withColumns({"j": F.col("output_idx") - F.col("end_idx"), "depth": F.col("end_idx") - F.col("call_idx") + 1})
    sofar = Window.partitionBy("request_id", "island").orderBy("output_idx")
    after = after.withColumns({"n": F.row_number().over(sofar), "reach": F.max("depth").over(sofar)})
    return after.where("n = j and reach <= j").groupBy("request_id", "end_idx").agg(F.max("j").cast("long").alias("calls"))


def recent_rounds(rounds: DataFrame, keep: int) -> DataFrame:
    """``rounds`` plus recent: the newest rounds until ``keep`` pairs are covered."""
    newest = Window.partitionBy("request_id").orderBy(F.desc("end_idx"))
    return rounds.withColumn("recent", F.sum("calls").over(newest) - F.col("calls") < keep)


def pair_state(items: DataFrame, keep: int = 6) -> DataFrame:
    """Counters per request: completed, recent and old pairs, open calls, orphan outputs, malformed items.

    Pairs outside rounds count as two malformed items each, as do items without an id (one each).
    """
    sums = pair_calls(items).groupBy("request_id").agg(
        F.sum(F.when(F.col("status") == "pair", 1).otherwise(0)).alias("pairs"),
        F.sum(F.when(F.col("status") == "open", F.col("calls")).otherwise(0)).alias("open_calls"),
        F.sum(F.when(F.col("status") == "orphan", F.col("outputs")).otherwise(0)).alias("orphan_outputs"),
        F.sum(F.when(F.col("status") == "malformed", F.col("calls") + F.col("outputs")).otherwise(0)).alias("bad"),
    )
    blank = items.where(F.col("type").isin(CALL, OUTPUT) & (F.coalesce(F.col("call_id"), F.lit("")) == "")).groupBy("request_id").agg(F.count("*").alias("blank"))
    done = recent_rounds(tool_rounds(items), keep).groupBy("request_id").agg(F.sum("calls").alias("completed"), F.sum(F.when(F.col("recent"), F.col("calls")).otherwise(0)).alias("recent"))
    out = items.select("request_id").distinct()
    for part in (sums, blank, done):
        out = out.join(part, "request_id", "left")
    out = out.fillna(0)
    malformed = F.col("bad") + F.col("blank") + 2 * (F.col("pairs") - F.col("completed"))
    return out.select(
        "request_id", F.col("completed").alias("completed_pairs"), F.col("recent").alias("recent_pairs"), (F.col("completed") - F.col("recent")).alias("old_pairs"),
        "open_calls", "orphan_outputs", malformed.alias("malformed_items"),
    )


def closed_prefix(items: DataFrame, cutoff: int) -> DataFrame:
    """Last index under ``cutoff`` at which no call is open and no opaque item has come yet; -1 if none.

    An id's call opens it and its output closes it; repeats of the same kind change nothing.
    """
    by_id = Window.partitionBy("request_id", "call_id").orderBy("idx")
    tool = F.col("type").isin(CALL, OUTPUT) & (F.coalesce(F.col("call_id"), F.lit("")) != "")
    marked = items.withColumn("kind", F.when(tool, F.when(F.col("type") == CALL, 1).otherwise(-1)))
    marked = marked.withColumn("before", F.when(tool, F.lag("kind", 1, -1).over(by_id)))
    delta = F.when(tool & (F.col("kind") != F.col("before")), F.col("kind")).otherwise(0)
    sofar = Window.partitionBy("request_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumns({"open": F.sum(delta).over(sofar), "opaque": F.max((F.col("type") == "reasoning").cast("int")).over(sofar)})
    closed = (F.col("open") == 0) & (F.col("opaque") == 0) & (F.col("idx") < cutoff)
    return marked.groupBy("request_id").agg(F.coalesce(F.max(F.when(closed, F.col("idx"))), F.lit(-1)).cast("long").alias("closed_prefix"))


CLASSES = ("function_call", "function_call_output", "message", "reasoning")


def composition(items: DataFrame) -> DataFrame:
    """Characters per request by item type (fixed list), and in total."""
    size = u16len(F.coalesce("text", F.lit("")))
    sums = [F.sum(F.when(F.col("type") == c, size).otherwise(0)).cast("long").alias(c) for c in CLASSES]
    return items.groupBy("request_id").agg(*sums, F.sum(size).cast("long").alias("total"))


#: The types of opaque items.
OPAQUE = ("compaction", "compaction_trigger", "context_compaction", "item_reference")


def token_composition(items: DataFrame, requests: DataFrame | None = None, size=None) -> DataFrame:
    """Sizes per request by what they are spent on, and in total; one exchange by request.

    items: request_id, type, role, text, images (image parts), and json (the whole item) if there:
    calls, reasoning, compaction and other items are measured by it, messages and outputs by
    their text. A role decides first, then the type. requests (request_id, instructions, tools), if given, adds the
    size of both. ``size`` measures a text column: UTF-16 units, or a token count.
    """
    size = size or (lambda c: u16len(c))
    role, kind = F.coalesce("role", F.lit("")), F.coalesce("type", F.lit(""))
    spent = (
        F.when(role.isin("system", "developer"), "system_developer").when(role.isin("user", "assistant"), "user_assistant").when(kind == CALL, "function_calls").when(kind == OUTPUT, "function_outputs")
        .when(kind == "reasoning", "reasoning").when(kind.isin(*OPAQUE), "compaction").when((role == "") & (kind != ""), "other")
    )
    measured = F.coalesce(F.when(spent.isin("function_calls", "reasoning", "compaction", "other"), F.col("json")), F.col("text")) if "json" in items.columns else F.col("text")
    rows = items.select("request_id", spent.alias("spent"), size(F.coalesce(measured, F.lit(""))).alias("size"), F.coalesce(F.col("images"), F.lit(0)).cast("long").alias("images"))
    if requests is not None:
        for c in ("instructions", "tools"):
            rows = rows.unionByName(requests.select("request_id", F.lit(c).alias("spent"), size(F.coalesce(c, F.lit(""))).alias("size"), F.lit(0).cast("long").alias("images")))
    classes = ("instructions", "system_developer", "user_assistant", "function_calls", "function_outputs", "reasoning", "compaction", "tools", "other")
    sums = [F.sum(F.when(F.col("spent") == c, F.col("size")).otherwise(0)).cast("long").alias(c) for c in classes]
    return rows.groupBy("request_id").agg(*sums, F.sum(F.when(F.col("spent").isNotNull(), F.col("size")).otherwise(0)).cast("long").alias("total"), F.sum("images").alias("image_parts"))


def unreferenced(items: DataFrame, references: DataFrame) -> DataFrame:
    """Items that no reference (request_id, ref_id) names."""
    return items.join(references.select("request_id", F.col("ref_id").alias("call_id")).distinct(), ["request_id", "call_id"], "left_anti")


def barriers(items: DataFrame, most: int = 8) -> DataFrame:
    """Types that stop a collapsible run, per request: the ``most`` most frequent as ``type:n`` in order."""
    stops = items.where(~F.col("type").isin(CALL, OUTPUT)).groupBy("request_id", "type").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("n"), "type"))
    top = stops.withColumn("rank", rank).where(F.col("rank") <= most)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("rank", "type", "n"))), lambda x: F.concat(x["type"], F.lit(":"), x["n"].cast("string")))
    return top.groupBy("request_id").agg(F.array_join(parts, ",").alias("barriers"))


def collapsible_units(items: DataFrame, rounds: DataFrame, keep_tail: int = 6, keep_pairs: int = 6) -> DataFrame:
    """Items of old rounds outside the protected tail: items minus protected minus recent rounds."""
    last = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("idx")))
    free = items.withColumn("_r", last).where(F.col("_r") > keep_tail).drop("_r")
    old = recent_rounds(rounds, keep_pairs).where("not recent").select("request_id", "end_idx", "calls")
    inside = (F.col("idx") > F.col("end_idx") - F.col("calls")) & (F.col("idx") <= F.col("end_idx") + F.col("calls"))
    return free.join(old, "request_id").where(inside)
