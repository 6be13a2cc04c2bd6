"""Conversation history: transcripts, costs, trimming and the append-only freeze grid.

Tables are one row per turn: conversation key, ordinal ``idx``, ``role``, ``text``.
All windows are per conversation, so one exchange by its key serves a whole plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxledger.functions import text as X

#: Wrapper characters of a turn, the most units a user turn stays verbatim, units its image adds.
WRAPPER, USER_MOST, USER_EXTRA = 14, 2000, 20


def turn_segments(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One transcript per conversation: tagged turns in order, empty bodies dropped, joined by a blank line."""
    body = X.tagged_turn(F.col("role"), F.col("idx"), F.col("text"))
    parts = turns.where(F.coalesce(F.col("text"), F.lit("")) != "").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", body.alias("body")))).alias("parts"))
    return parts.select(key, F.array_join(F.transform("parts", lambda p: p["body"]), "\n\n").alias("transcript"))


def turn_costs(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """``turns`` plus text_cost, image_cost and their running totals."""
    size = X.u16len(F.coalesce(F.col("text"), F.lit("")))
    digits = F.length(F.col("idx").cast("string"))
    cost = F.when(size > 0, size + WRAPPER + 2 * F.length("role") + digits).otherwise(0)
    image = F.when((F.col("role") == "user") & (size > USER_MOST), size + USER_EXTRA).otherwise(0)
    sofar = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    out = turns.withColumns({"text_cost": cost.cast("long"), "image_cost": image.cast("long")})
    return out.withColumns({"text_total": F.sum("text_cost").over(sofar), "image_total": F.sum("image_cost").over(sofar)})


def pages(cost: Column, page_chars: int) -> Column:
    return F.ceil(cost / page_chars).cast("long")


def budget_trim(costs: DataFrame, budget: int, page_chars: int, key: str = "conv_id") -> DataFrame:
    """Turns kept per conversation: all if their pages fit the budget, else the longest prefix within its characters."""
    over = pages(F.max("text_total"), page_chars) + pages(F.max("image_total"), page_chars) > budget
    within = F.count_if(F.col("text_total") + F.col("image_total") <= budget * page_chars)
    return costs.groupBy(key).agg(F.count("*").alias("turns"), over.alias("over_budget"), F.when(over, within).otherwise(F.count("*")).alias("kept_turns"))


def freeze_grid(costs: DataFrame, budget: int, page_chars: int, base: int = 10, floor: int = 0, key: str = "conv_id", most: int = 12) -> DataFrame:
    """(key, step, pages, markers, goal): the smallest step of base * 2**k, at or over ``floor``, whose pages and marker splits meet the goal, or that spans all turns.

    The goal is the budget (0 or less: none); where ``costs`` has a column cold and it is true,
    one page more than the whole text needs, if that is less. A column marked tells
    the turns with a cache marker, each of which splits a chunk. Steps come from an array per turn, so cells are counted by
    one aggregation; k runs up to ``most``, at which a step spans any history of base * 2**most turns. ``base`` of 0 or less: one chunk.
    """
    turns = Window.partitionBy(key)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in costs.columns else F.lit(False)
    goal = F.lit(budget if budget > 0 else 2**31 - 1).cast("long")
    packed = F.greatest(F.lit(1).cast("long"), pages(F.sum("text_cost").over(turns), page_chars)) + 1
    rows = costs.withColumns({"range": F.max(F.col("idx") + 1).over(turns), "markers": F.count_if(flag("marked")).over(turns), "goal": F.when(F.max(flag("cold")).over(turns), F.least(goal, packed)).otherwise(goal)})
    steps = F.array(*(F.lit(base * 2**k).cast("long") for k in range(most + 1))) if base > 0 else F.array(F.col("range").cast("long"))
    rows = rows.select(key, "idx", "range", "markers", "goal", "text_cost", "image_cost", F.explode(steps).alias("step"))
    # a step is a candidate from the floor on; the first that spans the range is the last one needed
    rows = rows.where((F.col("step") >= floor) | (F.col("step") >= F.col("range"))).where(F.col("step") < 2 * F.greatest(F.col("range"), F.lit(floor), F.lit(base)))
    cells = rows.groupBy(key, "range", "markers", "goal", "step", F.floor(F.col("idx") / F.col("step")).alias("cell")).agg(F.sum("text_cost").alias("t"), F.sum("image_cost").alias("u"))
    sums = cells.groupBy(key, "range", "markers", "goal", "step").agg(F.sum(pages(F.col("t"), page_chars) + pages(F.col("u"), page_chars)).alias("pages"))
    fits = (F.col("step") >= F.col("range")) | (F.col("pages") + F.col("markers") <= F.col("goal"))
    return sums.where(fits).groupBy(key).agg(F.min("step").cast("long").alias("step"), F.min_by("pages", "step").alias("pages"), F.min("markers").alias("markers"), F.min("goal").alias("goal"))


def first_user_key(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Session key of each conversation: sha8 of the first user text (4096 units), ``global`` if there is none."""
    text = F.when(F.col("role") == "user", F.struct("idx", X.u16slice(F.coalesce("text", F.lit("")), 0, 4096).alias("head")))
    first = turns.groupBy(key).agg(F.min(text).alias("first"))
    return first.select(key, F.when(F.coalesce(F.col("first.head"), F.lit("")) == "", "global").otherwise(X.sha8(F.col("first.head"))).alias("session"))


def latest_user(turns: DataFrame, key: str = "conv_id", most: int = 300) -> DataFrame:
    """Newest user turn of each conversation: its index and a preview."""
    found = turns.where(F.col("role") == "user").groupBy(key).agg(F.max(F.struct("idx", "text")).alias("u"))
    one = F.trim(F.regexp_replace(F.coalesce(F.col("u.text"), F.lit("")), X.SPACES + "+", " "))
    cut = F.concat(F.rtrim(X.u16slice(one, 0, most)), F.lit("..."))
    return found.select(key, F.col("u.idx").alias("idx"), F.when(X.u16len(one) > most, cut).otherwise(one).alias("preview"))


def latest_user_pointer(turns: DataFrame, end: Column | int, protected: Column | int = 0, key: str = "conv_id") -> DataFrame:
    """(key, idx, verbatim, told) of the newest user turn with text before ``end``.

    From ``protected`` on a turn is told by its preview; an earlier one is part of
    nothing that stays, so it is carried: whole, or its head and tail if it is long.
    """
    from ctxledger.operators.planning import verbatim_task

    users = turns.where((F.col("role") == "user") & (F.col("idx") < end) & F.coalesce("text", F.lit("")).rlike(r"\S"))
    bound = protected if isinstance(protected, Column) else F.lit(protected)
    found = users.groupBy(key).agg(F.max(F.struct("idx", "text", bound.alias("p"))).alias("u"))
    carried = F.col("u.idx") < F.col("u.p")
    one = F.btrim(F.regexp_replace(F.col("u.text"), X.SPACES + "+", " "))
    short = F.when(X.u16len(one) > 300, F.concat(F.rtrim(X.u16slice(one, 0, 300)), F.lit("..."))).otherwise(one)
    return found.select(key, F.col("u.idx").alias("idx"), carried.alias("verbatim"), F.when(carried, verbatim_task(F.col("u.text"))).otherwise(short).alias("told"))


def protected_turns(turns: DataFrame, keep_tail: int, key: str = "conv_id") -> DataFrame:
    """``turns`` plus kept: the last ``keep_tail`` and the newest user turn stay as they are."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("idx")))
    last = F.max(F.when(F.col("role") == "user", F.col("idx"))).over(Window.partitionBy(key))
    return turns.withColumn("kept", (rank <= keep_tail) | F.coalesce(F.col("idx") == last, F.lit(False)))


def verbatim_users(turns: DataFrame, key: str = "conv_id", most: int = USER_MOST, previews: int = 8) -> DataFrame:
    """User turns: verbatim text up to ``most`` units; of the longer ones the newest ``previews`` as previews."""
    users = turns.where(F.col("role") == "user").withColumn("units", X.u16len(F.coalesce("text", F.lit(""))))
    long = F.col("units") > most
    rank = F.row_number().over(Window.partitionBy(key, long).orderBy(F.desc("idx")))
    shown = F.when(~long, F.col("text")).when(rank <= previews, X.preview(F.coalesce("text", F.lit(""))))
    return users.withColumns({"verbatim": ~long, "shown": shown}).where("shown is not null")


def chunk_plan(turns: DataFrame, step: int, key: str = "conv_id") -> DataFrame:
    """Chunks at multiples of ``step``: first and last index, characters, and whether the chunk is full."""
    costs = turn_costs(turns, key)
    cell = F.floor(F.col("idx") / step).alias("chunk")
    out = costs.groupBy(key, cell).agg(F.min("idx").alias("from_idx"), F.max("idx").alias("to_idx"), F.sum("text_cost").alias("text_chars"), F.count("*").alias("turns"))
    return out.withColumn("closed", F.col("turns") == step)


def rewritten(turns: DataFrame, keep_tail: int, key: str = "conv_id", intro: str = "Earlier turns:") -> DataFrame:
    """The conversation after collapse: one synthetic turn for the closed head, then the kept turns, renumbered."""
    flagged = protected_turns(turns, keep_tail, key)
    head = turn_segments(flagged.where(~F.col("kept")), key).select(key, F.lit(-1).cast("long").alias("idx"), F.lit("user").alias("role"), F.concat(F.lit(intro + "\n\n"), F.col("transcript")).alias("text"))
    tail = flagged.where("kept").select(key, F.col("idx").cast("long").alias("idx"), "role", "text")
    out = head.unionByName(tail)
    return out.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy("idx")) - 1)
