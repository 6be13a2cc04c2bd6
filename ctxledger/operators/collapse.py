"""Responses collapse: which closed call rounds and messages of a request become pages, and the input after it.

Items are one row per item: request_id, idx, type, role, call_id, id, name, text (the
arguments of a call, the output of an output, the content of a message), and json (the whole
item; if the column is missing, a call is measured by its text). Requests carry the profile struct of
operators.profiles. Everything goes by request_id, one exchange by it serves all windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ctxledger.functions import geometry as G
from ctxledger.functions import layout
from ctxledger.functions import text as X
from ctxledger.functions.folds import fold
from ctxledger.operators import facts
from ctxledger.operators import pairs as R

#: Fixed value: the tag of a synthetic turn's text, worded freely.
INTRO, OUTRO = "Earlier items of this conversation, as pages:", "End of the earlier items."


def message_text(content: Column) -> Column:
    """Text of a message's content: a string as it is; of parts their texts and refusals, by blank lines; null where a part has neither."""
    parts = F.when(F.ltrim(content).startswith("["), F.from_json(content, "array<struct<type: string, text: string, refusal: string>>"))
    texts = F.transform(parts, lambda p: F.when((p["type"] == "refusal") & p["refusal"].isNotNull(), p["refusal"]).otherwise(p["text"]))
    return F.when(parts.isNull(), content).when(~F.exists(texts, lambda t: t.isNull()), F.array_join(texts, "\n\n"))


def page_text(s: Column) -> Column:
    """History text as its pages hold it: line ends trimmed, three newlines at most, one line."""
    return F.replace(X.neutralize(X.minify(s)), F.lit("\n"), F.lit(X.SENTINEL))


def round_members(items: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, idx, start, end) of the items of old completed rounds: all but the newest that cover the profile's ``keep_pairs``."""
    rounds = R.tool_rounds(items).join(requests.select("request_id", F.col("profile.keep_pairs").alias("keep")), "request_id")
    old = R.recent_rounds(rounds, F.col("keep")).where("not recent")
    first, last = F.col("end_idx") - F.col("calls") + 1, F.col("end_idx") + F.col("calls")
    return old.select("request_id", F.explode(F.sequence(first, last)).alias("idx"), first.alias("start"), last.alias("end"))


def classified(items: DataFrame, requests: DataFrame) -> DataFrame:
    """``items`` plus what each is to the plan: kind, run, start, end, body, ended_by.

    kind: ``unit`` (a message, or the first item of an old round), ``inside`` (the rest of a
    round), ``skip`` (a message without text), ``barrier``. Barriers part units into runs;
    ended_by is the type of the next barrier (untyped: none; null: there is none, or mode pairs). The last ``keep_tail``
    messages, the newest user message, and items that a reference names are barriers, as
    is a round with a named item. Under a profile of mode pairs only rounds are units.
    """
    by = Window.partitionBy("request_id")
    known = items.join(requests.select("request_id", F.col("profile.keep_tail").alias("_tail"), (F.col("profile.mode") == "mixed").alias("_mixed")), "request_id")
    members = round_members(items, requests)
    named = items.where((F.col("type") == "item_reference") & (F.coalesce("id", F.lit("")) != "")).select("request_id", "id", F.lit(True).alias("named")).distinct()
    rows = known.join(members, ["request_id", "idx"], "left").join(named, ["request_id", "id"], "left").withColumn("named", F.coalesce("named", F.lit(False)))
    spoken = F.col("role").isin("user", "assistant") & F.coalesce("type", F.lit("")).isin("", "message")
    rows = rows.withColumn("body", F.when(spoken, message_text(F.col("text"))))
    rows = rows.withColumn("said", F.coalesce(F.col("body").rlike(r"\S"), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("request_id", "said").orderBy(F.desc("idx")))
    newest = F.max(F.when(F.col("said") & (F.col("role") == "user"), F.col("idx"))).over(by)
    rows = rows.withColumns({
        "kept": F.col("said") & ((rank <= F.col("_tail")) | F.coalesce(F.col("idx") == newest, F.lit(False))),
        "taken": F.col("start").isNotNull() & ~(F.col("_mixed") & F.max("named").over(Window.partitionBy("request_id", "start"))),
    })
    free = F.col("_mixed") & ~F.col("named") & ~F.col("kept")
    kind = (
        F.when(F.col("taken"), F.when(F.col("idx") == F.col("start"), "unit").otherwise("inside"))
        .when(free & F.col("said"), "unit").when(free & F.col("body").isNotNull(), "skip").otherwise("barrier")
    )
    rows = rows.withColumn("kind", kind)
    sofar = Window.partitionBy("request_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("request_id").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    typed = F.when(F.coalesce("type", F.lit("")) == "", "untyped").otherwise(F.col("type"))
    rows = rows.withColumns({"run": F.count_if(F.col("kind") == "barrier").over(sofar), "ended_by": F.last(F.when(F.col("_mixed") & (F.col("kind") == "barrier"), typed), ignorenulls=True).over(later)})
    own = F.col("kind").isin("unit", "inside")
    return rows.withColumns({"start": F.when(own, F.coalesce(F.when(F.col("taken"), F.col("start")), F.col("idx"))), "end": F.when(own, F.coalesce(F.when(F.col("taken"), F.col("end")), F.col("idx")))}).drop("_tail", "_mixed", "named", "said", "kept")


def collapse_units(rows: DataFrame, size: Callable[[Column], Column] = X.piece_count) -> DataFrame:
    """One row per unit of ``classified`` items: request_id, run, start, end, ended_by, text, tokens, call_tokens, output_tokens, pairs.

    A round's text has its pairs in the order of their outputs; a call is measured by its whole json.
    """
    call = F.col("type") == R.CALL
    measured = size(F.coalesce(F.col("json") if "json" in rows.columns else F.col("text"), F.lit("")))
    own = rows.where("kind in ('unit', 'inside')").withColumns({"_tool": F.col("taken"), "_n": F.when(F.col("taken") & call, measured).otherwise(size(F.coalesce(F.when(F.col("taken"), F.col("text")).otherwise(F.col("body")), F.lit(""))))})
    part = F.struct("idx", "call_id", F.coalesce("name", F.lit("tool")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    units = own.groupBy("request_id", "run", "start", "end").agg(
        F.sort_array(F.collect_list(F.when(F.col("_tool") & call, part))).alias("calls"), F.sort_array(F.collect_list(F.when(F.col("_tool") & ~call, part))).alias("outputs"),
        F.max(F.when(~F.col("_tool"), X.tagged_turn(F.col("role"), F.col("idx"), F.col("body")))).alias("said"),
        F.first("ended_by").alias("ended_by"), F.sum("_n").cast("long").alias("tokens"), F.sum(F.when(F.col("_tool") & call, F.col("_n"))).cast("long").alias("call_tokens"), F.sum(F.when(F.col("_tool") & ~call, F.col("_n"))).cast("long").alias("output_tokens"),
    )
    by_id = F.map_from_entries(F.transform("calls", lambda c: F.struct(c["call_id"], F.concat(F.lit("[tool_use "), c["name"], F.lit("]\n"), c["text"]))))
    told = F.array_join(F.transform("outputs", lambda o: F.concat(F.element_at(by_id, o["call_id"]), F.lit("\n[tool_result]\n"), o["text"])), "\n\n")
    return units.select("request_id", "run", "start", "end", "ended_by", F.coalesce("said", told).alias("text"), "tokens", F.coalesce("call_tokens", F.lit(0)).alias("call_tokens"), F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"), F.size("calls").cast("long").alias("pairs"))


def with_line_pages(df: DataFrame, chars: str, out: str) -> DataFrame:
    """``df`` plus the pages of one line of so many narrow characters under its profile: full rows as deep as rows and characters allow, the rest row beside the last or on a page of its own."""
    cols, p = F.col("profile.strip_cols").cast("long"), F.col("profile")
    df = df.withColumn("_limit", G.lines_per_page(p["max_height"], p["cell_h"], p["strip_cols"]))
    df = df.withColumns({"_deep": F.greatest(F.lit(1).cast("long"), F.least(F.col("_limit"), F.floor((F.lit(G.READABLE) + 1) / (cols + 1)))), "_full": F.floor(F.col(chars) / cols), "_rest": F.col(chars) % cols})
    df = df.withColumn("_pages", F.ceil(F.col("_full") / F.col("_deep")))
    df = df.withColumn("_last", F.col("_full") - (F.col("_pages") - 1) * F.col("_deep"))
    joins = (F.col("_last") < F.col("_limit")) & (F.col("_last") * (cols + 1) + F.col("_rest") <= G.READABLE)
    pages = F.when(F.col("_full") == 0, 1).when((F.col("_rest") == 0) | joins, F.col("_pages")).otherwise(F.col("_pages") + 1).cast("long")
    return df.withColumn(out, pages).drop("_limit", "_deep", "_full", "_rest", "_pages", "_last")


def with_direct_price(df: DataFrame, chars: str, out: str = "image_tokens") -> DataFrame:
    """``df`` plus the vision tokens of one line of so many characters under its profile, without margin: estimated full pages, and the last as high as its rows.

    The steps are columns of their own, so that no expression is computed twice.
    """
    p = F.col("profile")
    df = df.withColumns({"_per": G.lines_per_page(p["max_height"], p["cell_h"], p["strip_cols"]), "_w": G.page_width(p["strip_cols"], p["cell_w"]), "_rows": F.greatest(F.lit(1).cast("long"), F.ceil(F.col(chars) / p["strip_cols"]))})
    df = df.withColumn("_pages", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("_rows") / F.col("_per")), F.ceil(F.col(chars) / G.READABLE)))
    last = F.least(F.col("_per"), F.greatest(F.lit(1), F.col("_rows") - (F.col("_pages") - 1) * F.col("_per")))
    df = df.withColumns({"_high": G.page_height(F.col("_per"), p["cell_h"]), "_short": F.least(p["max_height"].cast("long"), G.page_height(last, p["cell_h"]))})
    df = df.withColumns({"_a": G.vision_tokens(p, F.col("_w"), F.col("_high"), False), "_b": G.vision_tokens(p, F.col("_w"), F.col("_short"), False)})
    return df.withColumn(out, (F.col("_pages") - 1) * F.col("_a") + F.col("_b")).drop("_per", "_w", "_rows", "_pages", "_high", "_short", "_a", "_b")


def prefixes(units: DataFrame, requests: DataFrame, per_token: float = 4.0, pays: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``units`` plus, for the prefix of its run up to each: chars, narrow (its pages), baseline (tokens), image_tokens, pays; and profile.

    A unit begins with a printing character, so line ends and runs of newlines are settled
    before the next one: the characters of a prefix are a running sum, and pages of narrow
    characters follow in closed form. own and joined hold the text of runs that are not
    narrow. ``pays`` (image tokens, text tokens) is the strategy of the gate: fewer image than text
    tokens unless told otherwise. Under mode pairs the text side is characters over
    ``per_token``, under mixed the baseline.
    """
    pays = pays or (lambda image, text: image < text)
    rows = units.join(requests.select("request_id", "profile"), "request_id")
    rows = rows.withColumns({"own": page_text(F.col("text")), "joined": page_text(F.concat("text", F.lit("\n\n")))})
    run = Window.partitionBy("request_id", "run")
    before = run.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sofar = run.orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"chars": F.coalesce(F.sum(F.length("joined")).over(before), F.lit(0)) + F.length("own"), "baseline": F.sum("tokens").over(sofar), "_wide": F.max(F.col("own").rlike(layout.UNSURE)).over(run)})
    rows = with_direct_price(with_line_pages(rows, "chars", "narrow"), "chars")
    text = F.when(F.col("profile.mode") == "mixed", F.col("baseline").cast("double")).otherwise(F.col("chars") / F.lit(X.normal_ratio(per_token)))
    rows = rows.withColumns({c: F.when(F.col("_wide"), F.col(c)) for c in ("own", "joined")})
    return rows.withColumn("pays", pays(F.col("image_tokens").cast("double"), text)).drop("_wide")


_PLACED = StructField("placed", StructType([StructField("fits", BooleanType()), StructField("pages", LongType())]))


def _fit():
    """The fold of ``fitted``: pages left, and the run under way."""
    left, now, pager = None, None, None
    best, ok, whole, over = None, False, True, False

    def step(run, narrow, own, joined, cols, deep, good, budget):
        nonlocal left, now, pager, best, ok, whole, over
        left = budget if left is None else left
        if run != now:
            if now is not None and best is None:
                over = True
            elif now is not None and ok:
                left -= best
                over = over or not whole
            over = over or left <= 0
            now, pager, best, ok, whole = run, None, None, False, True
        size = narrow
        if own is not None:
            pager = pager or layout.Pager(cols, deep, G.READABLE)
            size = pager.pages(own)
            pager.feed(joined)
        if over or size > left:
            whole = False
            return {"fits": False, "pages": size}
        best, ok = size, bool(good)
        return {"fits": True, "pages": size}

    return step


def fitted(rows: DataFrame) -> DataFrame:
    """``prefixes`` plus pages, and fits: whether the pages that earlier runs left hold the run's prefix up to this unit.

    Runs go in order. Each takes its longest prefix that fits; if that pays, its pages are spent.
    A run of which nothing fits ends the plan, as does one that is taken in part and
    pays, or one that leaves no page. One that does not pay spends nothing. ``budget`` holds a request's
    pages. Wide characters and tabs are laid out as they are, each unit once.
    """
    p = F.col("profile")
    rows = rows.withColumns({"_cols": p["strip_cols"], "_deep": G.lines_per_page(p["max_height"], p["cell_h"], p["strip_cols"])}).drop("profile")
    out = fold(rows, "request_id", ["run", "start"], _fit, ["run", "narrow", "own", "joined", "_cols", "_deep", "pays", "budget"], _PLACED)
    return out.select("*", "placed.*").drop("placed", "own", "joined", "narrow", "_cols", "_deep")


def collapse_runs(fits: DataFrame) -> DataFrame:
    """One row per run: request_id, run, all its units and sizes, and of the prefix that fits its place, text and sizes; collapsed tells whether that becomes pages."""
    taken = lambda c: F.sum(F.when(F.col("fits"), F.col(c)).otherwise(0)).cast("long")
    own = F.struct("start", "pages", "pays")
    return fits.groupBy("request_id", "run").agg(
        F.count("*").alias("all_units"), F.sum("tokens").alias("all_tokens"), F.sum(X.u16len(F.col("text"))).alias("all_chars"), F.max("early").alias("early"), F.first("ended_by").alias("ended_by"),
        F.min(F.when(F.col("fits"), F.col("start"))).alias("insert_at"), F.max(F.when(F.col("fits"), own)).alias("_last"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("fits"), F.struct("start", "text")))), lambda x: x["text"]), "\n\n").alias("text"),
        F.count_if("fits").alias("units"), taken("tokens").alias("tokens"), taken("pairs").alias("pairs"), taken("call_tokens").alias("call_tokens"), taken("output_tokens").alias("output_tokens"),
        F.sum(F.when(F.col("fits"), F.col("end") - F.col("start") + 1).otherwise(0)).alias("items"),
    ).select("*", F.col("_last.start").alias("last"), F.col("_last.pages").alias("pages"), F.coalesce("_last.pays", F.lit(False)).alias("collapsed")).drop("_last")


def collapse_plans(runs: DataFrame, requests: DataFrame, most: int = 8) -> DataFrame:
    """The plan of each request from its runs; requests without runs have no_closed_prefix. barriers: what ended runs, ``type:n``, the ``most`` frequent in order."""
    done = lambda c: F.sum(F.when(F.col("collapsed"), F.col(c)).otherwise(0)).cast("long")
    joined = lambda chars, n: F.greatest(F.lit(0), chars + 2 * (n - 1)).cast("long")
    sums = runs.groupBy("request_id").agg(
        F.sum("all_units").alias("units"), F.sum("all_tokens").cast("long").alias("unit_tokens"), F.sum("all_chars").alias("_all"), F.max("early").alias("early"), F.max(F.col("insert_at").isNull()).alias("_capped"),
        F.count_if("collapsed").alias("segments"), done("pages").alias("pages"), done("items").alias("collapsed_items"), done("tokens").alias("baseline_tokens"), done("pairs").alias("collapsed_pairs"),
        done("call_tokens").alias("collapsed_call_tokens"), done("output_tokens").alias("collapsed_output_tokens"), F.sum(F.when(F.col("collapsed"), X.u16len(F.col("text"))).otherwise(0)).alias("_chars"), F.collect_list("ended_by").alias("_ends"),
    )
    counted = F.transform(F.array_distinct("_ends"), lambda t: F.struct((-F.size(F.filter("_ends", lambda x: x == t))).alias("m"), t.alias("t")))
    barriers = F.array_join(F.transform(F.slice(F.sort_array(counted), 1, most), lambda x: F.concat(x["t"], F.lit(":"), (-x["m"]).cast("string"))), ",")
    reason = F.when(F.col("units").isNull(), "no_closed_prefix").when(F.col("early").isNotNull(), F.col("early")).when(F.col("segments") > 0, "collapsed").when(F.col("_capped"), "too_many_images").otherwise("not_profitable")
    numbers = ("units", "unit_tokens", "segments", "pages", "collapsed_items", "baseline_tokens", "collapsed_pairs", "collapsed_call_tokens", "collapsed_output_tokens")
    zero = F.lit(0).cast("long")
    whole, part = joined(F.col("_all"), F.col("units")), joined(F.col("_chars"), F.col("segments"))
    rows = requests.select("request_id").join(sums, "request_id", "left")
    return rows.select("request_id", reason.alias("reason"), *(F.coalesce(F.col(c).cast("long"), zero).alias(c) for c in numbers), F.coalesce(whole, zero).alias("eligible_chars"), F.coalesce(F.when(F.col("segments") > 0, part).otherwise(whole), zero).alias("collapsed_chars"), F.coalesce(barriers, F.lit("")).alias("barriers"))


def responses_collapse(items: DataFrame, requests: DataFrame, size: Callable[[Column], Column] = X.piece_count, per_token: float = 4.0, pays: Callable[[Column, Column], Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plans, segments, classified items) of requests (request_id, profile).

    plans, a row per request: request_id, reason (no_closed_prefix, below_min_tokens, too_many_images,
    not_profitable or collapsed), units, unit_tokens, eligible_chars, segments, pages, collapsed_items,
    collapsed_chars, baseline_tokens, collapsed_pairs, collapsed_call_tokens, collapsed_output_tokens, barriers.
    segments: what becomes pages, with place, text and sizes.
    """
    rows = classified(items, requests)
    units = prefixes(collapse_units(rows, size), requests, per_token, pays)
    early = F.when(F.sum("tokens").over(Window.partitionBy("request_id")) < F.col("profile.min_collapse_tokens"), "below_min_tokens").when(F.col("profile.max_images") <= 0, "too_many_images")
    units = units.withColumn("early", early).withColumn("budget", F.when(F.col("early").isNull(), F.col("profile.max_images")).otherwise(0).cast("long"))
    runs = collapse_runs(fitted(units))
    return collapse_plans(runs, requests), runs.where("collapsed"), rows


def rewritten_items(rows: DataFrame, parts: DataFrame, compact: bool = False) -> DataFrame:
    """The input after collapse: request_id, idx (renumbered), source_idx (null: synthetic), type, role, text, pages.

    Each segment is one user item where its first item was: intro, the fact sheet of
    its text, outro; its pages are counted beside it. What it holds goes, all else stays as it is.
    """
    parts = parts.withColumn("doc_id", F.xxhash64("request_id", "run"))
    sheets = facts.fact_sheet(facts.fact_entries(facts.fact_spans(parts.select("doc_id", "text"))), compact)
    put = parts.join(sheets, "doc_id", "left").select("request_id", F.col("insert_at").alias("at"), F.lit(0).alias("_o"), F.lit(None).cast("long").alias("source_idx"), F.lit("message").alias("type"), F.lit("user").alias("role"), F.concat_ws("\n", F.lit(INTRO), "sheet", F.lit(OUTRO)).alias("text"), "pages")
    gone = rows.join(parts.select("request_id", F.col("run").cast("long").alias("run"), "last"), ["request_id", "run"], "left")
    stays = gone.where("kind not in ('unit', 'inside') or last is null or start > last")
    stays = stays.select("request_id", F.col("idx").alias("at"), F.lit(1).alias("_o"), F.col("idx").alias("source_idx"), "type", "role", "text", F.lit(0).cast("long").alias("pages"))
    order = Window.partitionBy("request_id").orderBy("at", "_o")
    return put.unionByName(stays).withColumn("idx", (F.row_number().over(order) - 1).cast("long")).drop("at", "_o")
