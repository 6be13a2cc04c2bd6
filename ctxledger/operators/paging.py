"""Paging of over-long texts and admission of candidates to a budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField

from ctxledger.functions import geometry as G
from ctxledger.functions import text as X
from ctxledger.functions.folds import fold


def head_tail_paging(texts: DataFrame, max_pages: int, cols: int, page_chars: int, page_lines: int, key: str = "doc_id") -> DataFrame:
    """Head and tail lines that stay of each text over ``max_pages`` pages.

    Structured text keeps a head only; other text spends 60 % of the row and
    character budget on the head, the rest on the tail. Only over-budget texts are
    exploded into lines; the running sums are monotone, so a filter finds the cuts.
    """
    per = min(page_lines, max(1, page_chars // max(1, cols)))
    rows, chars = max(8, max_pages * per - 6), max(128, max_pages * page_chars - 512)
    body = F.coalesce("text", F.lit(""))
    over = texts.select(key, body.alias("text"), X.estimate_pages_of(body, cols, page_chars, page_lines).alias("pages")).where(F.col("pages") > max_pages)
    over = over.withColumns({"structured": X.classify_content(F.col("text")) == "structured", "units": X.u16len(F.col("text"))})
    sep = F.when(F.contains("text", F.lit("\n")), "\n").otherwise(X.SENTINEL)
    line = over.select(key, "pages", "structured", "units", F.posexplode(F.split("text", sep, -1)).alias("i", "line"))
    one = Window.partitionBy(key)
    line = line.withColumns({"n": F.count("*").over(one), "size": X.u16len(F.col("line"))}).drop("line")
    line = line.withColumns({"r": F.greatest(F.lit(1), F.ceil(F.col("size") / cols)), "head_chars": F.col("size") + (F.col("i") > 0).cast("int"), "tail_chars": F.col("size") + (F.col("i") < F.col("n") - 1).cast("int")})
    down, up = one.orderBy("i"), one.orderBy(F.desc("i"))
    line = line.withColumns({"hr": F.sum("r").over(down), "hc": F.sum("head_chars").over(down), "tr": F.sum("r").over(up), "tc": F.sum("tail_chars").over(up)})
    head_rows, head_chars = int(rows * 0.6), int(chars * 0.6)
    in_head = (F.col("hr") <= F.when(F.col("structured"), rows).otherwise(head_rows)) & (F.col("hc") <= F.when(F.col("structured"), chars).otherwise(head_chars))
    line = line.withColumn("head", F.greatest(F.lit(1), F.count_if(in_head).over(one)))
    in_tail = ~F.col("structured") & (F.col("i") >= F.col("head")) & (F.col("tr") <= rows - head_rows) & (F.col("tc") <= chars - head_chars)
    out = line.groupBy(key).agg(
        F.first("pages").alias("pages"), F.first("units").alias("units"), F.first("n").alias("lines"), F.first("head").alias("head_lines"), F.count_if(in_tail).alias("tail"),
        F.sum(F.when(F.col("i") < F.col("head"), F.col("head_chars")).otherwise(0)).alias("head_units"), F.sum(F.when(in_tail, F.col("tail_chars")).otherwise(0)).alias("tail_units"),
    )
    # a tail that is empty or meets the head is dropped
    split = (F.col("tail") > 0) & (F.col("head_lines") + F.col("tail") < F.col("lines"))
    tail = F.when(split, F.col("tail")).otherwise(0)
    kept = F.col("head_units") + F.when(split, F.col("tail_units")).otherwise(0)
    return out.select(key, "pages", "lines", "head_lines", tail.alias("tail_lines"), (F.col("lines") - F.col("head_lines") - tail).alias("omitted_lines"), (F.col("units") - kept).alias("omitted_units"), "units")


def paging_marker(name: str = "paging"):
    """The marker between head and tail of a paged text, a blank line on either side, from the columns of head_tail_paging."""
    n = X.thousands
    shown = F.when(F.col("tail_lines") > 0, F.format_string(" Showing first %d lines and last %d lines.", "head_lines", "tail_lines")).otherwise(F.format_string(" Showing first %d lines (tail elided).", "head_lines"))
    cut = F.concat(F.lit(f"\n\n[ {name}: omitted "), n(F.col("omitted_lines")), F.lit(" lines ("), n(F.col("omitted_units")), F.lit(" chars) of content here. Original length: "))
    return F.concat(cut, n(F.col("units")), F.lit(" chars ("), n(F.col("lines")), F.lit(" lines, ~"), F.col("pages").cast("string"), F.lit(" images)."), shown, F.lit(" ]\n\n"))


def paging_candidates(results: DataFrame, least: int = 6000, keep_sharp=None, cap: int = 10, per_token: float = 4.0, pays: Callable[[Column, Column], Column] = G.profitable) -> DataFrame:
    """``results`` (text, is_error, and profile, if pages are to be priced) plus reason: why a tool result stays text, or ``candidate``.

    ``keep_sharp`` is a caller's Column predicate; null counts as not kept. With a profile
    column, a result whose pages (``cap`` at most) do not pay is not_profitable: ``pays`` (image tokens, text tokens)
    is the strategy of the gate.
    """
    rows = priced(results, cap)
    sharp = F.lit(False) if keep_sharp is None else F.coalesce(keep_sharp, F.lit(False))
    reason = F.when(F.coalesce("is_error", F.lit(False)), "is_error").when(sharp, "keep_sharp").when(F.col("units") < least, "below_threshold")
    if "profile" in results.columns:
        reason = reason.when(~pays(F.col("image_tokens"), X.text_tokens(F.col("units"), per_token)), "not_profitable")
    return rows.withColumn("reason", reason.otherwise("candidate"))


def priced(results: DataFrame, cap: int = 10) -> DataFrame:
    """``results`` (text, and profile if pages are to be priced) plus units of the packed text, and under a profile pages (``cap`` at most) and their image_tokens."""
    rows = results.withColumn("units", X.u16len(X.packed(F.col("text"))))
    if "profile" not in results.columns:
        return rows
    p = F.col("profile")
    rows = rows.withColumns({"_per": G.lines_per_page(p["max_height"], p["cell_h"], p["strip_cols"]), "_rows": X.packed_rows(F.col("units"), p["strip_cols"])})
    rows = rows.withColumns({"_rows": F.least(F.col("_rows"), cap * F.col("_per")), "pages": F.least(F.lit(cap), G.ceil_div(F.col("_rows"), F.col("_per")))})
    return G.with_image_tokens(rows.drop("_per"), "_rows").drop("_rows")


def admit_by_budget(candidates: DataFrame, images: int | str, size: int, key: str = "request_id") -> DataFrame:
    """``candidates`` (key, idx, pages, bytes) plus admitted: in order, one that would exceed a budget is skipped and later, smaller ones may pass.

    ``images`` is a number or the column that holds a request's own.

    The rule depends on what was admitted before, so it is a fold over each
    request's candidates, not a running sum.
    """

    def rule():
        left, room = None, size

        def step(pages, size_, images_):
            nonlocal left, room
            left = images_ if left is None else left
            if pages > left or size_ > room:
                return False
            left, room = left - pages, room - size_
            return True

        return step

    own = F.col(images) if isinstance(images, str) else F.lit(images)
    rows = candidates.select(key, F.col("idx").cast("long"), F.col("pages").cast("long"), F.col("bytes").cast("long"), own.cast("long").alias("_images"))
    return fold(rows, key, ["idx"], rule, ["pages", "bytes", "_images"], StructField("admitted", BooleanType())).drop("_images")


def codepoints(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, cp, n) of the non-ASCII characters of texts, counted within each text before anything is shuffled."""
    rare = texts.where(F.col("text").rlike(r"[^\x00-\x7F]")).select(key, F.split(F.regexp_replace("text", r"[\x00-\x7F]+", ""), "").alias("c"))
    return rare.select(F.explode("c").alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n"))


def uncovered_codepoints(texts: DataFrame, glyphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of characters without a glyph: ``glyphs`` (c) is the user's coverage table."""
    return codepoints(texts, key).join(glyphs.select("c"), "c", "left_anti")


def top_codepoints(counts: DataFrame, most: int = 20) -> DataFrame:
    """The ``most`` most frequent as U+XXXX, ties by code point: a report whose limit is the feature."""
    named = counts.withColumn("cp", F.ascii("c").cast("long")).orderBy(F.desc("n"), "cp").limit(most)
    return named.select(F.concat(F.lit("U+"), F.lpad(F.hex("cp"), 4, "0")).alias("codepoint"), "n")
