"""Request bodies flattened to messages, blocks and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxledger.functions import text as X
from ctxledger.functions.layout import with_page_geometry

_BLOCK = "type: string, text: string, thinking: string, id: string, name: string, input: string, tool_use_id: string, is_error: boolean, source: struct<type: string, media_type: string, data: string>"
BLOCKS = f"array<struct<{_BLOCK}, content: string, cache_control: string>>"
_MESSAGES = f"struct<messages: array<struct<role: string, content: {BLOCKS}>>>"
_STRINGS = "struct<messages: array<struct<role: string, content: string>>>"
_INNER = "array<struct<type: string, text: string, source: struct<type: string, media_type: string, data: string>>>"


def explode_messages(requests: DataFrame) -> DataFrame:
    """One row per message: request_id, idx, role, content_is_array, text, blocks. No shuffle.

    A string content is one text; an array keeps its blocks. A body that does not
    parse gives no rows; a wrong-typed field is null and hides no other.
    """
    both = requests.select("request_id", F.from_json("body", _MESSAGES)["messages"].alias("m"), F.from_json("body", _STRINGS)["messages"].alias("s"))
    rows = both.select("request_id", F.posexplode(F.arrays_zip("m", "s")).alias("idx", "z"))
    is_array = F.col("z.m.content").isNotNull()
    text = F.when(~is_array, F.col("z.s.content"))
    return rows.select("request_id", F.col("idx").cast("long").alias("idx"), F.coalesce("z.m.role", "z.s.role").alias("role"), is_array.alias("content_is_array"), text.alias("text"), F.col("z.m.content").alias("blocks"))


def explode_blocks(messages: DataFrame) -> DataFrame:
    """One row per block, a string content being one text block; nested tool results as their text and images."""
    single = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in _FIELDS)))
    rows = messages.select("request_id", F.col("idx").alias("msg_idx"), "role", F.posexplode(F.coalesce("blocks", single.cast(BLOCKS))).alias("block_idx", "b"))
    inner = F.from_json("b.content", _INNER)
    result_text = F.when(inner.isNotNull(), F.array_join(F.transform(F.filter(inner, lambda x: x["type"] == "text"), lambda x: x["text"]), "\n")).otherwise(F.col("b.content"))
    images = F.when(F.col("b.type") == "image", F.array("b.source.data")).otherwise(F.transform(F.filter(F.coalesce(inner, F.array().cast(_INNER)), lambda x: x["type"] == "image"), lambda x: x["source"]["data"]))
    return rows.select(
        "request_id", "msg_idx", "block_idx", "role", F.col("b.type").alias("type"), F.coalesce("b.text", "b.thinking").alias("text"), F.coalesce("b.tool_use_id", "b.id").alias("tool_id"),
        F.col("b.name").alias("tool_name"), F.col("b.input").alias("tool_input"), F.when(F.col("b.type") == "tool_result", result_text).alias("result_text"),
        F.coalesce("b.is_error", F.lit(False)).alias("is_error"), images.alias("images"), F.col("b.cache_control").alias("cache_control"),
    )


_FIELDS = (("thinking", "string"), ("id", "string"), ("name", "string"), ("input", "string"), ("tool_use_id", "string"), ("is_error", "boolean"), ("source", "struct<type: string, media_type: string, data: string>"), ("content", "string"), ("cache_control", "string"))


#: What a tool says of a file just written, and what that is worth once the turn is past.
FRESH = r"\(file state is current in your\s+context — no need to Read it back\)"
STALE = "(state as of this PRIOR turn — the file may have changed since; Read it again before editing)"


def block_text(blocks: DataFrame) -> Column:
    """Transcript text of a block by its type; null where it has none. A result's note that a file is current is taken back."""
    kind = F.col("type")
    head = F.when(F.col("is_error"), "[tool_result (error)]").otherwise("[tool_result]")
    return (
        F.when(kind == "text", F.col("text"))
        .when(kind == "tool_use", F.concat(F.lit("[tool_use "), F.coalesce("tool_name", F.lit("tool")), F.lit("]\n"), F.coalesce("tool_input", F.lit("{}"))))
        .when(kind == "tool_result", F.concat(head, F.lit("\n"), F.regexp_replace(F.coalesce("result_text", F.lit("")), FRESH, STALE)))
        .when(kind == "image", F.lit("[image]"))
    )


def transcript_text(blocks: DataFrame) -> DataFrame:
    """(request_id, msg_idx, role, text): the texts of a message's blocks in order, joined by a blank line."""
    rows = blocks.select("request_id", "msg_idx", "role", "block_idx", block_text(blocks).alias("t")).where("t is not null and t <> ''")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("block_idx", "t"))), lambda x: x["t"])
    return rows.groupBy("request_id", "msg_idx", "role").agg(F.array_join(parts, "\n\n").alias("text"))


def split_user_typed(blocks: DataFrame, marker: str = "<end-of-context>") -> DataFrame:
    """``blocks`` plus typed: the user's own text blocks, after the last context marker, not empty, not reminders."""
    from pyspark.sql import Window

    mark = F.max(F.when(F.contains("text", F.lit(marker)), F.col("block_idx"))).over(Window.partitionBy("request_id", "msg_idx"))
    own = (F.col("role") == "user") & (F.col("type") == "text") & (F.trim(F.coalesce("text", F.lit(""))) != "") & ~F.ltrim("text").startswith("<system-reminder>")
    return blocks.withColumn("typed", own & (F.col("block_idx") > F.coalesce(mark, F.lit(-1))))


def explode_items(requests: DataFrame) -> DataFrame:
    """Responses ``input`` as items; a bare string is one user message. json is the whole item, its keys in order."""
    kind = "struct<type: string, role: string, call_id: string, id: string, name: string, arguments: string, output: string, content: string, item_id: string, ref_id: string>"
    parsed = F.from_json("body", f"struct<input: array<{kind}>>")["input"]
    raw = F.from_json("body", "struct<input: array<string>>")["input"]
    bare = F.get_json_object("body", "$.input")
    one = F.array(F.struct(F.lit("message").alias("type"), F.lit("user").alias("role"), *(F.lit(None).cast("string").alias(n) for n in ("call_id", "id", "name", "arguments", "output")), bare.alias("content"), F.lit(None).cast("string").alias("item_id"), F.lit(None).cast("string").alias("ref_id")))
    zipped = F.when(parsed.isNotNull(), F.arrays_zip(parsed.alias("i"), raw.alias("json"))).when(bare.isNotNull(), F.arrays_zip(one.alias("i"), F.array(F.to_json(bare_message(bare))).alias("json")))
    rows = requests.select("request_id", F.posexplode(zipped).alias("idx", "z")).select("request_id", "idx", "z.i", "z.json")
    text = F.coalesce("i.arguments", "i.output", "i.content")
    return rows.select("request_id", F.col("idx").cast("long").alias("idx"), F.coalesce("i.type", F.lit("message")).alias("type"), F.col("i.role").alias("role"), F.col("i.call_id").alias("call_id"), F.coalesce("i.id", "i.item_id", "i.ref_id").alias("id"), F.col("i.name").alias("name"), text.alias("text"), "json")


def bare_message(text: Column) -> Column:
    return F.struct(F.lit("message").alias("type"), F.lit("user").alias("role"), text.alias("content"))


def normalize_dialog(messages: DataFrame, items: DataFrame) -> DataFrame:
    """Chat messages and Responses items as one turn table: system and developer are system, untyped items keep their text."""
    role = F.when(F.col("role").isin("system", "developer"), "system").otherwise(F.coalesce("role", F.lit("assistant")))
    left = messages.select("request_id", "idx", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    spoken = F.col("type") == "message"
    right = items.select("request_id", "idx", F.when(spoken, role).otherwise("assistant").alias("role"), F.when(spoken, F.coalesce("text", F.lit(""))).otherwise("").alias("text"))
    return left.unionByName(right)


def cache_markers(body: Column) -> Column:
    """Non-null cache_control objects at any depth of raw JSON; quoted text does not count."""
    return F.regexp_count(body, F.lit(r'(?<!\\)"cache_control"\s*:\s*+(?!null)'))


def native_images(blocks: DataFrame) -> DataFrame:
    """Images and their decoded bytes per request, at both nesting levels."""
    sizes = F.transform("images", lambda x: X.b64_bytes(F.coalesce(x, F.lit(""))))
    return blocks.groupBy("request_id").agg(F.sum(F.size("images")).alias("images"), F.sum(F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)).alias("bytes"))


def outgoing_chars(blocks: DataFrame, systems: DataFrame | None = None, tools: DataFrame | None = None) -> DataFrame:
    """UTF-16 units that a request sends as text: its blocks, system texts (request_id, text) and tools (request_id, name, description, schema_json)."""
    parts = [(blocks, ("text", "tool_input", "result_text"))]
    parts += [(systems, ("text",))] if systems is not None else []
    parts += [(tools, ("name", "description", "schema_json"))] if tools is not None else []
    sizes = None
    for rows, columns in parts:
        size = sum((F.coalesce(X.u16len(F.col(c)), F.lit(0)) for c in columns), F.lit(0)).cast("long")
        own = rows.select("request_id", size.alias("chars"))
        sizes = own if sizes is None else sizes.unionByName(own)
    return sizes.groupBy("request_id").agg(F.sum("chars").alias("chars"))


def recoverable_blocks(blocks: DataFrame) -> DataFrame:
    """Paged blocks with the id by which their text can be asked for again."""
    body = F.coalesce("result_text", "text", F.lit(""))
    ident = F.concat(F.lit("rec_"), X.sha8(F.concat_ws("\x00", "type", F.coalesce("tool_id", F.lit("")), body)))
    return blocks.select("request_id", "msg_idx", "block_idx", ident.alias("id"), F.col("type").alias("kind"), body.alias("text"))


def recoverable_pages(blocks: DataFrame, cols: int, **geometry) -> DataFrame:
    """``recoverable_blocks`` plus pages: how many their text fills as pages of ``cols`` columns."""
    rows = recoverable_blocks(blocks).withColumn("_line", X.packed(F.col("text")))
    return with_page_geometry(rows, "_line", cols, **geometry).withColumn("pages", F.col("geometry.pages")).drop("_line", "geometry")


def recover(recoverable: DataFrame, wanted: DataFrame) -> DataFrame:
    """(request_id, id, kind, text, pages, clash) of the ids asked for (request_id, id): null text where a request has no such block.

    Equal blocks of a request share an id and come once; clash tells an id that stands for
    different texts, of which the first in byte order comes.
    """
    rows = recoverable.groupBy("request_id", "id").agg(F.min(F.struct("text", "kind", "pages")).alias("b"), F.max("text").alias("_last"))
    found = wanted.select("request_id", "id").distinct().join(rows, ["request_id", "id"], "left")
    return found.select("request_id", "id", F.col("b.kind").alias("kind"), F.col("b.text").alias("text"), F.col("b.pages").alias("pages"), F.coalesce(F.col("b.text") != F.col("_last"), F.lit(False)).alias("clash"))
