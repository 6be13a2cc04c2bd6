"""Queries over request bodies built from conversations, tools built from parts, pins, layout and token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxledger.functions import layout, tokens
from ctxledger.functions import text as X
from ctxledger.operators import blocks as B
from ctxledger.operators import history as H
from ctxledger.operators import pins as N
from ctxledger.operators import system as Y
from ctxledger.operators import tools as D
from ctxledger.plans.cost import load, u16_sql
from ctxledger.plans.dialog import turns
from ctxledger.sources.io import with_model


def bodies(spark, sf_dir) -> DataFrame:
    """A Messages body per conversation; odd turns hold their text in a block, users' also a tool result."""
    t = turns(spark, sf_dir)
    text = F.to_json(F.struct(F.col("text").alias("v")))
    text = F.substring(text, F.lit(6), F.length(text) - 6)
    block = F.concat(F.lit('[{"type":"text","text":'), text, F.lit(',"cache_control":{"type":"ephemeral"}},{"type":"tool_result","tool_use_id":"t'), F.col("idx").cast("string"), F.lit('","is_error":true,"content":[{"type":"text","text":"ok"},{"type":"image","source":{"data":"QUJDRA=="}}]}]'))
    content = F.when(F.col("idx") % 2 == 1, block).otherwise(text)
    message = F.concat(F.lit('{"role":"'), F.col("role"), F.lit('","content":'), content, F.lit("}"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", message.alias("m")))), lambda x: x["m"]), ",")
    made = t.groupBy("conv_id").agg(joined.alias("m"))
    body = F.concat(F.lit('{"model":"claude-opus-5[1m]","messages":['), F.col("m"), F.lit("]}"))
    return with_model(made.select(F.col("conv_id").alias("request_id"), F.lit("/v1/messages").alias("path"), body.alias("body")))


def explode_messages(spark, sf_dir):
    return B.explode_messages(bodies(spark, sf_dir)).select("request_id", "idx", "role", "content_is_array", "text")


def explode_blocks(spark, sf_dir):
    return B.explode_blocks(B.explode_messages(bodies(spark, sf_dir))).select("request_id", "msg_idx", "block_idx", "role", "type", "text", "result_text", "is_error")


def message_texts(spark, sf_dir):
    return B.transcript_text(B.explode_blocks(B.explode_messages(bodies(spark, sf_dir))))


def native_images(spark, sf_dir):
    return B.native_images(B.explode_blocks(B.explode_messages(bodies(spark, sf_dir))))


def outgoing_chars(spark, sf_dir):
    return B.outgoing_chars(B.explode_blocks(B.explode_messages(bodies(spark, sf_dir))))


def cache_markers(spark, sf_dir):
    return bodies(spark, sf_dir).select("request_id", "protocol", "model", B.cache_markers(F.col("body")).alias("markers"))


def recoverable_blocks(spark, sf_dir):
    return B.recoverable_blocks(B.explode_blocks(B.explode_messages(bodies(spark, sf_dir)))).select("request_id", "msg_idx", "block_idx", "id", "kind")


def explode_items(spark, sf_dir):
    """Responses bodies: bare strings for even conversations, item lists for odd ones."""
    t = turns(spark, sf_dir)
    item = F.struct(F.lit("message").alias("type"), F.col("role").alias("role"), F.col("text").alias("content"))
    made = t.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", item.alias("i")))), lambda x: x["i"]).alias("input"))
    body = F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(F.col("input")[0]["content"].alias("input")))).otherwise(F.to_json(F.struct("input")))
    return B.explode_items(made.select(F.col("conv_id").alias("request_id"), body.alias("body"))).select("request_id", "idx", "type", "role", "text")


def _system(spark, sf_dir) -> DataFrame:
    other = F.when(F.col("doc_id") % 3 == 0, F.lit("<context>Platform: elsewhere\nWorking directory: /other</context>\n# Environment\nmoves\n## Rest\n")).otherwise("")
    head = F.concat(F.lit("x-anthropic-billing-header: v\nBe brief.\n"), other, F.lit("<env>\nWorking directory: /srv/"), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, F.lit("\nPlatform: linux")).otherwise(""), F.lit("\nIs directory a git repo: Yes\nOn branch b"), F.col("doc_id").cast("string"), F.lit("\n</env>\n\n\n\n<notes>"), F.col("source"), F.lit("</notes>\n<rules>be kind</rules>"))
    return load(spark, sf_dir, "documents").select("doc_id", "lang", "source", head.alias("system"))


def split_system(spark, sf_dir):
    s = F.col("system")
    env = Y.env_fields(Y.dynamic_text(s))
    return _system(spark, sf_dir).select("doc_id", F.size(Y.dynamic_blocks(s)).alias("dynamic"), Y.static_text(s).alias("static"), env["cwd"].alias("cwd"), env["branch"].alias("branch"), env["platform"].alias("platform"), env["today"].alias("today"), X.sha8(Y.dynamic_text(s)).alias("dynamic_sha8"), F.array_join(Y.unknown_tags(s), ",").alias("unknown"))


def _tools(spark, sf_dir) -> DataFrame:
    schema = F.concat(F.lit('{"type":"object","properties":{"description":{"type":"string","description":"'), F.col("p_type"), F.lit('"}},"title":"'), F.col("p_brand"), F.lit('"}'))
    return load(spark, sf_dir, "part").select(
        F.pmod("p_partkey", F.lit(50)).alias("request_id"), F.col("p_partkey").alias("tool_idx"), F.col("p_brand").alias("name"), F.lit(None).cast("string").alias("type"),
        (F.col("p_partkey") % 9 == 0).alias("defer_loading"), F.col("p_name").alias("description"), schema.alias("schema_json"),
    )


def tool_docs(spark, sf_dir):
    return D.tool_docs(_tools(spark, sf_dir))


def tool_rewrite(spark, sf_dir):
    return D.rewrite_plan(_tools(spark, sf_dir)).select("request_id", "tool_idx", "name", "stripped", F.col("chars_before").cast("long").alias("chars_before"), F.col("chars_after").cast("long").alias("chars_after"))


def tool_annotations(spark, sf_dir):
    t = _tools(spark, sf_dir)
    return t.select("request_id", "tool_idx", D.annotated_doc(F.col("name"), F.when(F.col("tool_idx") % 3 > 0, F.col("description")), F.col("schema_json")).alias("doc"))


def tool_catalog(spark, sf_dir):
    return D.tool_catalog(_tools(spark, sf_dir))


def pins(spark, sf_dir):
    """Commands put into users' turns by index: each pins a word of its turn, every fifth unpins the first."""
    line = F.when(F.col("idx") % 5 == 4, "unpin 1").otherwise(F.concat(F.lit("pin "), F.coalesce(F.element_at(F.split("text", " "), 1), F.lit("x"))))
    return N.standing_instructions(turns(spark, sf_dir).withColumn("text", F.concat(F.col("text"), F.lit("\n" + N.MARKER + " "), line)))


def page_geometry(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", X.packed(F.col("text")).alias("packed"))
    return layout.with_page_geometry(docs, "packed", 312, "g").select("doc_id", "g.rows", "g.pages", "g.last_rows", "g.width", "g.height")


def bpe_count(spark, sf_dir):
    """Token counts with ranks made from the corpus: its most frequent words as whole tokens (a stand-in for a user's file)."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    pair = F.explode(F.array_distinct(F.transform(F.filter(F.split("text", "[^a-z]+"), lambda w: F.length(w) >= 2), lambda w: F.substring(w, 1, 2))))
    ranks = docs.select(pair.alias("w")).groupBy("w").count().select(F.col("w").cast("binary").alias("token"), F.dense_rank().over(_by_count()).cast("long").alias("rank"))
    return tokens.bpe_count(docs, ranks)


def _by_count():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("count"), "w")  # at most 26 * 26 rows


def token_sections(spark, sf_dir):
    rows = turns(spark, sf_dir).select("conv_id", "idx", X.piece_count(F.coalesce("text", F.lit(""))).alias("tokens"), F.lit(0).alias("open_calls"), (F.col("idx") % 4 == 3).alias("pinned"))
    return tokens.token_sections(rows, 100)


def prefix_fit(spark, sf_dir):
    costs = H.turn_costs(turns(spark, sf_dir)).select(F.col("conv_id").alias("request_id"), F.floor(F.col("idx") / 3).alias("run"), "idx", "text_cost")
    from pyspark.sql import Window

    upto = Window.partitionBy("request_id", "run").orderBy("idx")
    return tokens.prefix_fit(costs.withColumn("pages", F.ceil(F.sum("text_cost").over(upto) / 500)), 5)


QUERIES = {f.__name__: f for f in (explode_messages, explode_blocks, message_texts, native_images, outgoing_chars, cache_markers, recoverable_blocks, explode_items, split_system, tool_docs, tool_rewrite, tool_annotations, tool_catalog, pins, page_geometry, bpe_count, token_sections, prefix_fit)}
_DOC = """'## Tool: ' || p_brand || chr(10) || p_name || chr(10) || '```json' || chr(10) || '{"type":"object","properties":{"description":{"type":"string","description":"' || p_type || '"}},"title":"' || p_brand || '"}' || chr(10) || '```'"""
_T = """t AS (SELECT p_partkey % 50 AS request_id, p_partkey AS tool_idx, p_brand AS name, p_name, '{"type":"object","properties":{"description":{"type":"string","description":"' || p_type || '"}},"title":"' || p_brand || '"}' AS s,
  '{"type":"object","properties":{"description":{"type":"string"}}}' AS z FROM part WHERE p_partkey % 9 <> 0),
p AS (SELECT *, (length(p_name) + length(s))::BIGINT AS chars_before, (length('Full docs: see "## Tool: ' || name || '" in the tool reference.') + length(z))::BIGINT AS chars_after FROM t)"""
ORACLES = {
    "explode_messages": "SELECT conv_id AS request_id, turn AS idx, role, turn % 2 = 1 AS content_is_array, CASE WHEN turn % 2 = 0 THEN text END AS text FROM conversations",
    "explode_blocks": """SELECT conv_id AS request_id, turn AS msg_idx, 0 AS block_idx, role, 'text' AS type, text, NULL AS result_text, false AS is_error FROM conversations
        UNION ALL SELECT conv_id, turn, 1, role, 'tool_result', NULL, 'ok', true FROM conversations WHERE turn % 2 = 1""",
    "message_texts": "SELECT conv_id AS request_id, turn AS msg_idx, role, CASE WHEN turn % 2 = 0 THEN text ELSE text || chr(10) || chr(10) || '[tool_result (error)]' || chr(10) || 'ok' END AS text FROM conversations",
    "native_images": "SELECT conv_id AS request_id, count(*) FILTER (turn % 2 = 1) AS images, count(*) FILTER (turn % 2 = 1) * 4 AS bytes FROM conversations GROUP BY conv_id",
    "outgoing_chars": f"SELECT conv_id AS request_id, (sum({u16_sql('text')}) + 2 * count(*) FILTER (turn % 2 = 1))::BIGINT AS chars FROM conversations GROUP BY conv_id",
    "cache_markers": "SELECT conv_id AS request_id, 'messages' AS protocol, 'claude-opus-5[1m]' AS model, count(*) FILTER (turn % 2 = 1) AS markers FROM conversations GROUP BY conv_id",
    "recoverable_blocks": """SELECT conv_id AS request_id, turn AS msg_idx, 0 AS block_idx, 'rec_' || left(sha256('text' || chr(0) || '' || chr(0) || text), 8) AS id, 'text' AS kind FROM conversations
        UNION ALL SELECT conv_id, turn, 1, 'rec_' || left(sha256('tool_result' || chr(0) || 't' || turn || chr(0) || 'ok'), 8), 'tool_result' FROM conversations WHERE turn % 2 = 1""",
    "explode_items": """SELECT conv_id AS request_id, turn AS idx, 'message' AS type, role, text FROM conversations WHERE conv_id % 2 = 1
        UNION ALL SELECT conv_id, 0, 'message', 'user', arg_min(text, turn) FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id""",
    "split_system": """WITH e AS (SELECT *, '<env>' || chr(10) || 'Working directory: /srv/' || lang || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Platform: linux' ELSE '' END || chr(10) || 'Is directory a git repo: Yes' || chr(10) || 'On branch b' || doc_id || chr(10) || '</env>' AS env FROM documents)
        SELECT doc_id, 1 + (doc_id % 3 = 0)::INT AS dynamic, 'Be brief.' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '## Rest' || chr(10) ELSE '' END || chr(10) || '<notes>' || source || '</notes>' || chr(10) || '<rules>be kind</rules>' AS static, '/srv/' || lang AS cwd, 'b' || doc_id AS branch,
          CASE WHEN doc_id % 2 = 0 THEN 'linux' END AS platform, NULL AS today, left(sha256(CASE WHEN doc_id % 3 = 0 THEN '<context>Platform: elsewhere' || chr(10) || 'Working directory: /other</context>' || chr(10) ELSE '' END || env || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '# Environment' || chr(10) || 'moves' ELSE '' END), 8) AS dynamic_sha8, 'notes' AS unknown FROM e""",
    "tool_docs": f"SELECT p_partkey % 50 AS request_id, string_agg({_DOC}, chr(10) || chr(10) ORDER BY p_partkey) AS docs FROM part WHERE p_partkey % 9 <> 0 GROUP BY 1",
    "tool_rewrite": f"WITH {_T} SELECT request_id, tool_idx, name, z AS stripped, chars_before, chars_after FROM p",
    "tool_catalog": f"WITH {_T} SELECT name, sha256(s) AS schema_sha, count(DISTINCT request_id) AS requests, max(chars_before) AS doc_chars, sum(chars_before - chars_after)::BIGINT AS saved_chars FROM p GROUP BY name, s",
    "tool_annotations": """SELECT p_partkey % 50 AS request_id, p_partkey AS tool_idx, '## Tool: ' || p_brand || CASE WHEN p_partkey % 3 > 0 THEN chr(10) || p_name ELSE '' END
        || chr(10) || '$ title: "' || p_brand || '"' || chr(10) || '$.description description: "' || p_type || '"' AS doc FROM part""",
    "page_geometry": rf"""WITH m AS (SELECT doc_id, {u16_sql(r"regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+(\n|\z)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS n FROM documents),
        r AS (SELECT doc_id, greatest(1, ceil(n / 312.0))::BIGINT AS rows FROM m), p AS (SELECT *, ceil(rows / 89.0)::BIGINT AS pages FROM r)
        SELECT doc_id, rows, pages, rows - (pages - 1) * 89 AS last_rows, 1568 AS width, 8 + 8 * (rows - (pages - 1) * 89) AS height FROM p""",
}
