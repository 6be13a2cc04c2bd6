"""Queries of whole plans and of their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxledger.functions import text as X
from ctxledger.operators import blocks as B
from ctxledger.operators import pairs as R
from ctxledger.operators import pins as N
from ctxledger.operators import planning as L
from ctxledger.operators import usage as U
from ctxledger.plans import activity as E
from ctxledger.plans.cost import _COMPACT, _with_model, load, u16_sql
from ctxledger.plans.dialog import turns


def compaction_plan(spark, sf_dir):
    docs = _with_model(load(spark, sf_dir, "documents")).select(F.col("doc_id").alias("request_id"), "model", "text")
    return L.compaction_plan(docs, bases=("claude", "gpt-5", "grok"))


def plan_reasons(spark, sf_dir):
    return compaction_plan(spark, sf_dir).groupBy("model", "reason").agg(F.count("*").alias("n"), F.sum("saved_tokens").alias("saved_tokens"))


def _messages(spark, sf_dir) -> DataFrame:
    one = lambda kind: F.when((F.col("type") == kind) & F.col("call_id").isNotNull(), F.array("call_id")).otherwise(F.array().cast("array<string>"))
    return E.items(spark, sf_dir).select("request_id", "idx", (F.col("type") == R.CALL).cast("long").alias("uses"), one(R.CALL).alias("opens"), one(R.OUTPUT).alias("closes"))


WIRE, RESULT_LEAST = 9, 1500


def _whole_plans(spark, sf_dir):
    """Sessions as requests: the document of the same number is the static text, those that leave it modulo 150 the tool results."""
    turns_ = history_turns(spark, sf_dir)
    docs = load(spark, sf_dir, "documents")
    model = F.when(F.col("request_id") % 9 == 8, "mistral").when(F.col("request_id") % 2 == 0, "claude-opus-5").otherwise("claude-sonnet-4-5")
    requests = turns_.select("request_id").distinct().join(docs.select(F.col("doc_id").alias("request_id"), "text"), "request_id", "left").withColumn("model", model)
    results = docs.select(F.pmod("doc_id", F.lit(150)).alias("request_id"), F.col("doc_id").alias("idx"), "text", (F.col("doc_id") % 7 == 0).alias("is_error"))
    return L.compaction_plans(requests, turns_, results.where("idx >= 150"), HISTORY, WIRE, least=RESULT_LEAST, bases=("claude",))


def compaction_plans(spark, sf_dir):
    """Whole plans: static text, history and tool results of each request under one count of images."""
    return _whole_plans(spark, sf_dir)[0].drop("passthrough")


def compaction_results(spark, sf_dir):
    return _whole_plans(spark, sf_dir)[2]


def closed_prefix_messages(spark, sf_dir):
    return L.closed_prefix_messages(_messages(spark, sf_dir), 40)


HISTORY = dict(budget=4, page_chars=140, base=4, keep_tail=3, min_prefix=5, snap=6)


def history_turns(spark, sf_dir) -> DataFrame:
    """Events as turns with tool calls, some marked; every fifth session is cold. Calls of reused ids stay open across cuts."""
    i = F.col("idx")
    extra = E.items(spark, sf_dir).select("request_id", "idx", F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat("text", (i % 9).cast("int")).alias("text"), (i % 11 == 4).alias("marked"), (F.col("request_id") % 5 == 0).alias("cold"))
    return _messages(spark, sf_dir).join(extra, ["request_id", "idx"])


def history_plan(spark, sf_dir):
    """Which turns of each session become pages, at which step: closed, trimmed to the budget and closed again, a tighter goal where cold."""
    return L.history_plan(history_turns(spark, sf_dir), **HISTORY)[0]


def history_chunks(spark, sf_dir):
    return L.history_plan(history_turns(spark, sf_dir), **HISTORY)[1]


def chunk_ends(spark, sf_dir):
    return L.chunk_ends(turns(spark, sf_dir).withColumn("marked", F.length("text") % 5 == 0), 3)


def bucket_chars(spark, sf_dir):
    parts = load(spark, sf_dir, "pages").select(F.pmod("page_id", F.lit(20)).alias("request_id"), L.result_bucket(F.col("html")).alias("bucket"), X.u16len(F.coalesce("html", F.lit(""))).alias("chars"))
    out = L.bucket_chars(parts)
    return out.select("request_id", F.explode("bucket_chars").alias("bucket", "chars"))


def page_totals(spark, sf_dir):
    v = F.col("value").cast("long")
    chunks = load(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), (v % 5).alias("pages"), F.lit(1568).alias("width"), (v + 8).alias("height"), (v * 3).alias("tokens"), (v * 100).alias("chars"))
    return L.page_totals(chunks)


def baseline_tokens(spark, sf_dir):
    v = F.col("value").cast("long")
    return L.baseline_tokens(load(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), v.alias("system_tokens"), (v * F.pmod("user_id", F.lit(3))).alias("tools_before"), v.alias("tools_after")))


def verbatim_tasks(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", L.verbatim_task(F.coalesce("text", F.lit(""))).alias("task"))
    return docs.select("doc_id", X.u16len(F.col("task")).alias("units"), X.sha8(F.col("task")).alias("sha8"))


def request_outcomes(spark, sf_dir):
    """Requests with their responses: every event asks, all but sign-ups are answered."""
    e = load(spark, sf_dir, "events")
    asked = e.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("session"))
    status = F.when((F.col("event_type") == "error") & (F.col("value") < 5), 413).when(F.col("event_type") == "error", 500).otherwise(200)
    answers = e.where("event_type <> 'signup'").select(F.col("event_id").alias("request_id"), status.alias("status"), U.is_size_rejection(status, F.lit("")).alias("too_large"))
    return U.request_outcomes(asked, answers)


def unreferenced(spark, sf_dir):
    items = E.items(spark, sf_dir)
    refs = items.where(F.col("idx") % 7 == 0).select("request_id", F.col("call_id").alias("ref_id")).dropna()
    return R.unreferenced(items.where("call_id is not null"), refs).groupBy("request_id").agg(F.count("*").alias("free"))


def token_composition(spark, sf_dir):
    """Items with roles put in by index, and requests with instructions and tools."""
    i = F.col("idx")
    role = F.when(F.col("call_id").isNull(), F.when(i % 5 == 0, "system").when(i % 5 == 1, "user").when(i % 5 == 2, "assistant"))
    whole = F.concat(F.lit('{"type":"'), F.col("type"), F.lit('","text":'), F.to_json(F.array("text")), F.lit("}"))
    items = E.items(spark, sf_dir).withColumns({"role": role, "images": (i % 11 == 0).cast("int"), "json": whole})
    requests = items.groupBy("request_id").agg(F.max("type").alias("instructions"), F.min("type").alias("tools"))
    return R.token_composition(items, requests)


def collapsible_units(spark, sf_dir):
    items = E.items(spark, sf_dir)
    return R.collapsible_units(items, R.tool_rounds(items), 6, 6).select("request_id", "idx", "type")


def normalized_dialog(spark, sf_dir):
    t = turns(spark, sf_dir)
    messages = t.where("conv_id % 2 = 0").select(F.col("conv_id").alias("request_id"), "idx", "role", "text")
    kind = F.when(F.col("idx") % 3 == 2, "function_call").otherwise("message")
    items = t.where("conv_id % 2 = 1").select(F.col("conv_id").alias("request_id"), "idx", "role", kind.alias("type"), "text")
    return B.normalize_dialog(messages, items)


def command_turns(spark, sf_dir):
    t = turns(spark, sf_dir).withColumn("text", F.when(F.col("idx") % 3 == 0, F.concat(F.lit(N.MARKER + " pin x\n\n"), F.when(F.col("idx") % 2 == 0, F.lit("")).otherwise(F.col("text")))).otherwise(F.col("text")))
    return N.command_turns(t).select("conv_id", "idx", F.col("commands").cast("long").alias("commands"), "only_commands")


QUERIES = {f.__name__: f for f in (compaction_plan, plan_reasons, compaction_plans, compaction_results, closed_prefix_messages, history_plan, history_chunks, chunk_ends, bucket_chars, page_totals, baseline_tokens, verbatim_tasks, request_outcomes, unreferenced, token_composition, collapsible_units, normalized_dialog, command_turns)}
_HISTORY = f"""WITH {E._ITEMS},
 k AS (SELECT *, (type = 'function_call')::INT AS uses, CASE WHEN type = 'function_call' THEN 1 WHEN type = 'function_call_output' THEN -1 END AS kind, CASE WHEN idx % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, repeat(text, (idx % 9)::INT) AS body FROM items),
 b AS (SELECT *, CASE WHEN call_id IS NOT NULL AND kind <> lag(kind, 1, -1) OVER (PARTITION BY request_id, call_id ORDER BY idx) THEN kind ELSE 0 END AS delta FROM k),
 c AS (SELECT *, sum(delta) OVER w AS open FROM b WINDOW w AS (PARTITION BY request_id ORDER BY idx)),
 d AS (SELECT *, coalesce(lag(open) OVER w, 0) AS before, coalesce(lead(uses) OVER w, 0) AS nu FROM c WINDOW w AS (PARTITION BY request_id ORDER BY idx)),
 e AS (SELECT *, max(CASE WHEN uses = 0 AND before = 0 THEN idx END) OVER w AS k1, max(CASE WHEN uses > 0 THEN idx END) OVER w AS j1 FROM d WINDOW w AS (PARTITION BY request_id ORDER BY idx)),
 f AS (SELECT *, open = 0 AND (NOT coalesce(j1 > coalesce(k1, -1), false) OR nu = 0) AS closed, CASE WHEN body <> '' THEN length(body) + 14 + 2 * length(role) + length(idx::VARCHAR) ELSE 0 END AS tc, CASE WHEN role = 'user' AND length(body) > 2000 THEN length(body) + 20 ELSE 0 END AS ic,
   max(idx) OVER (PARTITION BY request_id) + 1 - 3 AS raw FROM e),
 g AS (SELECT *, least(raw, greatest(floor(raw / 6.0)::BIGINT * 6, 5)) AS cutoff, sum(tc) OVER w AS tt, sum(ic) OVER w AS it FROM f WINDOW w AS (PARTITION BY request_id ORDER BY idx)),
 h AS (SELECT *, coalesce(max(CASE WHEN closed AND idx < cutoff THEN idx + 1 END) OVER (PARTITION BY request_id), 0) AS len FROM g),
 i AS (SELECT *, ceil(coalesce(max(CASE WHEN idx < len THEN tt END) OVER p, 0) / {HISTORY['page_chars']}.0) + ceil(coalesce(max(CASE WHEN idx < len THEN it END) OVER p, 0) / {HISTORY['page_chars']}.0) > {HISTORY['budget']} AS over, count(*) FILTER (idx < len AND tt + it <= {HISTORY['budget'] * HISTORY['page_chars']}) OVER p AS fit FROM h WINDOW p AS (PARTITION BY request_id)),
 j AS (SELECT *, coalesce(max(CASE WHEN closed AND idx < fit THEN idx + 1 END) OVER (PARTITION BY request_id), 0) AS again FROM i),
 r AS (SELECT request_id, count(*) AS turns, CASE WHEN max(len) = 0 THEN 'no_closed_prefix' WHEN max(len) < 5 THEN 'prefix_too_short' WHEN bool_or(over) AND max(again) < 5 THEN 'over_budget' END AS reason, bool_or(over) AS over, CASE WHEN bool_or(over) THEN max(again) ELSE max(len) END AS cl FROM j GROUP BY request_id),
 s AS (SELECT request_id, turns, reason, CASE WHEN reason IS NULL THEN cl ELSE 0 END AS collapse_len, reason IS NULL AND over AS trimmed FROM r),
 t AS (SELECT j.*, s.reason, collapse_len, trimmed, turns, idx % 11 = 4 AS marked FROM j JOIN s USING (request_id)),
 a AS (SELECT request_id, max(turns) AS turns, max(reason) AS r0, max(collapse_len) AS collapse_len, bool_or(trimmed) AS trimmed, coalesce(max(CASE WHEN idx < collapse_len THEN tt END), 0)::BIGINT AS text_chars FROM t GROUP BY request_id),
 a2 AS (SELECT *, coalesce(r0, CASE WHEN text_chars = 0 THEN 'render_empty' ELSE 'collapsed' END) AS reason FROM a),
 m AS (SELECT t.request_id, t.idx, t.tc, t.ic, t.marked, a2.collapse_len FROM t JOIN a2 USING (request_id) WHERE a2.reason = 'collapsed' AND idx < a2.collapse_len),
 n AS (SELECT request_id, max(collapse_len) AS rng, count(*) FILTER (marked) AS markers, CASE WHEN request_id % 5 = 0 THEN least({HISTORY['budget']}, greatest(1, ceil(sum(tc) / {HISTORY['page_chars']}.0)) + 1) ELSE {HISTORY['budget']} END::BIGINT AS goal FROM m GROUP BY request_id),
 o AS (SELECT m.request_id, rng, markers, goal, st, idx // st AS cell, ceil(sum(tc) / {HISTORY['page_chars']}.0) + ceil(sum(ic) / {HISTORY['page_chars']}.0) AS pg FROM m JOIN n USING (request_id), (SELECT (4 * 2 ** x)::BIGINT AS st FROM (SELECT unnest(range(13))::INT AS x)) GROUP BY ALL),
 q AS (SELECT request_id, rng, markers, goal, st, sum(pg)::BIGINT AS pages FROM o GROUP BY ALL),
 u AS (SELECT request_id, min(st)::BIGINT AS step, min_by(pages, st) AS pages, min(markers) AS markers, min(goal) AS goal FROM q WHERE st >= rng OR pages + markers <= goal GROUP BY request_id)"""
_WHOLE = f"""
h AS ({_HISTORY} SELECT request_id, reason AS history_reason, CASE WHEN reason = 'collapsed' THEN pages ELSE 0 END AS hp, CASE WHEN reason = 'collapsed' THEN text_chars ELSE 0 END AS hc FROM a2 LEFT JOIN u USING (request_id)),
doc AS (SELECT doc_id, {u16_sql(_COMPACT.format("coalesce(text, '')"))}::BIGINT AS chars FROM documents),
dr AS (SELECT *, greatest(1, ceil(chars / 312.0))::BIGINT AS nrows FROM doc),
dp AS (SELECT *, ceil(nrows / 90.0)::BIGINT AS np, ceil((((nrows - 1) // 90) * ceil(1568 / 28.0) * ceil(728 / 28.0) + ceil(1568 / 28.0) * ceil((8 + ((nrows - 1) % 90 + 1) * 8) / 28.0))::DOUBLE * 1.10::DOUBLE) AS image FROM dr),
rq AS (SELECT DISTINCT user_id AS request_id, CASE WHEN user_id % 9 = 8 THEN 'mistral' WHEN user_id % 2 = 0 THEN 'claude-opus-5' ELSE 'claude-sonnet-4-5' END AS model FROM events),
sl AS (SELECT request_id, model, coalesce(chars, 0) AS chars, coalesce(np, 0) AS np, coalesce(image, 0) AS image, CASE WHEN model = 'mistral' THEN 'unsupported_model' WHEN coalesce(chars, 0) = 0 THEN 'no_static_context' WHEN chars < 2000 THEN 'below_min_chars' WHEN NOT image < chars / 2.0 THEN 'not_profitable' ELSE 'applied' END AS reason FROM rq LEFT JOIN dp ON doc_id = request_id),
bs AS (SELECT sl.*, CASE WHEN model = 'mistral' THEN 'unsupported_model' ELSE coalesce(history_reason, 'no_history') END AS history_reason, CASE WHEN model = 'mistral' THEN 0 ELSE coalesce(hp, 0) END AS hp, CASE WHEN model = 'mistral' THEN 0 ELSE coalesce(hc, 0) END AS hc, CASE WHEN reason = 'applied' THEN np ELSE 0 END AS sp FROM sl LEFT JOIN h USING (request_id)),
rs AS (SELECT bs.request_id, doc_id AS idx, dp.np AS pages, dp.chars, chars / 4.0 - dp.image AS saved, greatest(0, {WIRE} - sp - hp) AS room, CASE WHEN model = 'mistral' THEN 'unsupported_model' WHEN doc_id % 7 = 0 THEN 'is_error' WHEN dp.chars < {RESULT_LEAST} THEN 'below_threshold' WHEN NOT dp.image < dp.chars / 4.0 THEN 'not_profitable' ELSE 'candidate' END AS reason
  FROM (SELECT request_id, model, sp, hp FROM bs) bs JOIN dp ON doc_id % 150 = request_id AND doc_id >= 150),
cd AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY idx) AS o FROM rs WHERE reason = 'candidate'),
ad(request_id, o, idx, room, took) AS (
  SELECT request_id, o, idx, room - CASE WHEN pages <= room THEN pages ELSE 0 END, pages <= room FROM cd WHERE o = 1
  UNION ALL SELECT cd.request_id, cd.o, cd.idx, ad.room - CASE WHEN cd.pages <= ad.room THEN cd.pages ELSE 0 END, cd.pages <= ad.room FROM ad JOIN cd ON cd.request_id = ad.request_id AND cd.o = ad.o + 1),
fin AS (SELECT rs.*, CASE WHEN took THEN 'paged' WHEN reason = 'candidate' THEN 'image_budget' ELSE reason END AS why FROM rs LEFT JOIN ad USING (request_id, idx))"""
ORACLES = {
    "compaction_results": f"WITH RECURSIVE {_WHOLE} SELECT request_id, idx, pages, why AS reason FROM fin",
    "compaction_plans": f"""WITH RECURSIVE {_WHOLE},
        su AS (SELECT request_id, count(*) AS n, sum(pages)::BIGINT AS pages, sum(chars)::BIGINT AS chars, sum(saved) AS saved FROM fin WHERE why = 'paged' GROUP BY request_id)
        SELECT request_id, model, reason, history_reason, sp AS static_pages, CASE WHEN reason = 'applied' THEN bs.chars ELSE 0 END AS static_chars, hp AS history_pages, hc AS history_chars, coalesce(n, 0) AS results_paged, coalesce(su.pages, 0) AS result_pages, coalesce(su.chars, 0) AS result_chars,
          sp + hp + coalesce(su.pages, 0) AS pages, (CASE WHEN reason = 'applied' THEN bs.chars / 2.0 - bs.image ELSE 0 END + coalesce(saved, 0))::DOUBLE AS saved_tokens FROM bs LEFT JOIN su USING (request_id)""",
    "history_plan": f"{_HISTORY} SELECT request_id, reason, turns, collapse_len, trimmed, text_chars, step, pages, markers, goal FROM a2 LEFT JOIN u USING (request_id)",
    "history_chunks": f"""{_HISTORY}, v AS (SELECT m.*, (idx + 1) % step = 0 OR marked OR idx = collapse_len - 1 AS fin FROM m JOIN u USING (request_id)),
        w AS (SELECT *, sum(fin::INT) OVER (PARTITION BY request_id ORDER BY idx) - fin::INT AS chunk FROM v)
        SELECT request_id, min(idx) AS from_idx, max(idx) AS to_idx, sum(tc)::BIGINT AS text_chars FROM w GROUP BY request_id, chunk""",
    "closed_prefix_messages": f"""WITH {E._ITEMS},
        k AS (SELECT *, (type = 'function_call')::INT AS uses, CASE WHEN type = 'function_call' THEN 1 WHEN type = 'function_call_output' THEN -1 END AS kind FROM items),
        b AS (SELECT *, CASE WHEN call_id IS NOT NULL AND kind <> lag(kind, 1, -1) OVER (PARTITION BY request_id, call_id ORDER BY idx) THEN kind ELSE 0 END AS delta FROM k),
        c AS (SELECT *, sum(delta) OVER w AS open FROM b WINDOW w AS (PARTITION BY request_id ORDER BY idx)),
        d AS (SELECT *, coalesce(lag(open) OVER w, 0) AS before, coalesce(lead(uses) OVER w, 0) AS nu FROM c WINDOW w AS (PARTITION BY request_id ORDER BY idx)),
        e AS (SELECT *, max(CASE WHEN uses = 0 AND before = 0 THEN idx END) OVER w AS k1, max(CASE WHEN uses > 0 THEN idx END) OVER w AS j1 FROM d WINDOW w AS (PARTITION BY request_id ORDER BY idx))
        SELECT request_id, coalesce(max(idx) FILTER (open = 0 AND (NOT coalesce(j1 > coalesce(k1, -1), false) OR nu = 0) AND idx < 40), -1) AS closed_prefix FROM e GROUP BY request_id""",
    "chunk_ends": """WITH e AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
        SELECT conv_id, coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) + 1, 0) AS from_idx, turn AS to_idx FROM e WHERE (turn + 1) % 3 = 0 OR length(text) % 5 = 0 OR turn = last""",
    "bucket_chars": f"""SELECT page_id % 20 AS request_id, 'tool_result_prose' AS bucket, sum({u16_sql("coalesce(html, '')")})::BIGINT AS chars FROM pages GROUP BY 1""",
    "page_totals": "SELECT user_id AS request_id, sum(trunc(value)::BIGINT % 5)::BIGINT AS pages, sum(trunc(value)::BIGINT % 5 * 1568 * (trunc(value)::BIGINT + 8))::BIGINT AS pixels, sum(trunc(value)::BIGINT * 3)::BIGINT AS tokens, sum(trunc(value)::BIGINT * 100)::BIGINT AS chars FROM events GROUP BY user_id",
    "baseline_tokens": "SELECT user_id AS request_id, (sum(trunc(value)::BIGINT) + greatest(0, sum(trunc(value)::BIGINT * (user_id % 3)) - sum(trunc(value)::BIGINT)))::BIGINT AS baseline_tokens FROM events GROUP BY user_id",
    "verbatim_tasks": """WITH t AS (SELECT doc_id, trim(coalesce(text, ''), ' ') AS t FROM documents),
        v AS (SELECT doc_id, CASE WHEN length(t) <= 4000 THEN t ELSE left(t, 2600) || chr(10) || '[… middle elided (' || (length(t) - 4000) || ' chars) …]' || chr(10) || right(t, 1400) END AS v FROM t)
        SELECT doc_id, length(v)::BIGINT AS units, left(sha256(v), 8) AS sha8 FROM v""",
    "request_outcomes": """SELECT event_id AS request_id, user_id AS session, CASE WHEN event_type = 'signup' THEN NULL WHEN event_type = 'error' THEN CASE WHEN value < 5 THEN 413 ELSE 500 END ELSE 200 END AS status,
        CASE WHEN event_type <> 'signup' THEN event_type = 'error' AND value < 5 END AS too_large FROM events""",
    "unreferenced": f"""WITH {E._ITEMS}, r AS (SELECT DISTINCT request_id, call_id FROM items WHERE idx % 7 = 0 AND call_id IS NOT NULL)
        SELECT request_id, count(*) AS free FROM items WHERE call_id IS NOT NULL AND (request_id, call_id) NOT IN (SELECT request_id, call_id FROM r) GROUP BY request_id""",
    "token_composition": f"""WITH {E._ITEMS},
        r AS (SELECT *, CASE WHEN call_id IS NULL THEN CASE idx % 5 WHEN 0 THEN 'system' WHEN 1 THEN 'user' WHEN 2 THEN 'assistant' END END AS role, {u16_sql("coalesce(text, '')")} AS n,
            length('{{"type":"' || type || '","text":["' || replace(text, '"', '\\"') || '"]}}') AS z FROM items),
        s AS (SELECT request_id, CASE WHEN role = 'system' THEN 'system_developer' WHEN role IS NOT NULL THEN 'user_assistant' WHEN type = 'function_call' THEN 'function_calls' WHEN type = 'function_call_output' THEN 'function_outputs'
            WHEN type = 'reasoning' THEN 'reasoning' WHEN type IN ('compaction', 'compaction_trigger', 'context_compaction', 'item_reference') THEN 'compaction' ELSE 'other' END AS spent, CASE WHEN role IS NULL AND type <> 'function_call_output' THEN z ELSE n END AS n, (idx % 11 = 0)::INT AS images FROM r
          UNION ALL SELECT request_id, 'instructions', length(max(type)), 0 FROM items GROUP BY request_id UNION ALL SELECT request_id, 'tools', length(min(type)), 0 FROM items GROUP BY request_id)
        SELECT request_id, {", ".join(f"coalesce(sum(n) FILTER (spent = '{c}'), 0)::BIGINT AS {c}" for c in ("instructions", "system_developer", "user_assistant", "function_calls", "function_outputs", "reasoning", "compaction", "tools", "other"))},
          sum(n)::BIGINT AS total, sum(images)::BIGINT AS image_parts FROM s GROUP BY request_id""",
    "collapsible_units": f"""WITH {E._ROUNDS}, f AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY idx DESC) AS rn FROM items)
        SELECT f.request_id, f.idx, f.type FROM f JOIN recent o ON f.request_id = o.request_id AND NOT o.recent AND f.idx > o.end_idx - o.calls AND f.idx <= o.end_idx + o.calls WHERE rn > 6""",
    "normalized_dialog": """SELECT conv_id AS request_id, turn AS idx, CASE WHEN conv_id % 2 = 1 AND turn % 3 = 2 THEN 'assistant' WHEN role IN ('system', 'developer') THEN 'system' ELSE role END AS role,
        CASE WHEN conv_id % 2 = 1 AND turn % 3 = 2 THEN '' ELSE coalesce(text, '') END AS text FROM conversations""",
    "command_turns": "SELECT conv_id, turn AS idx, 1::BIGINT AS commands, turn % 2 = 0 AS only_commands FROM conversations WHERE turn % 3 = 0",
}
