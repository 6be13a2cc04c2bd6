"""Queries over the events table, read as tool items, session events and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctxledger.operators import pairs as R
from ctxledger.operators import sessions as S
from ctxledger.operators import usage as U

KEEP, CUTOFF = 6, 40


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def items(spark, sf_dir) -> DataFrame:
    """Per user in order: errors are opaque, sign-ups messages, the others calls and outputs in turn."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    kind = F.when(F.col("event_type") == "error", "reasoning").when(F.col("event_type") == "signup", "message").when(F.col("idx") % 2 == 0, R.CALL).otherwise(R.OUTPUT)
    rows = events(spark, sf_dir).withColumn("idx", n.cast("long")).withColumn("type", kind)
    call = F.when(F.col("type").isin(R.CALL, R.OUTPUT), F.concat(F.lit("c"), F.pmod(F.floor(F.col("idx") / 2), F.lit(40)).cast("string")))
    return rows.select(F.col("user_id").alias("request_id"), "idx", "type", call.alias("call_id"), F.col("props").alias("text"))


def session_events(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    kind = F.when(F.col("event_type").isin("view", "signup"), "request").when(F.col("event_type") == "error", "rejection").otherwise("outcome")
    read = F.when(F.col("event_type") == "click", F.col("value").cast("long")).when(F.col("event_type") == "purchase", F.lit(0).cast("long"))
    return e.select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"), read.alias("cache_read"), F.when(read.isNotNull(), F.lit(0).cast("long")).alias("cache_create"), F.floor("value").alias("step"), "event_type", "value", "props")


def outcomes(spark, sf_dir) -> DataFrame:
    e, v = events(spark, sf_dir), F.col("value").cast("long")
    usage = F.col("event_type") != "signup"
    return e.select(
        F.col("event_id").alias("request_id"), "ts", F.col("event_type").alias("endpoint"), F.concat(F.lit("m"), F.pmod("user_id", F.lit(3)).cast("string")).alias("model"),
        F.when(usage, v * 3).alias("input_tokens"), F.when(usage, F.when(F.col("event_type") == "click", v).otherwise(0)).cast("long").alias("cache_creation_input_tokens"),
        F.when(usage, F.when(F.col("event_type") == "view", v).otherwise(0)).cast("long").alias("cache_read_input_tokens"),
        (F.col("event_id") % 4 != 0).alias("applied"), F.when(F.col("event_id") % 3 == 0, v * 7).otherwise(0).cast("long").alias("baseline_tokens"),
        F.when(F.col("event_id") % 3 == 0, v).otherwise(0).cast("long").alias("image_tokens"), F.lit(1).cast("long").alias("native_tokens"),
        F.when(F.col("event_id") % 5 == 0, 0).otherwise(v * 40).cast("long").alias("chars"), (v * 700).cast("long").alias("pixels"),
    )


def pair_calls(spark, sf_dir):
    return R.pair_calls(items(spark, sf_dir))


def tool_rounds(spark, sf_dir):
    return R.recent_rounds(R.tool_rounds(items(spark, sf_dir)), KEEP)


def pair_state(spark, sf_dir):
    return R.pair_state(items(spark, sf_dir), KEEP)


def closed_prefix(spark, sf_dir):
    return R.closed_prefix(items(spark, sf_dir), CUTOFF)


def composition(spark, sf_dir):
    return R.composition(items(spark, sf_dir))


def barriers(spark, sf_dir):
    return R.barriers(items(spark, sf_dir))


def session_cold(spark, sf_dir):
    return S.session_cold(session_events(spark, sf_dir)).select("session", "seq", "cold")


def freeze_floor(spark, sf_dir):
    return S.freeze_floor(session_events(spark, sf_dir)).select("session", "seq", "floor")


def tag_churn(spark, sf_dir):
    tags = session_events(spark, sf_dir).select("session", "ts", "seq", F.col("event_type").alias("tag"), F.floor(F.col("value") / 20).cast("string").alias("content"))
    return S.tag_churn(tags).select("session", "tag", "seq", "digest", "changed")


def prefix_attribution(spark, sf_dir):
    reqs = session_events(spark, sf_dir).select("session", "ts", "seq", F.col("event_type").alias("tools"), F.floor(F.col("value") / 50).cast("string").alias("system"), F.col("props").alias("head"))
    return S.prefix_attribution(reqs, ("tools", "system", "head")).select("session", "seq", "tools_sha8", "prefix_sha8", "changed")


def idle_sessions(spark, sf_dir):
    out = S.idle_sessions(session_events(spark, sf_dir))
    return out.select("session", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


def state_at_request(spark, sf_dir):
    e = session_events(spark, sf_dir)
    reqs = e.where("kind = 'request'").select("session", "ts", "seq")
    outs = e.where("kind = 'outcome'").select("session", "ts", F.col("cache_read"))
    outs = outs.groupBy("session", "ts").agg(F.max("cache_read").alias("cache_read"))
    return S.state_at_request(reqs, outs, ["cache_read"]).select("session", "seq", F.col("state.cache_read").alias("cache_read"))


def duplicates_in_flight(spark, sf_dir):
    e = events(spark, sf_dir).select(F.concat_ws(":", "user_id", "event_type").alias("digest"), "ts", F.col("event_id").alias("seq"))
    return S.duplicates_in_flight(e, 3600).select("digest", "seq", "accepted")


def ledger(spark, sf_dir):
    return U.ledger(outcomes(spark, sf_dir)).select("request_id", "endpoint", "model", "sent", "saved", "as_text")


def ledger_rollup(spark, sf_dir):
    return ledger(spark, sf_dir).rollup("endpoint", "model").agg(F.count("*").alias("requests"), F.sum("sent").alias("sent"), F.sum("saved").alias("saved"))


def run_summary(spark, sf_dir):
    return U.run_summary(U.ledger(outcomes(spark, sf_dir)))


def ledger_windows(spark, sf_dir):
    rows = U.ledger(outcomes(spark, sf_dir)).withColumn("w", F.window(F.col("ts").cast("timestamp"), "10 minutes"))
    return rows.groupBy(F.unix_micros("w.start").alias("start_us"), "model").agg(F.count("*").alias("requests"), F.sum("sent").alias("sent"))


def latest_rows(spark, sf_dir):
    """The newest 20 ledger rows: a report whose limit is the feature."""
    return U.ledger(outcomes(spark, sf_dir)).orderBy(F.desc("ts"), F.desc("request_id")).limit(20).select("request_id", "sent", "saved")


def passthrough_reasons(spark, sf_dir):
    reason = F.when(F.col("event_type") == "view", "").when(F.col("event_type") == "click", F.concat(F.lit("below_min_chars ("), F.floor("value").cast("string"), F.lit(" < 2000)"))).when(F.col("event_type") == "error", "not_profitable").otherwise("odd")
    plans = events(spark, sf_dir).select(reason.alias("reason"), F.pmod("user_id", F.lit(3)).alias("model"))
    return U.passthrough_reasons(plans, "model")


def responses(spark, sf_dir) -> DataFrame:
    """Server-sent events of a response per event: a start, a delta and, but for sign-ups, an end; errors answer in JSON."""
    v = F.col("value").cast("long").cast("string")
    start = F.concat(F.lit('data: {"type":"message_start","message":{"usage":{"input_tokens":'), v, F.lit(',"output_tokens":"x"}}}'))
    end = F.concat(F.lit('data: {"type":"message_delta","usage":{"output_tokens":'), (F.col("value").cast("long") * 2).cast("string"), F.lit("}}"))
    body = F.when(F.col("event_type") == "error", F.concat(F.lit('{"usage":{"input_tokens":'), v, F.lit("}}"))).when(F.col("event_type") == "signup", F.concat_ws("\n", start, F.lit("data: {}"))).otherwise(F.concat_ws("\r\n", start, F.lit(""), end))
    return events(spark, sf_dir).select(F.col("event_id").alias("response_id"), body.alias("body"))


def usage_merge(spark, sf_dir):
    return U.merge_usage(U.usage_events(responses(spark, sf_dir)))


_ITEMS = """
items AS (SELECT request_id, idx, type, CASE WHEN type LIKE 'function%' THEN 'c' || ((idx // 2) % 40) END AS call_id, text FROM (
  SELECT user_id AS request_id, idx, props AS text, CASE WHEN event_type = 'error' THEN 'reasoning' WHEN event_type = 'signup' THEN 'message' WHEN idx % 2 = 0 THEN 'function_call' ELSE 'function_call_output' END AS type
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events)))"""
_PAIRS = f"""{_ITEMS},
pc AS (SELECT request_id, call_id, count(*) FILTER (type = 'function_call') AS calls, count(*) FILTER (type <> 'function_call') AS outputs,
  min(idx) FILTER (type = 'function_call') AS call_idx, min(idx) FILTER (type <> 'function_call') AS output_idx FROM items WHERE call_id IS NOT NULL GROUP BY ALL),
pairs AS (SELECT *, CASE WHEN calls = 1 AND outputs = 1 AND call_idx < output_idx THEN 'pair' WHEN outputs = 0 THEN 'open' WHEN calls = 0 THEN 'orphan' ELSE 'malformed' END AS status FROM pc)"""
_ROUNDS = f"""{_PAIRS},
isl AS (SELECT request_id, call_idx, output_idx, call_idx - row_number() OVER (PARTITION BY request_id ORDER BY call_idx) AS island FROM pairs WHERE status = 'pair'),
ends AS (SELECT *, max(call_idx) OVER (PARTITION BY request_id, island) AS end_idx FROM isl),
aft AS (SELECT *, output_idx - end_idx AS j, row_number() OVER w AS n, max(end_idx - call_idx + 1) OVER w AS reach FROM ends WHERE output_idx > end_idx WINDOW w AS (PARTITION BY request_id, island ORDER BY output_idx)),
rounds AS (SELECT request_id, end_idx, max(j) AS calls FROM aft WHERE n = j AND reach <= j GROUP BY ALL),
recent AS (SELECT *, sum(calls) OVER (PARTITION BY request_id ORDER BY end_idx DESC) - calls < {KEEP} AS recent FROM rounds)"""
_SESSION = """
ev AS (SELECT user_id AS session, ts, event_id AS seq, event_type, value, props,
  CASE WHEN event_type IN ('view', 'signup') THEN 'request' WHEN event_type = 'error' THEN 'rejection' ELSE 'outcome' END AS kind,
  CASE WHEN event_type = 'click' THEN trunc(value)::BIGINT WHEN event_type = 'purchase' THEN 0 END AS cache_read FROM events)"""
_LEDGER = """
o AS (SELECT event_id AS request_id, ts, event_type AS endpoint, 'm' || (user_id % 3) AS model, trunc(value)::BIGINT AS v, event_type <> 'signup' AS has, event_id FROM events),
l AS (SELECT request_id, ts, endpoint, model,
  CASE WHEN has THEN floor(v * 3 + 1.25::DOUBLE * (CASE WHEN endpoint = 'click' THEN v ELSE 0 END) + 0.1::DOUBLE * (CASE WHEN endpoint = 'view' THEN v ELSE 0 END) + 0.5::DOUBLE)::BIGINT END AS sent,
  CASE WHEN event_id % 4 = 0 THEN 0
       WHEN event_id % 3 = 0 AND v > 0 THEN v * 7 - v - 1
       WHEN event_id % 5 <> 0 AND v > 0 THEN floor(v * 40 / 4.0::DOUBLE - v * 700 / 784.0::DOUBLE + 0.5::DOUBLE)::BIGINT END AS saved FROM o),
led AS (SELECT *, sent + saved AS as_text FROM l)"""

QUERIES = {f.__name__: f for f in (pair_calls, tool_rounds, pair_state, closed_prefix, composition, barriers, session_cold, freeze_floor, tag_churn, prefix_attribution, idle_sessions, state_at_request, duplicates_in_flight, ledger, ledger_rollup, run_summary, ledger_windows, latest_rows, passthrough_reasons, usage_merge)}
ORACLES = {
    "pair_calls": f"WITH {_PAIRS} SELECT * FROM pairs",
    "tool_rounds": f"WITH {_ROUNDS} SELECT * FROM recent",
    "pair_state": f"""WITH {_ROUNDS},
        s AS (SELECT request_id, count(*) FILTER (status = 'pair') AS pairs, coalesce(sum(calls) FILTER (status = 'open'), 0) AS open_calls, coalesce(sum(outputs) FILTER (status = 'orphan'), 0) AS orphan_outputs,
              coalesce(sum(calls + outputs) FILTER (status = 'malformed'), 0) AS bad FROM pairs GROUP BY request_id),
        d AS (SELECT request_id, sum(calls) AS completed, sum(CASE WHEN recent THEN calls ELSE 0 END) AS recent FROM recent GROUP BY request_id)
        SELECT request_id, coalesce(completed, 0)::BIGINT AS completed_pairs, coalesce(recent, 0)::BIGINT AS recent_pairs, (coalesce(completed, 0) - coalesce(recent, 0))::BIGINT AS old_pairs,
          coalesce(open_calls, 0)::BIGINT AS open_calls, coalesce(orphan_outputs, 0)::BIGINT AS orphan_outputs, (coalesce(bad, 0) + 2 * (coalesce(pairs, 0) - coalesce(completed, 0)))::BIGINT AS malformed_items
        FROM (SELECT DISTINCT request_id FROM items) LEFT JOIN s USING (request_id) LEFT JOIN d USING (request_id)""",
    "closed_prefix": f"""WITH {_ITEMS},
        k AS (SELECT *, CASE WHEN type = 'function_call' THEN 1 WHEN type = 'function_call_output' THEN -1 END AS kind FROM items),
        b AS (SELECT *, CASE WHEN call_id IS NOT NULL AND kind <> lag(kind, 1, -1) OVER (PARTITION BY request_id, call_id ORDER BY idx) THEN kind ELSE 0 END AS delta FROM k),
        c AS (SELECT *, sum(delta) OVER w AS open, max((type = 'reasoning')::INT) OVER w AS opaque FROM b WINDOW w AS (PARTITION BY request_id ORDER BY idx))
        SELECT request_id, coalesce(max(idx) FILTER (open = 0 AND opaque = 0 AND idx < {CUTOFF}), -1) AS closed_prefix FROM c GROUP BY request_id""",
    "composition": f"WITH {_ITEMS} SELECT request_id, " + ", ".join(f"coalesce(sum(length(text)) FILTER (type = '{c}'), 0)::BIGINT AS {c}" for c in R.CLASSES) + ", sum(length(text))::BIGINT AS total FROM items GROUP BY request_id",
    "barriers": f"""WITH {_ITEMS}, s AS (SELECT request_id, type, count(*) AS n, row_number() OVER (PARTITION BY request_id ORDER BY count(*) DESC, type) AS r FROM items WHERE type NOT LIKE 'function%' GROUP BY request_id, type)
        SELECT request_id, string_agg(type || ':' || n, ',' ORDER BY r) AS barriers FROM s WHERE r <= 8 GROUP BY request_id""",
    "session_cold": f"""WITH {_SESSION},
        a AS (SELECT *, coalesce(max((kind <> 'outcome')::INT) OVER w, 0) AS known FROM ev WINDOW w AS (PARTITION BY session ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        b AS (SELECT *, CASE WHEN kind = 'outcome' AND known = 1 AND cache_read IS NOT NULL THEN (cache_read > 0)::INT END AS al FROM a),
        c AS (SELECT *, last_value(al IGNORE NULLS) OVER w AS alive, coalesce(max(al) OVER w, 0) AS ever, max(CASE WHEN kind = 'request' THEN ts END) OVER w AS seen, coalesce(sum((kind = 'request')::INT) OVER w, 0) AS spell
              FROM b WINDOW w AS (PARTITION BY session ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        d AS (SELECT *, max((kind = 'rejection')::INT) OVER (PARTITION BY session, spell) AS dead FROM c)
        SELECT session, seq, dead = 1 OR (coalesce(alive, 0) = 0 AND (coalesce(alive = 0 AND ever = 1, false) OR coalesce(epoch_us(ts) - epoch_us(seen) > {S.IDLE}000000, false))) AS cold FROM d WHERE kind = 'request'""",
    "freeze_floor": f"WITH {_SESSION} SELECT session, seq, max(floor(value)::BIGINT) OVER (PARTITION BY session ORDER BY ts, seq) AS floor FROM ev",
    "tag_churn": f"""WITH {_SESSION}, t AS (SELECT session, event_type AS tag, ts, seq, left(sha256(floor(value / 20)::BIGINT::VARCHAR), 8) AS digest FROM ev)
        SELECT session, tag, seq, digest, coalesce(lag(digest) OVER (PARTITION BY session, tag ORDER BY ts, seq) <> digest, false) AS changed FROM t""",
    "prefix_attribution": f"""WITH {_SESSION}, t AS (SELECT session, ts, seq, event_type AS a, floor(value / 50)::BIGINT::VARCHAR AS b, props AS c, left(sha256(event_type || chr(0) || floor(value / 50)::BIGINT::VARCHAR || chr(0) || props), 8) AS p FROM ev)
        SELECT session, seq, left(sha256(a), 8) AS tools_sha8, p AS prefix_sha8, CASE WHEN lag(p) OVER w IS NULL THEN 'first' WHEN lag(a) OVER w <> a THEN 'tools' WHEN lag(b) OVER w <> b THEN 'system' WHEN lag(c) OVER w <> c THEN 'head' ELSE 'none' END AS changed
        FROM t WINDOW w AS (PARTITION BY session ORDER BY ts, seq)""",
    "idle_sessions": f"""WITH {_SESSION}, g AS (SELECT session, epoch_us(ts) AS us, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session ORDER BY ts, seq) >= {S.IDLE}000000, true)::INT AS new, seq, ts FROM ev),
        n AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY ts, seq) AS s FROM g)
        SELECT session, min(us) AS start_us, max(us) + {S.IDLE}000000 AS end_us, count(*) AS events FROM n GROUP BY session, s""",
    "state_at_request": f"""WITH {_SESSION}, r AS (SELECT session, ts, seq FROM ev WHERE kind = 'request'), o AS (SELECT session, ts, max(cache_read) AS cache_read FROM ev WHERE kind = 'outcome' GROUP BY ALL)
        SELECT r.session, r.seq, o.cache_read FROM r ASOF LEFT JOIN o ON r.session = o.session AND r.ts > o.ts""",
    "ledger": f"WITH {_LEDGER} SELECT request_id, endpoint, model, sent, saved, as_text FROM led",
    "ledger_rollup": f"WITH {_LEDGER} SELECT endpoint, model, count(*) AS requests, sum(sent)::BIGINT AS sent, sum(saved)::BIGINT AS saved FROM led GROUP BY ROLLUP (endpoint, model)",
    "run_summary": f"WITH {_LEDGER} SELECT count(*) AS requests, sum(as_text)::BIGINT AS as_text, sum(sent)::BIGINT AS sent, round((sum(sent) - sum(as_text)) * 100.0::DOUBLE / sum(as_text), 4)::DOUBLE AS change_percent FROM led WHERE as_text IS NOT NULL AND sent IS NOT NULL",
    "ledger_windows": f"WITH {_LEDGER} SELECT epoch_us(ts) // 600000000 * 600000000 AS start_us, model, count(*) AS requests, sum(sent)::BIGINT AS sent FROM led GROUP BY ALL",
    "latest_rows": f"WITH {_LEDGER} SELECT request_id, sent, saved FROM led ORDER BY ts DESC, request_id DESC LIMIT 20",
    "passthrough_reasons": "SELECT user_id % 3 AS model, CASE event_type WHEN 'view' THEN 'applied' WHEN 'click' THEN 'below_min_chars' WHEN 'error' THEN 'not_profitable' ELSE 'passthrough' END AS reason, count(*) AS n FROM events GROUP BY ROLLUP (model, reason)",
    "usage_merge": """SELECT event_id AS response_id, trunc(value)::BIGINT AS input_tokens, CASE WHEN event_type NOT IN ('error', 'signup') THEN trunc(value)::BIGINT * 2 END AS output_tokens,
        NULL::BIGINT AS cache_creation_input_tokens, NULL::BIGINT AS cache_read_input_tokens FROM events""",
}
