"""Queries over conversations: transcripts, history plans, session keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxledger.functions import text as X
from ctxledger.operators import history as H
from ctxledger.plans.cost import u16_sql

BUDGET, PAGE, BASE = 4, 500, 1


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumnRenamed("turn", "idx")


def transcript(spark, sf_dir):
    return H.turn_segments(turns(spark, sf_dir))


def history_cost(spark, sf_dir):
    return H.turn_costs(turns(spark, sf_dir)).select("conv_id", "idx", "text_cost", "image_cost", "text_total", "image_total")


def budget_trim(spark, sf_dir):
    return H.budget_trim(H.turn_costs(turns(spark, sf_dir)), BUDGET, PAGE)


def freeze_grid(spark, sf_dir):
    return H.freeze_grid(H.turn_costs(turns(spark, sf_dir)), BUDGET, PAGE, base=BASE).select("conv_id", "step", "pages")


def first_user_key(spark, sf_dir):
    return H.first_user_key(turns(spark, sf_dir))


def latest_user(spark, sf_dir):
    return H.latest_user(turns(spark, sf_dir))


def latest_user_pointer(spark, sf_dir):
    """The newest user turn before the sixth, carried whole where it lies before a protected prefix; turns are made long by index."""
    t = turns(spark, sf_dir).withColumn("text", F.repeat(F.concat("text", F.lit(" ")), (1 + F.col("idx") * 30).cast("int")))
    out = H.latest_user_pointer(t, 5, F.when(F.col("conv_id") % 2 == 0, 4).otherwise(0))
    return out.select("conv_id", "idx", "verbatim", X.sha8(F.col("told")).alias("told_sha8"), X.u16len(F.col("told")).alias("units"))


def protected_turns(spark, sf_dir):
    return H.protected_turns(turns(spark, sf_dir), 2).select("conv_id", "idx", "kept")


def verbatim_users(spark, sf_dir):
    out = H.verbatim_users(turns(spark, sf_dir), most=250, previews=2)
    return out.select("conv_id", "idx", "units", "verbatim", X.sha8(F.col("shown")).alias("shown_sha8"))


def chunk_plan(spark, sf_dir):
    return H.chunk_plan(turns(spark, sf_dir), 3)


def rewritten(spark, sf_dir):
    return H.rewritten(turns(spark, sf_dir), 2)


_TAGGED = "'<' || role || ' t=\"' || turn || '\">' || chr(10) || text || chr(10) || '</' || role || '>'"
_COST = f"""
SELECT conv_id, turn AS idx, role, coalesce(text, '') AS text, {u16_sql("coalesce(text, '')")} AS units,
  CASE WHEN coalesce(text, '') = '' THEN 0 ELSE {u16_sql("text")} + 14 + 2 * length(role) + length(turn::VARCHAR) END AS text_cost,
  CASE WHEN role = 'user' AND {u16_sql("coalesce(text, '')")} > 2000 THEN {u16_sql("text")} + 20 ELSE 0 END AS image_cost
FROM conversations
"""
_TOTAL = f"SELECT *, sum(text_cost) OVER w AS text_total, sum(image_cost) OVER w AS image_total FROM ({_COST}) WINDOW w AS (PARTITION BY conv_id ORDER BY idx ROWS UNBOUNDED PRECEDING)"
_SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"

QUERIES = {f.__name__: f for f in (transcript, history_cost, budget_trim, freeze_grid, first_user_key, latest_user, latest_user_pointer, protected_turns, verbatim_users, chunk_plan, rewritten)}
ORACLES = {
    "transcript": f"SELECT conv_id, string_agg({_TAGGED}, chr(10) || chr(10) ORDER BY turn) AS transcript FROM conversations WHERE coalesce(text, '') <> '' GROUP BY conv_id",
    "history_cost": f"SELECT conv_id, idx, text_cost::BIGINT AS text_cost, image_cost::BIGINT AS image_cost, text_total::BIGINT AS text_total, image_total::BIGINT AS image_total FROM ({_TOTAL})",
    "budget_trim": f"""
        SELECT conv_id, count(*) AS turns, ceil(max(text_total) / {PAGE}.0) + ceil(max(image_total) / {PAGE}.0) > {BUDGET} AS over_budget,
          CASE WHEN ceil(max(text_total) / {PAGE}.0) + ceil(max(image_total) / {PAGE}.0) > {BUDGET}
               THEN count(*) FILTER (text_total + image_total <= {BUDGET * PAGE}) ELSE count(*) END AS kept_turns
        FROM ({_TOTAL}) GROUP BY conv_id""",
    "freeze_grid": f"""
        WITH c AS ({_COST}), r AS (SELECT conv_id, max(idx) + 1 AS n FROM c GROUP BY conv_id),
        s AS (SELECT c.conv_id, n, {BASE} * (1 << k) AS step, idx // ({BASE} * (1 << k)) AS cell, sum(text_cost) AS t, sum(image_cost) AS u
              FROM c JOIN r USING (conv_id), range(13) g(k) WHERE {BASE} * (1 << k) < 2 * greatest(n, {BASE}) GROUP BY ALL),
        p AS (SELECT conv_id, n, step, sum(ceil(t / {PAGE}.0) + ceil(u / {PAGE}.0))::BIGINT AS pages FROM s GROUP BY ALL)
        SELECT conv_id, min(step)::BIGINT AS step, arg_min(pages, step) AS pages FROM p WHERE step >= n OR pages <= {BUDGET} GROUP BY conv_id""",
    "first_user_key": """
        SELECT conv_id, CASE WHEN coalesce(any_value(head), '') = '' THEN 'global' ELSE left(sha256(any_value(head)), 8) END AS session
        FROM (SELECT conv_id, first_value(CASE WHEN role = 'user' THEN left(text, 4096) END) OVER (PARTITION BY conv_id ORDER BY role <> 'user', turn) AS head FROM conversations) GROUP BY conv_id""",
    "latest_user": f"""
        WITH u AS (SELECT conv_id, max(turn) AS idx, trim(regexp_replace(coalesce(arg_max(text, turn), ''), '{_SPACE}', ' ', 'g')) AS one FROM conversations WHERE role = 'user' GROUP BY conv_id)
        SELECT conv_id, idx, CASE WHEN length(one) > 300 THEN rtrim(left(one, 300)) || '...' ELSE one END AS preview FROM u""",
    "protected_turns": """
        SELECT conv_id, turn AS idx, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2
          OR coalesce(turn = max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id), false) AS kept FROM conversations""",
    "verbatim_users": f"""
        SELECT conv_id, idx, units::BIGINT AS units, units <= 250 AS verbatim, left(sha256(CASE WHEN units <= 250 THEN text WHEN length(one) > 300 THEN left(one, 300) || '…' ELSE one END), 8) AS shown_sha8 FROM (
          SELECT *, regexp_replace(regexp_replace(text, '{_SPACE}', ' ', 'g'), '^ | $', '', 'g') AS one, row_number() OVER (PARTITION BY conv_id, units > 250 ORDER BY idx DESC) AS rn FROM ({_COST}) WHERE role = 'user') WHERE units <= 250 OR rn <= 2""",
    "latest_user_pointer": f"""
        WITH t AS (SELECT conv_id, turn, repeat(text || ' ', 1 + turn * 30) AS text FROM conversations WHERE role = 'user' AND turn < 5 AND regexp_matches(text, '\\S')),
        u AS (SELECT conv_id, max(turn) AS idx, arg_max(text, turn) AS text FROM t GROUP BY conv_id),
        v AS (SELECT conv_id, idx, conv_id % 2 = 0 AND idx < 4 AS verbatim, trim(regexp_replace(text, '{_SPACE}', ' ', 'g')) AS one, trim(text, ' ') AS whole FROM u),
        w AS (SELECT conv_id, idx, verbatim, CASE WHEN verbatim THEN CASE WHEN length(whole) <= 4000 THEN whole ELSE left(whole, 2600) || chr(10) || '[… middle elided (' || (length(whole) - 4000) || ' chars) …]' || chr(10) || right(whole, 1400) END
          WHEN length(one) > 300 THEN rtrim(left(one, 300)) || '...' ELSE one END AS told FROM v)
        SELECT conv_id, idx, verbatim, left(sha256(told), 8) AS told_sha8, length(told)::BIGINT AS units FROM w""",
    "chunk_plan": f"SELECT conv_id, idx // 3 AS chunk, min(idx) AS from_idx, max(idx) AS to_idx, sum(text_cost)::BIGINT AS text_chars, count(*) AS turns, count(*) = 3 AS closed FROM ({_COST}) GROUP BY ALL",
    "rewritten": f"""
        WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2
          OR coalesce(turn = max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id), false) AS kept FROM conversations),
        o AS (SELECT conv_id, -1 AS idx, 'user' AS role, 'Earlier turns:' || chr(10) || chr(10) || string_agg({_TAGGED}, chr(10) || chr(10) ORDER BY turn) AS text FROM k WHERE NOT kept AND coalesce(text, '') <> '' GROUP BY conv_id
              UNION ALL SELECT conv_id, turn, role, text FROM k WHERE kept)
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY idx) - 1 AS idx, role, text FROM o""",
}
