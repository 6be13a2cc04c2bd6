"""Queries of the Responses collapse: events read as items, small profiles of each mode."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxledger.functions import text as X
from ctxledger.operators import collapse as C
from ctxledger.operators import profiles as P
from ctxledger.plans import activity as E

KEEP_PAIRS, COLS, ROWS = 2, 40, 10
_SMALL = dict(strip_cols=COLS, max_height=8 * ROWS + 8, keep_tail=2, keep_pairs=KEEP_PAIRS, min_collapse_tokens=900)
#: Profiles by what is left of request_id modulo 4: pages cost 255 tokens each.
PROFILES = {
    "small-0": _SMALL | dict(mode="mixed", max_images=3), "small-1": _SMALL | dict(mode="pairs", max_images=3),
    "small-2": _SMALL | dict(mode="mixed", max_images=0), "small-3": _SMALL | dict(mode="mixed", max_images=1, keep_tail=0),
}


def response_items(spark, sf_dir) -> DataFrame:
    """Events as items of some size: sign-ups are messages, some empty; some of the opaque items refer to an earlier one."""
    i = F.col("idx")
    rows = E.items(spark, sf_dir)
    refers = (F.col("type") == "reasoning") & (i % 7 == 3)
    said = F.when((F.col("type") == "message") & (i % 10 == 5), "").otherwise(F.repeat("text", (1 + i % 23).cast("int")))
    return rows.select(
        "request_id", "idx", F.when(refers, "item_reference").otherwise(F.col("type")).alias("type"), F.when(F.col("type") == "message", F.when(i % 3 == 0, "assistant").otherwise("user")).alias("role"),
        "call_id", F.concat(F.lit("i"), F.when(refers, i - 5).otherwise(i).cast("string")).alias("id"), F.lit("look").alias("name"), said.alias("text"),
    )


def size(s):
    return F.ceil(X.u16len(s) * 3 / 4).cast("long")


def _plan(spark, sf_dir):
    items = response_items(spark, sf_dir)
    models = items.select("request_id").distinct().withColumn("model", F.concat(F.lit("small-"), F.pmod("request_id", F.lit(4)).cast("string")))
    return C.responses_collapse(items, P.resolve_profile(models, overrides_json=json.dumps(PROFILES)), size)


def responses_collapse(spark, sf_dir):
    """The plan of each request: reason, what is eligible, what becomes pages, barriers."""
    return _plan(spark, sf_dir)[0]


def responses_segments(spark, sf_dir):
    parts = _plan(spark, sf_dir)[1]
    return parts.select("request_id", "run", "insert_at", "last", "units", "items", "pairs", "tokens", "pages", X.sha8(F.col("text")).alias("text_sha8"))


def responses_rewritten(spark, sf_dir):
    """The input after collapse; synthetic items are told by their pages."""
    _, parts, rows = _plan(spark, sf_dir)
    out = C.rewritten_items(rows, parts)
    return out.select("request_id", "idx", "source_idx", "type", "role", "pages", F.when(F.col("source_idx").isNotNull(), X.sha8(F.coalesce("text", F.lit("")))).alias("text_sha8"))


_PLAN = f"""
WITH RECURSIVE {E._ROUNDS.replace(f"< {E.KEEP} AS recent", f"< {KEEP_PAIRS} AS recent")},
it AS (SELECT request_id, idx, CASE WHEN type = 'reasoning' AND idx % 7 = 3 THEN 'item_reference' ELSE type END AS type, CASE WHEN type = 'message' THEN CASE WHEN idx % 3 = 0 THEN 'assistant' ELSE 'user' END END AS role,
  call_id, 'i' || CASE WHEN type = 'reasoning' AND idx % 7 = 3 THEN idx - 5 ELSE idx END AS id, CASE WHEN type = 'message' AND idx % 10 = 5 THEN '' ELSE repeat(text, (1 + idx % 23)::INT) END AS text, request_id % 4 AS p FROM items),
mem AS (SELECT request_id, unnest(range(end_idx - calls::BIGINT + 1, end_idx + calls::BIGINT + 1)) AS idx, end_idx - calls + 1 AS st, end_idx + calls AS en FROM recent WHERE NOT recent),
named AS (SELECT DISTINCT request_id, id, true AS named FROM it WHERE type = 'item_reference'),
a AS (SELECT it.*, st, en, coalesce(named, false) AS named, role IS NOT NULL AND text <> '' AS said FROM it LEFT JOIN mem USING (request_id, idx) LEFT JOIN named USING (request_id, id)),
b AS (SELECT *, said AND (row_number() OVER (PARTITION BY request_id, said ORDER BY idx DESC) <= CASE WHEN p = 3 THEN 0 ELSE 2 END OR coalesce(idx = max(CASE WHEN said AND role = 'user' THEN idx END) OVER (PARTITION BY request_id), false)) AS kept,
  st IS NOT NULL AND NOT (p <> 1 AND bool_or(named) OVER (PARTITION BY request_id, st)) AS taken FROM a),
k AS (SELECT *, CASE WHEN taken THEN CASE WHEN idx = st THEN 'unit' ELSE 'inside' END WHEN p = 1 OR named OR kept THEN 'barrier' WHEN said THEN 'unit' WHEN role IS NOT NULL THEN 'skip' ELSE 'barrier' END AS kind FROM b),
r AS (SELECT *, count(*) FILTER (kind = 'barrier') OVER w AS run, count(*) FILTER (kind = 'unit') OVER w AS nu FROM k WINDOW w AS (PARTITION BY request_id ORDER BY idx)),
n AS (SELECT *, p <> 1 AND kind = 'barrier' AND nu > coalesce(max(CASE WHEN kind = 'barrier' THEN nu END) OVER (PARTITION BY request_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS noted,
  CASE WHEN kind IN ('unit', 'inside') THEN CASE WHEN taken THEN st ELSE idx END END AS s, CASE WHEN kind IN ('unit', 'inside') THEN CASE WHEN taken THEN en ELSE idx END END AS e FROM r),
bar AS (SELECT request_id, string_agg(type || ':' || c, ',' ORDER BY c DESC, type) AS barriers FROM (SELECT request_id, type, count(*) AS c, row_number() OVER (PARTITION BY request_id ORDER BY count(*) DESC, type) AS q FROM n WHERE noted GROUP BY request_id, type) WHERE q <= 8 GROUP BY request_id),
rt AS (SELECT o.request_id, o.s, string_agg('[tool_use look]' || chr(10) || c.text || chr(10) || '[tool_result]' || chr(10) || o.text, chr(10) || chr(10) ORDER BY o.idx) AS txt FROM n o JOIN n c ON o.request_id = c.request_id AND o.s = c.s AND o.call_id = c.call_id AND c.type = 'function_call'
  WHERE o.type = 'function_call_output' AND o.taken GROUP BY ALL),
u AS (SELECT request_id, p, run, s, e, sum(ceil(length(text) * 3 / 4.0))::BIGINT AS tokens, count(*) FILTER (taken AND type = 'function_call') AS pairs, coalesce(sum(ceil(length(text) * 3 / 4.0)) FILTER (taken AND type = 'function_call'), 0)::BIGINT AS ct,
  coalesce(sum(ceil(length(text) * 3 / 4.0)) FILTER (taken AND type <> 'function_call'), 0)::BIGINT AS ot, max(CASE WHEN NOT taken THEN '<' || role || ' t="' || idx || '">' || chr(10) || text || chr(10) || '</' || role || '>' END) AS said FROM n WHERE s IS NOT NULL GROUP BY ALL),
v AS (SELECT u.*, coalesce(said, txt) AS txt, row_number() OVER (PARTITION BY u.request_id ORDER BY run, u.s) AS o FROM u LEFT JOIN rt ON u.request_id = rt.request_id AND u.s = rt.s),
base AS (SELECT request_id, count(*) AS units, sum(tokens)::BIGINT AS unit_tokens, (sum(length(txt)) + 2 * (count(*) - 1))::BIGINT AS chars FROM v GROUP BY request_id),
early AS (SELECT i.request_id, units, unit_tokens, chars, CASE WHEN units IS NULL THEN 'no_closed_prefix' WHEN unit_tokens < 900 THEN 'below_min_tokens' WHEN i.request_id % 4 = 2 THEN 'too_many_images' END AS early FROM (SELECT DISTINCT request_id FROM items) i LEFT JOIN base USING (request_id)),
x AS (SELECT v.*, sum(length(txt)) OVER w + 2 * (row_number() OVER w - 1) AS pc, sum(tokens) OVER w AS bt FROM v JOIN early USING (request_id) WHERE early IS NULL WINDOW w AS (PARTITION BY v.request_id, run ORDER BY s)),
y AS (SELECT *, greatest(1, ceil(ceil(pc / {COLS}.0) / {ROWS}.0))::BIGINT AS pages, 255 * greatest(1, ceil(ceil(pc / {COLS}.0) / {ROWS}.0)) < CASE WHEN p = 1 THEN pc / 4.0 ELSE bt END AS pays FROM x),
f(request_id, o, run, lef, best, ok, whole, over, fits) AS (
  SELECT request_id, o, run, CASE WHEN p = 3 THEN 1 ELSE 3 END::BIGINT, CASE WHEN pages <= CASE WHEN p = 3 THEN 1 ELSE 3 END THEN pages END, pages <= CASE WHEN p = 3 THEN 1 ELSE 3 END AND pays, pages <= CASE WHEN p = 3 THEN 1 ELSE 3 END, false, pages <= CASE WHEN p = 3 THEN 1 ELSE 3 END FROM y WHERE o = 1
  UNION ALL
  SELECT request_id, o, run, lef, CASE WHEN fits THEN pages WHEN fresh THEN NULL ELSE best END, CASE WHEN fits THEN pays WHEN fresh THEN false ELSE ok END, CASE WHEN fresh THEN fits ELSE whole AND fits END, over, fits FROM (
    SELECT *, NOT over AND pages <= lef AS fits FROM (SELECT g.*, over0 OR (fresh AND (best IS NULL OR ok AND NOT whole OR lef <= 0)) AS over FROM (
      SELECT y.request_id, y.o, y.run, y.pages, y.pays, f.best, f.ok, f.whole, f.over AS over0, y.run <> f.run AS fresh, CASE WHEN y.run <> f.run AND f.ok THEN f.lef - f.best ELSE f.lef END AS lef
      FROM f JOIN y ON y.request_id = f.request_id AND y.o = f.o + 1) g))),
z AS (SELECT y.*, fits FROM y JOIN f USING (request_id, o)),
seg AS (SELECT request_id, run, min(s) AS insert_at, max(s) AS last, count(*) AS units, sum(e - s + 1)::BIGINT AS items, sum(pairs)::BIGINT AS pairs, sum(tokens)::BIGINT AS tokens, max_by(pages, s) AS pages, string_agg(txt, chr(10) || chr(10) ORDER BY s) AS txt, sum(ct)::BIGINT AS ct, sum(ot)::BIGINT AS ot
  FROM z WHERE fits GROUP BY request_id, run HAVING max_by(pays, s))"""

QUERIES = {f.__name__: f for f in (responses_collapse, responses_segments, responses_rewritten)}
ORACLES = {
    "responses_collapse": f"""{_PLAN},
        cap AS (SELECT request_id, bool_or(none) AS capped FROM (SELECT request_id, run, NOT bool_or(fits) AS none FROM z GROUP BY request_id, run) GROUP BY request_id),
        done AS (SELECT request_id, count(*) AS segments, sum(pages)::BIGINT AS pages, sum(items)::BIGINT AS items, (sum(length(txt)) + 2 * (count(*) - 1))::BIGINT AS chars, sum(tokens)::BIGINT AS tokens, sum(pairs)::BIGINT AS pairs, sum(ct)::BIGINT AS ct, sum(ot)::BIGINT AS ot FROM seg GROUP BY request_id)
        SELECT request_id, coalesce(early, CASE WHEN segments > 0 THEN 'collapsed' WHEN capped THEN 'too_many_images' ELSE 'not_profitable' END) AS reason, coalesce(e.units, 0) AS units, coalesce(unit_tokens, 0) AS unit_tokens, coalesce(e.chars, 0) AS eligible_chars,
          coalesce(segments, 0) AS segments, coalesce(d.pages, 0) AS pages, coalesce(d.items, 0) AS collapsed_items, coalesce(d.tokens, 0) AS baseline_tokens, coalesce(d.pairs, 0) AS collapsed_pairs, coalesce(d.ct, 0) AS collapsed_call_tokens, coalesce(d.ot, 0) AS collapsed_output_tokens,
          coalesce(d.chars, e.chars, 0) AS collapsed_chars, coalesce(barriers, '') AS barriers
        FROM early e LEFT JOIN cap USING (request_id) LEFT JOIN done d USING (request_id) LEFT JOIN bar USING (request_id)""",
    "responses_segments": f"{_PLAN} SELECT request_id, run, insert_at, last, units, items, pairs, tokens, pages, left(sha256(txt), 8) AS text_sha8 FROM seg",
    "responses_rewritten": f"""{_PLAN},
        w AS (SELECT request_id, insert_at AS pos, 0 AS q, NULL::BIGINT AS source_idx, 'message' AS type, 'user' AS role, pages, NULL::VARCHAR AS text_sha8 FROM seg
          UNION ALL SELECT n.request_id, idx, 1, idx, n.type, n.role, 0, left(sha256(n.text), 8) FROM n LEFT JOIN seg ON n.request_id = seg.request_id AND n.run = seg.run WHERE n.s IS NULL OR seg.last IS NULL OR n.s > seg.last)
        SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY pos, q) - 1 AS idx, source_idx, type, role, pages, text_sha8 FROM w""",
}
