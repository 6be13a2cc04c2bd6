"""Queries that price texts: as tokens, as pages, and which is cheaper."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxledger.functions import geometry as G
from ctxledger.functions import text as X
from ctxledger.operators import profiles as P

#: The models that the sample workload spreads documents over.
MODELS = ("claude-opus-5", "gpt-5.6-sol", "gpt-5", "grok-4.5", "gemini-3.6-flash")
PER_TOKEN = 2.0


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def price_texts(df: DataFrame, text: str = "text", model: str = "model", per_token: float = PER_TOKEN) -> DataFrame:
    """``df`` plus chars, rows, image_tokens, text_tokens, profitable for its texts under its models.

    Texts are compacted and reflowed first. Narrow: no shuffle, profiles are broadcast.
    """
    out = P.resolve_profile(df.withColumn("chars", X.u16len(X.packed(F.col(text)))), model)
    out = out.withColumn("rows", X.packed_rows(F.col("chars"), F.col("profile.strip_cols")))
    out = G.with_image_tokens(out).withColumn("text_tokens", X.text_tokens(F.col("chars"), per_token))
    return out.withColumn("profitable", (F.col("chars") > 0) & G.profitable(F.col("image_tokens"), F.col("text_tokens"))).drop("profile")


def _with_model(docs: DataFrame) -> DataFrame:
    names = F.array(*(F.lit(m) for m in MODELS))
    return docs.withColumn("model", F.element_at(names, (F.pmod(F.col("doc_id"), F.lit(len(MODELS))) + 1).cast("int")))


def doc_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _with_model(load(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return price_texts(docs).select("doc_id", "source", "model", "chars", "rows", "image_tokens", "text_tokens", "profitable")


def gate_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_cost(spark, sf_dir)
    saved = F.when(F.col("profitable"), F.col("text_tokens") - F.col("image_tokens")).otherwise(0.0)
    out = rows.rollup("source", "model").agg(F.count("*").alias("docs"), F.sum(F.col("profitable").cast("long")).alias("paged"), F.sum(saved).alias("saved_tokens"))
    return out


_U16 = r"(length({0}) + length(regexp_replace({0}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


def u16_sql(x: str) -> str:
    return _U16.format(x)


_COMPACT = r"regexp_replace(regexp_replace({0}, '[ \t]+(\n|\z)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
DOC_COST_SQL = f"""
WITH prof(i, model, regime, cols, height, cw, ch) AS (
  VALUES (0, 'claude-opus-5', 'patch28', 312, 728, 5, 8), (1, 'gpt-5.6-sol', 'patch', 84, 1954, 9, 16), (2, 'gpt-5', 'tile', 152, 1932, 5, 8),
         (3, 'grok-4.5', 'mpix', 84, 512, 9, 16), (4, 'gemini-3.6-flash', 'flat', 312, 728, 5, 8)
), t AS (
  SELECT doc_id, source, model, regime, cols, height, cw, ch,
         replace(replace({_COMPACT.format("coalesce(text, '')")}, '↵', '⏎'), chr(10), '↵') AS packed
  FROM documents JOIN prof ON doc_id % 5 = i
), m AS (
  SELECT *, {u16_sql("packed")} AS chars, least(greatest(1, (height - 8) // ch), greatest(1, 28080 // cols)) AS per FROM t
), r AS (
  SELECT *, greatest(1, ceil(chars::DOUBLE / cols))::BIGINT AS rows, 8 + cols * cw AS w FROM m
), n AS (
  SELECT *, ceil(rows::DOUBLE / per)::BIGINT AS pages FROM r
), h AS (
  SELECT *, 8 + per * ch AS hf, 8 + least(greatest(1, rows - (pages - 1) * per), per) * ch AS hl FROM n
), v AS (
  SELECT *, CASE regime
      WHEN 'patch28' THEN (pages - 1) * (ceil(w / 28.0) * ceil(hf / 28.0)) + ceil(w / 28.0) * ceil(hl / 28.0)
      WHEN 'patch' THEN (pages - 1) * (ceil(w / 32.0) * ceil(hf / 32.0)) + ceil(w / 32.0) * ceil(hl / 32.0)
      WHEN 'mpix' THEN (pages - 1) * greatest(1, ceil(w * hf / 1e6 * 1000)) + greatest(1, ceil(w * hl / 1e6 * 1000))
      WHEN 'flat' THEN (pages - 1) * (CASE WHEN w = 1568 AND hf = 728 THEN 1078 ELSE 1120 END) + (CASE WHEN w = 1568 AND hl = 728 THEN 1078 ELSE 1120 END)
      ELSE (pages - 1) * (70 + 140 * ceil(w / 512.0) * ceil(hf / 512.0)) + (70 + 140 * ceil(w / 512.0) * ceil(hl / 512.0)) END::DOUBLE AS raw
  FROM h
)
SELECT doc_id, source, model, chars::BIGINT AS chars, rows, ceil(raw * 1.10::DOUBLE) AS image_tokens, chars / 2.0::DOUBLE AS text_tokens,
       chars > 0 AND ceil(raw * 1.10::DOUBLE) < chars / 2.0::DOUBLE AS profitable
FROM v
"""

GATE_SQL = f"""
SELECT source, model, count(*) AS docs, sum(profitable::INT)::BIGINT AS paged,
       sum(CASE WHEN profitable THEN text_tokens - image_tokens ELSE 0.0 END)::DOUBLE AS saved_tokens
FROM ({DOC_COST_SQL}) GROUP BY ROLLUP (source, model)
"""


def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return load(spark, sf_dir, "documents").select(
        "doc_id",
        X.u16len(text).alias("units"),
        X.visual_rows(text, 80).alias("rows80"),
        X.content_cols(text, 312).alias("widest"),
        X.u16len(X.compact_whitespace(text)).alias("compact_units"),
        X.u16len(X.minify(text)).alias("minified_units"),
        X.u16len(X.reflow(X.neutralize(text))).alias("reflow_units"),
        X.field_count(text).cast("long").alias("fields"),
        X.sha8(text).alias("sha8"),
        X.estimate_pages_of(text, 80, 28080, 90).alias("pages"),
    )


_LINES = "string_split(coalesce(text, ''), chr(10))"
_MINIFY = r"regexp_replace(regexp_replace({0}, '[ \t]+(\n|\z)', '\1', 'g'), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')"
TEXT_SQL = f"""
WITH m AS (
  SELECT doc_id, coalesce(text, '') AS t, {u16_sql("coalesce(text, '')")} AS units,
    list_sum(list_transform({_LINES}, lambda l: greatest(1, ceil({u16_sql("l")} / 80.0))::BIGINT))::BIGINT AS rows80,
    greatest(1, least(312, list_max(list_transform({_LINES}, lambda l: {u16_sql("l")}))))::BIGINT AS widest
  FROM documents
)
SELECT doc_id, units::BIGINT AS units, rows80, widest,
  {u16_sql(_COMPACT.format("t"))}::BIGINT AS compact_units, {u16_sql(_MINIFY.format("t"))}::BIGINT AS minified_units,
  units::BIGINT AS reflow_units,
  len(list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))::BIGINT AS fields,
  left(sha256(t), 8) AS sha8,
  greatest(1, ceil(rows80 / 90.0), ceil(units / 28080.0))::BIGINT AS pages
FROM m
"""


def content_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    pages = load(spark, sf_dir, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("body"))
    return docs.unionByName(pages).select("origin", "id", X.classify_content(F.coalesce("body", F.lit(""))).alias("class"))


CLASS_SQL = r"""
WITH a AS (SELECT 'documents' AS origin, doc_id AS id, left(coalesce(text, ''), 4096) AS head FROM documents
           UNION ALL SELECT 'pages', page_id, left(coalesce(html, ''), 4096) FROM pages),
b AS (SELECT *, regexp_replace(head, '^[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', '') AS l,
      list_filter(string_split(head, chr(10))[1:40], lambda x: x <> '') AS few FROM a),
c AS (SELECT *, left(l, 1) AS first, regexp_replace(substr(l, 2), '^\s+', '') AS rest, substr(l, 4) AS after,
      len(list_filter(few, lambda x: regexp_extract(x, '^\[?(\w+)', 1) IN ('DEBUG', 'INFO', 'WARN', 'WARNING', 'ERROR', 'TRACE', 'FATAL')
        OR translate(left(x, 10), '012345678', '999999999') = '9999-99-99'
        OR (translate(left(x, 8), '012345678', '999999999') = '99:99:99' AND NOT regexp_matches(substr(x, 9, 1), '\w')))) AS logged FROM b)
SELECT origin, id, CASE
  WHEN first = '{' AND left(rest, 1) IN ('"', '}') THEN 'structured'
  WHEN first = '[' AND (left(rest, 1) IN ('"', '{', '[', ']') OR ltrim(left(rest, 2), '-')[1] BETWEEN '0' AND '9' OR regexp_extract(rest, '^\w+') IN ('true', 'false', 'null')) THEN 'structured'
  WHEN l LIKE 'diff --git %' OR (l LIKE '---%' AND regexp_matches(after, '^\r?\n|^\s+\S')) THEN 'structured'
  WHEN len(few) >= 4 AND logged >= len(few) * 0.3 THEN 'log'
  ELSE 'other' END AS class
FROM c
"""


def profile_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles, prices and eligibility of the model ids that the documents' sources map to."""
    ids = [m for m, _, _, _ in KNOWN]
    names = F.array(*(F.lit(m) for m in ids))
    docs = load(spark, sf_dir, "documents").select(F.element_at(names, (F.pmod(F.col("doc_id"), F.lit(len(ids))) + 1).cast("int")).alias("model"))
    counts = docs.groupBy("model").agg(F.count("*").alias("docs"))
    out = P.resolve_profile(counts)
    return out.select("model", "docs", F.col("profile.regime").alias("regime"), F.col("profile.strip_cols").alias("strip_cols"), P.is_misresolved(F.col("model")).alias("misresolved"), P.applicability(F.lit("POST"), F.lit("/v1/messages"), F.col("docs"), F.col("model"), ("claude", "gpt-5", "gemini-3.6-flash")).alias("reason"))


#: Literal answers for the oracle: id, regime, columns, misresolved.
KNOWN = (
    ("gpt-5.6-sol", "patch", 84, False), ("gpt-5.4", "patch", 152, False), ("gpt-5", "tile", 152, False), ("gpt-5-mini", "patch", 152, False), ("o4-mini", "patch", 152, False),
    ("o1", "tile", 152, False), ("gpt-4o", "tile", 152, False), ("grok-4.5", "mpix", 84, False), ("google/gemini-3.6-flash", "flat", 312, False), ("gemini-3.6-pro", "tile", 152, True),
    ("claude-fable-5", "patch28", 312, False), ("anthropic/claude-opus-5", "patch28", 312, False), ("openrouter/gpt-5.4", "patch", 152, False), ("unknown-model", "tile", 152, False),
)
_ALLOWED = ("gpt-5.6-sol", "gpt-5.4", "gpt-5", "gpt-5-mini", "google/gemini-3.6-flash", "claude-fable-5", "anthropic/claude-opus-5", "openrouter/gpt-5.4")
PROFILE_SQL = "WITH k(i, model, regime, strip_cols, misresolved) AS (VALUES {}) SELECT model, count(*) AS docs, any_value(regime) AS regime, any_value(strip_cols) AS strip_cols, any_value(misresolved) AS misresolved, CASE WHEN model IN ({}) THEN 'eligible' ELSE 'unsupported_model' END AS reason FROM documents JOIN k ON doc_id % {} = i GROUP BY model".format(
    ", ".join(f"({i}, '{m}', '{r}', {c}, {'true' if x else 'false'})" for i, (m, r, c, x) in enumerate(KNOWN)),
    ", ".join(f"'{m}'" for m in _ALLOWED if m not in ("gpt-5.6-sol", "gpt-5.4", "openrouter/gpt-5.4")),
    len(KNOWN),
)

QUERIES = {"doc_cost": doc_cost, "gate_by_source": gate_by_source, "text_measures": text_measures, "content_class": content_class, "profile_resolution": profile_resolution}
ORACLES = {"doc_cost": DOC_COST_SQL, "gate_by_source": GATE_SQL, "text_measures": TEXT_SQL, "content_class": CLASS_SQL, "profile_resolution": PROFILE_SQL}
