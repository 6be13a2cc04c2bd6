"""Queries that compact texts: fact sheets, paging, tags, code points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxledger.functions import text as X
from ctxledger.operators import facts as A
from ctxledger.operators import paging as G
from ctxledger.operators import profiles as P
from ctxledger.plans.cost import DOC_COST_SQL, _with_model, load, u16_sql

COLS, CHARS, LINES = 80, 28080, 90
#: Indices of the patterns that SQL can find without offsets: e-mails and decimals never overlap.
PLAIN = (3, 13)


def fact_counts_plain(spark, sf_dir):
    return A.fact_counts(A.fact_spans(load(spark, sf_dir, "documents"), PLAIN))


def fact_ranks_plain(spark, sf_dir):
    return A.rank_facts(A.collapse_substrings(fact_counts_plain(spark, sf_dir)), most=3).select("doc_id", "token", "count", "tier", "rank")


def fact_sheet(spark, sf_dir):
    return A.fact_sheet(A.fact_entries(A.fact_spans(load(spark, sf_dir, "documents"))))


def head_tail_paging(spark, sf_dir):
    out = G.head_tail_paging(load(spark, sf_dir, "documents"), 1, COLS, CHARS, LINES)
    return out.withColumn("marker_sha8", X.sha8(G.paging_marker())).drop("units")


def paging_candidates(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 7 == 0).alias("is_error"))
    return G.paging_candidates(rows, 3000, F.contains("text", F.lit("Apache"))).select("doc_id", "reason")


def paging_gate(spark, sf_dir):
    """Tool results that are long enough, by whether their pages pay under the request's model."""
    rows = _with_model(load(spark, sf_dir, "documents")).withColumn("is_error", F.col("doc_id") % 7 == 0)
    return G.paging_candidates(P.resolve_profile(rows), 1500).select("doc_id", "model", "reason")


def admit_by_budget(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("idx"), F.ceil(F.col("value") / 10).alias("pages"), F.floor(F.col("value") * 1000).alias("bytes"))
    return G.admit_by_budget(rows, 30, 120_000)


def static_tags_of_pages(spark, sf_dir):
    tags = load(spark, sf_dir, "pages").select("page_id", F.explode(X.static_tags(F.coalesce("html", F.lit("")))).alias("t"))
    return tags.groupBy(F.col("t.tag").alias("tag")).agg(F.count("*").alias("n"), F.sum(X.u16len(F.col("t.content"))).alias("units"))


def codepoint_top(spark, sf_dir):
    glyphs = spark.range(128, 233).select(F.char(F.col("id")).alias("c"))
    return G.top_codepoints(G.uncovered_codepoints(load(spark, sf_dir, "documents"), glyphs))


_TOKENS = r"""
tok AS (
  SELECT doc_id, rtrim(t, '.,;:!?') AS token FROM (
    SELECT doc_id, unnest(list_concat(
      regexp_extract_all(c, '\b[A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+\b'),
      regexp_extract_all(c, '\b[0-9]+\.[0-9]+\b'))) AS t
    FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+')) AS c FROM documents)
    WHERE length(c) BETWEEN 3 AND 512) WHERE length(rtrim(t, '.,;:!?')) BETWEEN 3 AND 120),
cnt AS (SELECT doc_id, token, count(*) AS count FROM tok GROUP BY ALL)"""
QUERIES = {f.__name__: f for f in (fact_counts_plain, fact_ranks_plain, fact_sheet, head_tail_paging, paging_candidates, paging_gate, admit_by_budget, static_tags_of_pages, codepoint_top)}
ORACLES = {
    "fact_counts_plain": f"WITH {_TOKENS} SELECT * FROM cnt",
    "fact_ranks_plain": f"""WITH {_TOKENS},
        k AS (SELECT * FROM cnt a WHERE NOT EXISTS (SELECT 1 FROM cnt b WHERE a.doc_id = b.doc_id AND length(b.token) > length(a.token) AND contains(b.token, a.token))),
        t AS (SELECT *, 0 AS tier FROM k)
        SELECT doc_id, token, count, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tier, length(token) DESC, token) AS rank FROM t) WHERE rank <= 3""",
    "head_tail_paging": rf"""
        WITH m AS (SELECT doc_id, coalesce(text, '') AS t, {u16_sql("coalesce(text, '')")} AS units,
          greatest(1, ceil(list_sum(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: greatest(1, ceil({u16_sql("l")} / {COLS}.0)))) / {LINES}.0), ceil({u16_sql("coalesce(text, '')")} / {CHARS}.0))::BIGINT AS pages,
          regexp_matches(coalesce(text, ''), '^\s*(\{{\s*("|\}})|\[\s*("|\{{|\[|-?[0-9]|true\b|false\b|null\b|\])|---\r?\n|diff --git |---\s+\S)') AS structured FROM documents),
        l AS (SELECT doc_id, pages, structured, units, unnest(string_split(t, CASE WHEN contains(t, chr(10)) THEN chr(10) ELSE '↵' END)) AS line, generate_subscripts(string_split(t, CASE WHEN contains(t, chr(10)) THEN chr(10) ELSE '↵' END), 1) - 1 AS i FROM m WHERE pages > 1),
        s AS (SELECT *, {u16_sql("line")} AS size, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
        r AS (SELECT *, greatest(1, ceil(size / {COLS}.0)) AS r, size + (i > 0)::INT AS hsz, size + (i < n - 1)::INT AS tsz FROM s),
        w AS (SELECT *, sum(r) OVER d AS hr, sum(hsz) OVER d AS hc, sum(r) OVER u AS tr, sum(tsz) OVER u AS tc FROM r WINDOW d AS (PARTITION BY doc_id ORDER BY i), u AS (PARTITION BY doc_id ORDER BY i DESC)),
        h AS (SELECT *, greatest(1, count(*) FILTER (hr <= CASE WHEN structured THEN 84 ELSE 50 END AND hc <= CASE WHEN structured THEN 27568 ELSE 16540 END) OVER (PARTITION BY doc_id)) AS head FROM w),
        f AS (SELECT *, NOT structured AND i >= head AND tr <= 34 AND tc <= 11028 AS in_tail FROM h),
        g AS (SELECT doc_id, any_value(pages) AS pages, any_value(units) AS units, any_value(n) AS lines, any_value(head) AS head_lines, count(*) FILTER (in_tail) AS tail,
              coalesce(sum(hsz) FILTER (i < head), 0) AS hu, coalesce(sum(tsz) FILTER (in_tail), 0) AS tu FROM f GROUP BY doc_id),
        z AS (SELECT *, tail > 0 AND head_lines + tail < lines AS both_ends FROM g)
        SELECT doc_id, pages, lines, head_lines, CASE WHEN both_ends THEN tail ELSE 0 END AS tail_lines, lines - head_lines - CASE WHEN both_ends THEN tail ELSE 0 END AS omitted_lines,
          (units - hu - CASE WHEN both_ends THEN tu ELSE 0 END)::BIGINT AS omitted_units,
          left(sha256(format('{{}}{{}}[ paging: omitted {{:,}} lines ({{:,}} chars) of content here. Original length: {{:,}} chars ({{:,}} lines, ~{{}} images). Showing first {{}} lines{{}} ]{{}}{{}}', chr(10), chr(10), (lines - head_lines - CASE WHEN both_ends THEN tail ELSE 0 END)::BIGINT,
            (units - hu - CASE WHEN both_ends THEN tu ELSE 0 END)::BIGINT, units::BIGINT, lines::BIGINT, pages, head_lines, CASE WHEN both_ends THEN ' and last ' || tail || ' lines.' ELSE ' (tail elided).' END, chr(10), chr(10))), 8) AS marker_sha8 FROM z""",
    "paging_candidates": rf"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'is_error' WHEN contains(text, 'Apache') THEN 'keep_sharp'
          WHEN {u16_sql(r"regexp_replace(regexp_replace(text, '[ \t]+(\n|\z)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} < 3000 THEN 'below_threshold'
          ELSE 'candidate' END AS reason FROM documents""",
    "paging_gate": f"""SELECT doc_id, model, CASE WHEN doc_id % 7 = 0 THEN 'is_error' WHEN chars < 1500 THEN 'below_threshold' WHEN NOT image_tokens < chars / 4.0 THEN 'not_profitable' ELSE 'candidate' END AS reason FROM ({DOC_COST_SQL})""",
    "codepoint_top": r"""
        WITH c AS (SELECT unnest(string_split(regexp_replace(text, '[\x00-\x7F]+', '', 'g'), '')) AS c FROM documents WHERE regexp_matches(text, '[^\x00-\x7F]'))
        SELECT 'U+' || lpad(hex(cp), 4, '0') AS codepoint, n FROM (SELECT unicode(c) AS cp, count(*) AS n FROM c WHERE c <> '' AND NOT unicode(c) BETWEEN 128 AND 232 GROUP BY ALL ORDER BY n DESC, cp LIMIT 20)""",
}
