"""Token usage of responses, the savings ledger and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USAGE = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
_SCHEMA = ", ".join(f"{u}: bigint" for u in USAGE)
EVENT = f"struct<message: struct<usage: struct<{_SCHEMA}>>, usage: struct<{_SCHEMA}>>"
#: Fixed value: what a provider says when a prompt is too large.
TOO_LARGE = r"(?i)prompt[\s_-]*(is\s*)?too[\s_-]*long|request[\s_-]*too[\s_-]*large|too many (images|tokens)"


def usage_events(responses: DataFrame) -> DataFrame:
    """One row per event of each response (response_id, body, JSON or server-sent events): response_id, seq, usage fields.

    A field of the wrong type is null and hides no other.
    """
    data = F.filter(F.transform(F.split("body", r"\r?\n"), lambda x: F.regexp_extract(x, r"^data:\s*(.*)$", 1)), lambda x: x != "")
    parts = F.when(F.size(data) > 0, data).otherwise(F.array("body"))
    rows = responses.select("response_id", F.posexplode(parts).alias("seq", "event")).withColumn("e", F.from_json("event", EVENT))
    both = F.explode(F.array(F.struct(F.lit(0).alias("o"), F.col("e.message.usage").alias("u")), F.struct(F.lit(1).alias("o"), F.col("e.usage").alias("u")))).alias("x")
    rows = rows.select("response_id", (F.col("seq") * 2).alias("seq2"), both)
    return rows.select("response_id", (F.col("seq2") + F.col("x.o")).alias("seq"), *(F.col(f"x.u.{c}").alias(c) for c in USAGE))


def merge_usage(events: DataFrame) -> DataFrame:
    """The last known value of each usage field per response; a field never seen stays null, not zero."""
    return events.groupBy("response_id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in USAGE))


def is_size_rejection(status: Column, body: Column) -> Column:
    return (status == 413) | ((status == 400) & F.substring(F.coalesce(body, F.lit("")), 1, 8192).rlike(TOO_LARGE))


def outcome_reason(reason: Column) -> Column:
    """Class of a free-text reason."""
    known = ("below_min_chars", "below_min_tokens", "not_profitable", "parse_error", "no_user_message", "no_static_context", "image_budget", "image_bytes", "serialized_request_limit", "unsupported_model")
    out = F.when(F.coalesce(reason, F.lit("")) == "", "applied")
    for name in known:
        out = out.when(reason.startswith(name), name)
    return out.otherwise("passthrough")


def estimated_saving(baseline: Column, image: Column, native: Column, chars: Column, pixels: Column) -> Column:
    """Tokens saved by paging: from token counts if known, else from characters and pixels, else null."""
    by_tokens = (baseline > 0) | (image > 0)
    rough = F.floor(chars / 4 - pixels / 784 + 0.5).cast("long")
    return F.when(by_tokens, baseline - image - native).when((chars > 0) & (pixels > 0), rough)


def ledger(outcomes: DataFrame) -> DataFrame:
    """``outcomes`` plus sent, saved, as_text.

    Columns used: usage fields (null: no usage), applied, baseline_tokens,
    image_tokens, native_tokens, chars, pixels. Sent weighs cache writes 1.25 and
    reads 0.1; not applied saves 0; without usage nothing is sent or comparable.
    """
    sent = F.floor(F.col("input_tokens") + 1.25 * F.col("cache_creation_input_tokens") + 0.1 * F.col("cache_read_input_tokens") + 0.5).cast("long")
    saving = estimated_saving(*(F.col(c) for c in ("baseline_tokens", "image_tokens", "native_tokens", "chars", "pixels")))
    out = outcomes.withColumns({"sent": sent, "saved": F.when(~F.col("applied"), F.lit(0).cast("long")).otherwise(saving.cast("long"))})
    return out.withColumn("as_text", F.col("sent") + F.col("saved"))


def run_summary(rows: DataFrame) -> DataFrame:
    """Totals over rows that have both amounts, and the change in percent."""
    out = rows.where("as_text is not null and sent is not null").agg(F.count("*").alias("requests"), F.sum("as_text").alias("as_text"), F.sum("sent").alias("sent"))
    return out.withColumn("change_percent", F.when(F.col("as_text") > 0, F.round((F.col("sent") - F.col("as_text")) * 100.0 / F.col("as_text"), 4)))


def request_outcomes(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with their responses, one to one; a request without response stays."""
    return requests.join(responses, "request_id", "left")


def passthrough_reasons(plans: DataFrame, *keys: str) -> DataFrame:
    """How often each reason class occurred, rolled up over ``keys``."""
    return plans.withColumn("reason", outcome_reason(F.col("reason"))).rollup(*keys, "reason").agg(F.count("*").alias("n"))
