"""Model profiles: which render geometry and prices hold for a model id."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxledger.functions.geometry import CELLS

FIELDS = (
    "name string, regime string, base double, per_tile double, multiplier double, patch_cap int, per_megapixel double, tokens int, exact_w int, exact_h int, exact_tokens int,"
    " cache_read_rate double, output_rate double, strip_cols int, max_height int, min_tokens int, vision_tier string, font string, cell_w int, cell_h int,"
    " max_images int, keep_tail int, keep_pairs int, min_collapse_tokens int, mode string, framing string, fact_scope string, history_cols int, history_font string"
)
_NAMES = [f.split()[0] for f in FIELDS.split(",")]

#: What profiles share, and how each differs.
_COMMON = dict(cache_read_rate=0.5, output_rate=4.0, strip_cols=152, max_height=1932, min_tokens=500, vision_tier="standard", font="spleen-5x8", max_images=32, keep_tail=6, keep_pairs=6, min_collapse_tokens=2000, mode="pairs", framing="full", fact_scope="per-segment")
_FIVE = dict(cache_read_rate=0.1, output_rate=8.0)
_CLAUDE = dict(regime="patch28", cache_read_rate=0.1, output_rate=5.0, strip_cols=312, max_height=728, min_tokens=None, max_images=96, mode="mixed", framing="compact", fact_scope="combined")
_LEGIBLE = dict(history_cols=172, history_font="jetbrains-mono-14")
BUILT_IN = {
    "default": dict(regime="tile", base=85.0, per_tile=170.0),
    "gpt5_nano": dict(regime="patch", multiplier=2.46, patch_cap=1536, **_FIVE),
    "gpt5_mini": dict(regime="patch", multiplier=1.62, patch_cap=1536, **_FIVE),
    "base_nano": dict(regime="patch", multiplier=2.46, patch_cap=1536),
    "base_mini": dict(regime="patch", multiplier=1.62, patch_cap=1536),
    "gpt56_sol": dict(regime="patch", multiplier=1.0, patch_cap=0, strip_cols=84, max_height=1954, font="jetbrains-mono-14", max_images=64, keep_tail=1, keep_pairs=1, min_collapse_tokens=1000, mode="mixed", framing="compact", fact_scope="combined", **_FIVE),
    "gpt5_patch": dict(regime="patch", multiplier=1.0, patch_cap=10000, **_FIVE),
    "gpt5_tile": dict(regime="tile", base=70.0, per_tile=140.0, **_FIVE),
    "o1_o3": dict(regime="tile", base=75.0, per_tile=150.0),
    "grok": dict(regime="mpix", per_megapixel=1000.0, cache_read_rate=0.25, output_rate=3.0, strip_cols=84, max_height=512, font="jetbrains-mono-14", max_images=24),
    "claude_fable": dict(vision_tier="high-res", **_CLAUDE),
    "claude_fable_legacy": dict(**_CLAUDE),
    "claude": dict(vision_tier="high-res", **_CLAUDE, **_LEGIBLE),
    "claude_legacy": dict(**_CLAUDE, **_LEGIBLE),
    "gemini": dict(regime="flat", tokens=1120, exact_w=1568, exact_h=728, exact_tokens=1078, strip_cols=312, max_height=728),
}
#: Id patterns in order of precedence. Ids are lower-cased, bracketed variants stripped.
_OLD = r"claude-(?:[a-z]+-)?(?:[0-3](?![0-9])|4(?![0-9])(?!-(?:[7-9]|[1-9][0-9]+)))"
RULES = (
    ("claude_fable_legacy", rf"^(?=.*(?:claude|anthropic))(?=.*fable)(?=.*{_OLD})"),
    ("claude_fable", r"^(?=.*(?:claude|anthropic))(?=.*fable)"),
    ("claude_legacy", rf"^(?=.*(?:claude|anthropic))(?=.*{_OLD})"),
    ("claude", r"claude|anthropic"),
    ("gpt5_nano", r"^gpt-5(?:\.[0-9]+)?-(?:nano|mini.*nano)"),
    ("gpt5_mini", r"^gpt-5(?:\.[0-9]+)?-mini"),
    ("base_nano", r"^(?:gpt-4\.1-nano|gpt-4\.1-mini.*nano|o4-mini.*nano)"),
    ("base_mini", r"^(?:gpt-4\.1-mini|o4-mini)"),
    ("gpt56_sol", r"^gpt-5\.6-sol(?:-|$)"),
    ("gpt5_patch", r"^gpt-5\.[0-9]"),
    ("gpt5_tile", r"^gpt-5"),
    ("o1_o3", r"^o[13]"),
    ("grok", r"^grok-"),
)
GEMINI = ("gemini-3.6-flash", "google/gemini-3.6-flash")
#: Fixed value: the id whose profile holds where no model's does, that of the slab.
NO_MODEL = "claude"


def _row(name: str, given: dict) -> tuple:
    row = _COMMON | given | {"name": name}
    row["cell_w"], row["cell_h"] = CELLS[row["font"]]
    return tuple(row.get(f) for f in _NAMES)


def load_profiles(spark: SparkSession, overrides_json: str | None = None) -> DataFrame:
    """The built-in profiles, plus one per user override (each field falls back to the profile it would resolve to).

    ``overrides_json`` maps id prefixes to fields; malformed JSON means no override.
    The table has tens of rows and is broadcast.
    """
    rows = [_row(name, given) for name, given in BUILT_IN.items()]
    for key, base, given in overrides(overrides_json):
        rows.append(_row("user:" + key, BUILT_IN[base] | {k: v for k, v in given.items() if k in _NAMES and v is not None}))
    return spark.createDataFrame(rows, FIELDS)


def overrides(raw: str | None) -> list[tuple[str, str, dict]]:
    """(id prefix, built-in base profile, fields) of each override, in the order given."""
    import re

    try:
        found = json.loads(raw) if raw else {}
    except ValueError:
        return []
    if not isinstance(found, dict):
        return []

    def base(key: str) -> str:
        return next((name for name, pattern in RULES if re.search(pattern, key)), "default")

    return [(k.lower(), base(k.lower()), v) for k, v in found.items() if isinstance(v, dict)]


def normalize_model(model: Column) -> Column:
    """Lower case, bracketed variants dropped."""
    return F.regexp_replace(F.lower(model), r"\[[^\]]*\]", "")


def _built_in(ident: Column) -> Column:
    out = None
    for name, pattern in RULES:
        hit = ident.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("default")


def profile_name(model: Column, overrides_json: str | None = None) -> Column:
    """Name of the profile: exact gemini, then the longest user prefix, then the rules; a vendor-qualified spelling wins unless it is the default."""
    whole = normalize_model(F.coalesce(model, F.lit("")))
    last = F.substring_index(whole, "/", -1)
    out = F.when(whole.isin(*GEMINI) | last.isin(*GEMINI), "gemini")
    user = sorted(enumerate(overrides(overrides_json)), key=lambda x: (-len(x[1][0]), x[0]))
    for _, (key, _, _) in user:
        out = out.when(whole.startswith(key) | last.startswith(key), "user:" + key)
    first = _built_in(whole)
    return out.when(first != "default", first).otherwise(_built_in(last))


#: Distinct model ids up to which they are resolved once each instead of row by row.
MODELS = 10_000


def resolve_profile(df: DataFrame, model: str = "model", overrides_json: str | None = None) -> DataFrame:
    """``df`` with a struct column ``profile``.

    A first job finds the distinct model ids; MODELS of them at most are resolved once
    and broadcast with their profiles, so that the id tests stay out of the rows'
    plan. A stream, or a table of more ids, is resolved row by row. The profile table
    has tens of rows and is broadcast either way.
    """
    spark = df.sparkSession
    table = F.broadcast(load_profiles(spark, overrides_json).select(F.col("name").alias("_profile"), F.struct(*_NAMES).alias("profile")))
    ident = F.coalesce(F.col(model), F.lit(""))
    found = [] if df.isStreaming else [r[0] for r in df.select(ident.alias("m")).distinct().limit(MODELS + 1).collect()]
    if not found or len(found) > MODELS:
        return df.withColumn("_profile", profile_name(F.col(model), overrides_json)).join(table, "_profile").drop("_profile")
    names = spark.createDataFrame([(m,) for m in found], "_model string")
    names = names.withColumn("_profile", profile_name(F.col("_model"), overrides_json)).join(table, "_profile").drop("_profile")
    return df.withColumn("_model", ident).join(F.broadcast(names), "_model").drop("_model")


def is_misresolved(model: Column, declared: tuple[str, ...] = ()) -> Column:
    """The id names a family that its profile test does not accept."""
    whole = F.lower(F.coalesce(model, F.lit("")))
    last = F.substring_index(whole, "/", -1)
    gemini = F.contains(whole, F.lit("gemini")) & ~(whole.isin(*GEMINI) | last.isin(*GEMINI))
    grok = F.contains(whole, F.lit("grok")) & ~(whole.startswith("grok-") | last.startswith("grok-"))
    known = F.lit(False)
    for key in declared:
        known = known | whole.startswith(key) | last.startswith(key)
    return (gemini | grok) & ~known


def model_allowed(model: Column, bases: tuple[str, ...], declared: tuple[str, ...] = ()) -> Column:
    """A base equals the id or starts it before a dash, in either spelling; * takes all; misresolved ids never pass."""
    whole = normalize_model(F.coalesce(model, F.lit("")))
    last = F.substring_index(whole, "/", -1)
    hit = F.lit("*" in bases)
    for base in (b.lower() for b in bases):
        for ident in (whole, last):
            hit = hit | (ident == base) | ident.startswith(base + "-")
    return (whole != "") & hit & ~is_misresolved(whole, declared)


def protocol_of(path: Column) -> Column:
    """messages, chat, responses or none; chat and responses allow one provider segment."""
    return (
        F.when(path.isin("/v1/messages", "/anthropic/v1/messages", "/anthropic/messages"), "messages")
        .when(path.rlike(r"^(?:/[a-z0-9][a-z0-9._-]*)?(?:/v1)?/chat/completions$"), "chat")
        .when(path.rlike(r"^(?:/[a-z0-9][a-z0-9._-]*)?(?:/v1)?/responses$"), "responses")
        .otherwise("none")
    )


def applicability(method: Column, path: Column, body_bytes: Column, model: Column, bases: tuple[str, ...]) -> Column:
    """The first reason that holds; an empty method or path, or a null size, skips its check."""
    return (
        F.when((F.coalesce(method, F.lit("")) != "") & (F.upper(method) != "POST"), "unsupported_method")
        .when((F.coalesce(path, F.lit("")) != "") & (protocol_of(path) != "messages"), "unsupported_path")
        .when(body_bytes <= 0, "empty_body")
        .when(~model_allowed(model, bases), "unsupported_model")
        .otherwise("eligible")
    )
