"""Text measures and rewrites as columns. Lengths are UTF-16 code units throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the space class of the wire format's own language, wider than Java's.
SPACES = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
SENTINEL, LITERAL = "↵", "⏎"
#: Fixed value: the published pre-tokenizer pattern of the o200k vocabulary, its white space being Unicode's.
_WS, _NWS = r"\p{IsWhite_Space}", r"\P{IsWhite_Space}"
PIECES = (
    r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
    r"|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
    rf"|\p{{N}}{{1,3}}| ?[^{_WS}\p{{L}}\p{{N}}]+[\r\n/]*|{_WS}*[\r\n]+|{_WS}+(?!{_NWS})|{_WS}+"
)


def u16len(s: Column) -> Column:
    """Length in UTF-16 units; code points where no astral character is possible is the common fast case."""
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("long")


def u16slice(s: Column, a: int, b: int) -> Column:
    """Units a..b of s. A cut inside a surrogate pair keeps the whole character out."""
    plain = F.substring(s, a + 1, b - a)
    units = F.encode(s, "UTF-16BE")
    part = F.substring(units, 2 * a + 1, 2 * (b - a))
    odd_start = F.hex(F.substring(part, 1, 2)).between("DC00", "DFFF")
    part = F.when(odd_start, F.substring(part, 3, 2 * (b - a))).otherwise(part)
    odd_end = F.hex(F.substring(part, -2, 2)).between("D800", "DBFF")
    part = F.when(odd_end, F.substring(part, F.lit(1), F.octet_length(part) - 2)).otherwise(part)
    return F.when(F.length(s) == u16len(s), plain).otherwise(F.decode(part, "UTF-16BE"))


def lines(s: Column) -> Column:
    return F.split(s, "\n", -1)


def visual_rows(s: Column, cols: int | Column) -> Column:
    """Soft-wrapped rows: each hard line takes ceil(length / cols) rows, one at least."""
    c = F.greatest(F.lit(cols), F.lit(1)) if isinstance(cols, int) else F.greatest(cols, F.lit(1))
    rows = F.transform(lines(s), lambda x: F.greatest(F.lit(1).cast("long"), F.ceil(u16len(x) / c)))
    return F.aggregate(rows, F.lit(0).cast("long"), lambda acc, x: acc + x)


def content_cols(s: Column, most: int) -> Column:
    """Widest hard line, at least 1 and at most ``most``."""
    return F.greatest(F.lit(1).cast("long"), F.least(F.lit(most).cast("long"), F.array_max(F.transform(lines(s), u16len))))


def compact_whitespace(s: Column) -> Column:
    """Trailing blanks and tabs of each line go; runs of newlines shrink to two."""
    return collapse_newlines(F.regexp_replace(s, r"[ \t]+(?=\n|\z)", ""))


def collapse_newlines(s: Column) -> Column:
    return F.regexp_replace(s, r"\n{3,}", "\n\n")


def minify(s: Column) -> Column:
    """As compact_whitespace, but up to three newlines stay."""
    return F.regexp_replace(F.regexp_replace(s, r"[ \t]+(?=\n|\z)", ""), r"\n{4,}", "\n\n\n")


def neutralize(s: Column) -> Column:
    return F.replace(s, F.lit(SENTINEL), F.lit(LITERAL))


def reflow(s: Column) -> Column:
    """Newlines become the inline sentinel; null where the text already holds one."""
    return F.when(F.contains(s, F.lit(SENTINEL)), None).otherwise(F.replace(s, F.lit("\n"), F.lit(SENTINEL)))


def packed(s: Column) -> Column:
    """A text as its pages hold it: compacted, sentinels neutralized, and so one line that reflow never refuses; null as empty."""
    return F.replace(neutralize(compact_whitespace(F.coalesce(s, F.lit("")))), F.lit("\n"), F.lit(SENTINEL))


def packed_rows(units: Column, cols: Column) -> Column:
    """visual_rows of a packed text of so many units: it is one line."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(units / F.greatest(cols, F.lit(1))))


def dereflow(s: Column) -> Column:
    return F.replace(s, F.lit(SENTINEL), F.lit("\n"))


def collapse_ws(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, SPACES + "+", " "), "^ | $", "")


def preview(s: Column, most: int = 300) -> Column:
    one = collapse_ws(s)
    return F.when(u16len(one) > most, F.concat(u16slice(one, 0, most), F.lit("…"))).otherwise(one)


#: How structured text and a log line open; the share of log lines and how many lines are looked at.
STRUCTURED = r'^(?:\{[\t\n\f\r ]*["}]|\[[\t\n\f\r ]*(?:["{\[\]]|-?[0-9]|(?:true|false|null)(?![A-Za-z0-9_]))|---\r?\n|diff --git |---[\t\n\f\r ]+[^\t\n\f\r ])'
LOG_LINE = r"^(?:\[?(?:DEBUG|INFO|WARN|WARNING|ERROR|TRACE|FATAL)(?![A-Za-z0-9_])|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}:[0-9]{2}:[0-9]{2}(?![A-Za-z0-9_]))"
LOG_SHARE, LOOKED_AT = 0.3, 40


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def classify_content(s: Column) -> Column:
    """structured, log or other, by the first 4096 units; the head and its lines are worked out once."""

    def by_lines(some: Column) -> Column:
        log = (F.size(some) >= 4) & (F.size(F.filter(some, lambda x: x.rlike(LOG_LINE))) >= F.size(some) * LOG_SHARE)
        return F.when(log, "log").otherwise("other")

    def by_head(head: Column) -> Column:
        lines_of = F.filter(F.slice(lines(head), 1, LOOKED_AT), lambda x: x != "")
        return F.when(F.regexp_replace(head, f"^{SPACES}+", "").rlike(STRUCTURED), "structured").otherwise(bound(lines_of, by_lines))

    return bound(u16slice(s, 0, 4096), by_head)


def sha8(s: Column) -> Column:
    return F.substring(F.sha2(s.cast("binary"), 256), 1, 8)


def piece_count(s: Column) -> Column:
    """Pre-tokenizer pieces: a lower bound of the token count that needs no ranks."""
    return F.regexp_count(s, F.lit(PIECES))


def field_count(s: Column) -> Column:
    return F.size(F.filter(F.split(s, r"[ \t\n\x0B\f\r]+"), lambda x: x != ""))


def b64_bytes(s: Column) -> Column:
    """Decoded size of base64 text."""
    pad = F.when(s.endswith("=="), 2).when(s.endswith("="), 1).otherwise(0)
    return F.floor(F.length(s) * 3 / 4) - pad


def normal_ratio(per_token: float | None) -> float:
    """Characters a token; an invalid ratio counts as 3."""
    return float(per_token) if per_token is not None and 0 < per_token < float("inf") else 3.0


def text_tokens(chars: Column, per_token: float | None) -> Column:
    return chars / F.lit(normal_ratio(per_token))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def strip_reminders(s: Column) -> Column:
    return F.regexp_replace(s, r"(?s)<system-reminder>.*?</system-reminder>", "")


def source_path(s: Column) -> Column:
    """The path after a leading 'Contents of', or null."""
    found = F.regexp_extract(s, r"Contents of ([^\n]+?)(?: \(|:|\n|$)", 1)
    return F.when(found != "", found)


#: How a billing line and an environment section begin.
BILLING, ENVIRONMENT = "x-anthropic-billing-header:", "# Environment"


def billing_line(s: Column) -> Column:
    """The first line that is a billing header, or ''."""
    at = F.instr(F.concat(F.lit("\n"), s), "\n" + BILLING)
    return F.when(at > 0, F.substring_index(F.substring(s, at, F.length(s)), "\n", 1)).otherwise("")


def strip_billing_line(s: Column) -> Column:
    """Without its first billing line and the line feed after it; of a last line the one before goes."""
    at, n = F.instr(F.concat(F.lit("\n"), s), "\n" + BILLING), F.length(billing_line(s))
    more = at + n <= F.length(s)
    left = F.substring(s, F.lit(1), F.when(more, at - 1).otherwise(F.greatest(at - 2, F.lit(0))))
    return F.when(at > 0, F.concat(left, F.substring(s, at + n + 1, F.length(s)))).otherwise(s)


def _env_section(s: Column) -> tuple[Column, Column]:
    """Where the environment section begins (1-based, 0: nowhere) and how long it is, up to the next heading."""
    found = F.regexp_instr(s, F.lit(r"(?:\A|\n)" + ENVIRONMENT + r"(?![A-Za-z0-9_])"))
    at = F.when((found > 0) & (F.substring(s, found, F.lit(1)) == "\n"), found + 1).otherwise(found)
    end = F.regexp_instr(F.substring(s, at + len(ENVIRONMENT), F.length(s)), F.lit(r"\n#{1,6}" + SPACES))
    return at, F.when(end > 0, end - 1 + len(ENVIRONMENT)).otherwise(F.length(s))


def env_section(s: Column) -> Column:
    """The environment section, without the space at its end, or ''."""
    at, size = _env_section(s)
    return F.when(at > 0, F.regexp_replace(F.substring(s, at, size), SPACES + r"+\z", "")).otherwise("")


def strip_env_section(s: Column) -> Column:
    """Without the first section headed ``# Environment``."""
    at, size = _env_section(s)
    return F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), F.substring(s, at + size, F.length(s)))).otherwise(s)


def static_tags(s: Column) -> Column:
    """array<struct<tag, content>> of paired tags; nested tags stay inside their parent's content."""
    shape = F.lit(r"(?s)<([A-Za-z][A-Za-z0-9_-]*)(?:\s[^>]*)?>(.*?)</\1>")
    zipped = F.arrays_zip(F.regexp_extract_all(s, shape, F.lit(1)).alias("tag"), F.regexp_extract_all(s, shape, F.lit(2)).alias("content"))
    return zipped


def tagged_turn(role: Column, idx: Column, body: Column) -> Column:
    return F.concat(F.lit("<"), role, F.lit(' t="'), idx.cast("string"), F.lit('">\n'), body, F.lit("\n</"), role, F.lit(">"))


def estimate_pages_of(s: Column, cols: int, max_per_page: int, max_lines: int) -> Column:
    """Pages a text needs by its wrapped rows and its characters, whichever is more."""
    per = min(max(1, max_lines), max(1, max_per_page // max(1, cols)))
    return F.greatest(F.lit(1).cast("long"), F.ceil(visual_rows(s, cols) / per), F.ceil(u16len(s) / max(1, max_per_page)))
