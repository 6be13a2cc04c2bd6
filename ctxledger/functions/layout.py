"""Page layout of texts whose wrapping built-in functions cannot express: wide cells, tabs, greedy pages."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINEL = "↵"


def cell(c: str, marker: int = 1) -> int:
    """Cells a character takes: wide and full-width ones two, combining marks none, the sentinel ``marker``."""
    if c == SENTINEL:
        return marker
    if c.isascii():
        return 1
    return 0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1


def expand_tabs(line: str, stop: int = 4) -> str:
    """Tabs become an arrow and blanks up to the next stop."""
    if "\t" not in line:
        return line
    out, col = [], 0
    for c in line:
        if c == "\t":
            pad = stop - col % stop
            out.append("→" + " " * (pad - 1))
            col += pad
        else:
            out.append(c)
            col += cell(c)
    return "".join(out)


def wrap(line: str, cols: int, marker: int = 1) -> list[tuple[int, int]]:
    """(cells, characters) of each row of a hard line, filled greedily; an empty line is one empty row."""
    if line.isascii():
        return [(min(cols, len(line) - i),) * 2 for i in range(0, len(line), cols)] or [(0, 0)]
    rows, used, n = [], 0, 0
    for c in line:
        w = cell(c, marker)
        if used + w > cols and n:
            rows.append((used, n))
            used = n = 0
        used += w
        n += 1
    rows.append((used, n))
    return rows


def geometry(text: str, cols: int, height: int = 728, cell_w: int = 5, cell_h: int = 8, max_chars: int = 28080, pad: int = 4, marker: int = 1) -> tuple[int, int, int, int, int]:
    """(rows, pages, rows of the last page, width, height of the last page)."""
    rows = [r for line in text.split("\n") for r in wrap(expand_tabs(line), cols, marker)]
    limit = max(1, min((height - 2 * pad) // cell_h, max(1, max_chars // max(1, cols))))
    pages, lines, chars = 1, 0, 0
    for _, n in rows:
        more = n + (1 if lines else 0)
        if lines and (lines >= limit or chars + more > max_chars):
            pages, lines, chars = pages + 1, 0, 0
            more = n
        lines += 1
        chars += more
    return len(rows), pages, lines, 2 * pad + cols * cell_w, 2 * pad + lines * cell_h


class Pager:
    """Pages of one growing line: what ``geometry`` gives for the whole line, without laying it out again.

    A row is kept open until the next character no longer fits it.
    """

    def __init__(self, cols: int, limit: int, max_chars: int, marker: int = 1):
        self.cols, self.limit, self.max_chars, self.marker = cols, max(1, limit), max_chars, marker
        self.column = self.used = self.n = self.lines = self.chars = 0
        self.full = 1  # pages begun, without the open row

    def _close(self) -> None:
        """The open row goes to its page."""
        more = self.n + (1 if self.lines else 0)
        if self.lines and (self.lines >= self.limit or self.chars + more > self.max_chars):
            self.full, self.lines, self.chars, more = self.full + 1, 0, 0, self.n
        self.lines += 1
        self.chars += more
        self.used = self.n = 0

    def feed(self, text: str) -> None:
        for c in text:
            if c == "\t":
                pad = 4 - self.column % 4
                expanded = "→" + " " * (pad - 1)
                self.column += pad
            else:
                expanded = c
                self.column += cell(c)
            for x in expanded:
                w = cell(x, self.marker)
                if self.n and self.used + w > self.cols:
                    self._close()
                self.used += w
                self.n += 1

    def pages(self, more: str = "") -> int:
        """Pages of the line with ``more`` at its end, which is not kept."""
        state = dict(self.__dict__)
        self.feed(more)
        self._close()
        found = self.full
        self.__dict__.update(state)
        return found


#: Characters from which on one may be wide or combining; tabs are expanded.
UNSURE = f"[\\x{{300}}-\\x{{10FFFF}}\t\n&&[^{SENTINEL}]]"
_FIELDS = ("rows", "pages", "last_rows", "width", "height")


def narrow_geometry(chars: Column, cols: int, height: int = 728, cell_w: int = 5, cell_h: int = 8, max_chars: int = 28080, pad: int = 4) -> Column:
    """The struct of page_geometry for one line of ``chars`` characters of one cell each, in closed form.

    Full rows fill pages of ``deep`` rows each, as many as rows and characters allow;
    the rest row joins the last page if both still do, else it opens another.
    """
    limit = max(1, min((height - 2 * pad) // cell_h, max(1, max_chars // max(1, cols))))
    deep = max(1, min(limit, (max_chars + 1) // (cols + 1)))
    full, rest = F.floor(chars / cols), chars % cols
    pages = F.ceil(full / deep)
    last = full - (pages - 1) * deep
    joins = (last < limit) & (last * (cols + 1) + rest <= max_chars)
    pages, last = (
        F.when(full == 0, 1).when((rest == 0) | joins, pages).otherwise(pages + 1).cast("long"),
        F.when((full == 0) | (rest > 0) & ~joins, 1).when(rest == 0, last).otherwise(last + 1).cast("long"),
    )
    rows = F.greatest(F.lit(1), F.ceil(chars / cols)).cast("long")
    return F.struct(rows.alias("rows"), pages.alias("pages"), last.alias("last_rows"), F.lit(2 * pad + cols * cell_w).cast("long").alias("width"), (last * cell_h + 2 * pad).alias("height"))


def with_page_geometry(df: DataFrame, text: str, cols: int, out: str = "geometry", marker: int = 1, **options) -> DataFrame:
    """``df`` plus struct<rows, pages, last_rows, width, height> of its texts (null: empty).

    Lines of narrow characters are worked out by built-in functions; only texts that hold
    a character which may be wide or combining, a tab or a newline go to Python.
    """

    @F.pandas_udf(", ".join(f"{f} long" for f in _FIELDS))
    def run(texts: pd.Series) -> pd.DataFrame:
        none = (None,) * len(_FIELDS)
        return pd.DataFrame([none if t is None else geometry(t, cols, marker=marker, **options) for t in texts], columns=list(_FIELDS), dtype="Int64")

    body = F.coalesce(F.col(text), F.lit(""))
    unsure = body.rlike(UNSURE) if marker == 1 else body.rlike(UNSURE) | F.contains(body, F.lit(SENTINEL))
    df = df.withColumn("_unsure", F.when(unsure, body))
    found = F.when(F.col("_unsure").isNull(), narrow_geometry(F.length(body), cols, **options)).otherwise(run("_unsure"))
    return df.withColumn(out, found).drop("_unsure")


def escape_uncovered(line: str, covered: set[str]) -> str:
    """Characters without a glyph as [U+HEX]; controls, combining marks and variation selectors stay."""
    return "".join(c if c in covered or ord(c) < 32 or unicodedata.combining(c) or 0xFE00 <= ord(c) <= 0xFE0F else f"[U+{ord(c):04X}]" for c in line)
