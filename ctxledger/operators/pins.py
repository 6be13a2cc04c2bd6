"""Standing instructions: pin and unpin commands in conversations."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, StructField

from ctxledger.functions import text as X
from ctxledger.functions.folds import fold as fold_rows

#: The most units of a pin, and of all pins shown.
PIN_MOST, BLOCK_MOST = 300, 2000
#: What a pin that was cut ends with.
CUT_NOTE = "… [pin truncated]"
MARKER = "@ctx"


def _command(marker: str) -> str:
    return rf"^{re.escape(marker)}[ \t]+(pin|unpin)\b(.*)$"


def pin_command(line: Column, marker: str = MARKER) -> Column:
    """struct<verb, rest> of a trimmed line, or null."""
    verb = F.regexp_extract(F.trim(line), _command(marker), 1)
    return F.when(verb != "", F.struct(verb.alias("verb"), F.trim(F.regexp_extract(F.trim(line), _command(marker), 2)).alias("rest")))


def command_turns(turns: DataFrame, marker: str = MARKER) -> DataFrame:
    """Turns that hold a command, and whether they hold nothing else (reminders and blank lines aside)."""
    found = turns.where(F.contains("text", F.lit(marker)))
    lines = F.filter(F.transform(F.split(F.regexp_replace("text", r"(?s)<system-reminder>.*?</system-reminder>", ""), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    is_command = lambda x: x.rlike(_command(marker))
    out = found.withColumns({"commands": F.size(F.filter(lines, is_command)), "only_commands": (F.size(lines) > 0) & F.forall(lines, is_command)})
    return out.where("commands > 0")


def _cut(text: str) -> str:
    """A pin's text, PIN_MOST units of it and a note if it is longer."""
    units = text.encode("utf-16-be", "surrogatepass")
    return text if len(units) <= 2 * PIN_MOST else units[: 2 * PIN_MOST].decode("utf-16-be", "replace") + CUT_NOTE


class Pins:
    """The pins in force while commands come one after the other: (text, source, path), oldest first."""

    def __init__(self):
        self.now: list[tuple[str, str, str | None]] = []

    def apply(self, source: str, verb: str, rest: str, path: str | None = None) -> None:
        """File pins repeat, and an empty one stands for a blank line after one that is not; session pins are unique by text."""
        if verb == "unpin":
            self._unpin(rest)
            return
        text = _cut(rest)
        if source == "file":
            if text or self.now and self.now[-1][0]:
                self.now.append((text, source, path))
        elif text and all(t != text for t, _, _ in self.now):
            self.now.append((text, source, None))

    def _unpin(self, rest: str) -> None:
        """All session pins, the one of a number among them, or the first of that text, or else of that beginning in any case."""
        mine = [i for i, p in enumerate(self.now) if p[1] == "session"]
        if rest == "all":
            self.now = [p for p in self.now if p[1] != "session"]
        elif rest.isdigit() and rest.isascii():
            if 1 <= int(rest) <= len(mine):
                self.now.pop(mine[int(rest) - 1])
        elif rest:
            same = [i for i in mine if self.now[i][0] == rest] or [i for i in mine if self.now[i][0].lower().startswith(rest.lower())]
            if same:
                self.now.pop(same[0])


def fold(lines: list[tuple[str, str, str]]) -> list[tuple[str, str]]:
    """(text, source) of the pins left after (source, verb, rest) commands in order."""
    pins = Pins()
    for source, verb, rest in lines:
        pins.apply(source, verb, rest)
    return [(t, s) for t, s, _ in pins.now]


def standing_instructions(turns: DataFrame, key: str = "conv_id", marker: str = MARKER) -> DataFrame:
    """Pins in force after each conversation's last turn: key, pin_no, text, source, path (of the file that a system text quotes).

    System lines come first as file pins, then user lines in order. Only command
    lines are shuffled; Spark sorts them, and a task streams them with the pins of one
    conversation at a time, however many commands it holds.
    """
    lines = turns.where(F.contains("text", F.lit(marker)) & F.col("role").isin("system", "user"))
    path = F.when(F.col("role") == "system", X.source_path(F.col("text")))
    lines = lines.select(key, "idx", "role", path.alias("path"), F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("c", pin_command(F.col("line"), marker)).where("c is not null")
    rows = lines.select(key, (F.col("role") == "user").cast("int").alias("late"), F.col("idx").cast("long").alias("idx"), "n", F.col("c.verb").alias("verb"), F.col("c.rest").alias("rest"), "path")
    kind = to_arrow_type(rows.schema[key].dataType)

    def run(batches):
        now, pins, any_yet = None, Pins(), False

        def done():
            n = len(pins.now)
            columns = list(zip(*pins.now, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array([now] * n, kind), pa.array(range(n), pa.int64()), *(pa.array(c, pa.string()) for c in columns)], names=[key, "pin_no", "text", "source", "path"])

        for b in batches:
            for k, late, verb, rest, where in zip(*(b.column(c).to_pylist() for c in (key, "late", "verb", "rest", "path")), strict=True):
                if any_yet and k != now:
                    yield done()
                    pins = Pins()
                now, any_yet = k, True
                pins.apply("session" if late else "file", verb, rest, where)
        if any_yet:
            yield done()

    dealt = rows.repartition(key).sortWithinPartitions(key, "late", "idx", "n")
    return dealt.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, pin_no long, text string, source string, path string")


def shown_pins(pins: DataFrame, key: str = "conv_id", most: int = BLOCK_MOST) -> DataFrame:
    """``pins`` (key, pin_no, units) plus shown: in order, one that no longer fits ``most`` units is skipped, later ones may fit."""

    def rule():
        left = most

        def step(units):
            nonlocal left
            fits = units <= left
            left -= units if fits else 0
            return fits

        return step

    return fold_rows(pins.select(key, "pin_no", F.col("units").cast("long")), key, ["pin_no"], rule, ["units"], StructField("shown", BooleanType()))


def pin_block(pins: list[str], most: int = BLOCK_MOST) -> list[str]:
    """Pins that fit the block in order, in UTF-16 units; one that does not is skipped, later ones may."""
    out, used = [], 0
    for p in pins:
        n = len(p.encode("utf-16-be", "surrogatepass")) // 2
        if used + n <= most:
            out.append(p)
            used += n
    return out
