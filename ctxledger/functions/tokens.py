"""Exact token counts with a user's byte-pair ranks, and sections of turns by tokens."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField

from ctxledger.functions.folds import fold
from ctxledger.functions.text import PIECES


#: Distinct pieces whose counts a worker remembers.
REMEMBER = 200_000


def merge_count(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens of a piece: the adjacent pair of lowest rank, the first of equals, merges until none has a rank.

    Pairs wait in a heap and parts are linked, so a long piece takes n log n steps.
    """
    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        """The pair that begins at part i, with the end it has now: a changed pair no longer matches its entry."""
        if i >= 0 and after[i] < n:
            rank = ranks.get(piece[i : end[after[i]]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[after[i]]))

    for i in range(n - 1):
        offer(i)
    parts = n
    while heap:
        _, i, z = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != z:
            continue
        gone = after[i]
        end[i], after[i], alive[gone] = z, after[gone], False
        if after[i] < n:
            before[after[i]] = i
        parts -= 1
        offer(before[i])
        offer(i)
    return parts


def bpe_count(texts: DataFrame, ranks: DataFrame, key: str = "doc_id", limit: int = 500_000) -> DataFrame:
    """(key, tokens), a row for each row of ``texts`` (key, text): exact counts with ``ranks`` (token binary, rank long).

    Spark cuts texts into pieces, and each task merges the pieces that it has not met
    yet: no shuffle, whatever pieces are frequent and whatever keys repeat. A null text
    has no tokens. The rank table is broadcast after its size is checked.
    """
    spark = texts.sparkSession
    if ranks.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} ranks")
    table = spark.sparkContext.broadcast({bytes(r["token"]): r["rank"] for r in ranks.collect()})
    rows = texts.select(key, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(PIECES), F.lit(0)).alias("pieces"))

    def run(batches):
        known, memo = table.value, {}
        for b in batches:
            pieces = b.column("pieces")
            first = np.asarray(pieces.offsets)
            found = pieces.values.slice(first[0], first[-1] - first[0]).dictionary_encode()
            sizes = []
            for piece in found.dictionary.to_pylist():
                if piece not in memo:
                    if len(memo) >= REMEMBER:
                        memo.clear()
                    memo[piece] = merge_count(piece.encode(), known)
                sizes.append(memo[piece])
            total = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64)[np.asarray(found.indices)])]) if len(found) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(total[first[1:] - first[0]] - total[first[:-1] - first[0]])], names=[key, "tokens"])

    return rows.mapInArrow(run, f"{key} {dict(texts.dtypes)[key]}, tokens long")


def token_sections(turns: DataFrame, least: int = 2000, key: str = "conv_id") -> DataFrame:
    """``turns`` (key, idx, tokens, open_calls, pinned) plus section: a section closes at ``least`` tokens with no open call; a pinned turn stands alone.

    The sum restarts at each close, so it is a fold over one conversation's turns.
    """

    def rule():
        section = total = 0

        def step(tokens, open_calls, pinned):
            nonlocal section, total
            if pinned and total:
                section, total = section + 1, 0
            mine = section
            total += tokens
            if pinned or total >= least and not open_calls:
                section, total = section + 1, 0
            return mine

        return step

    rows = turns.select(key, F.col("idx").cast("long"), F.col("tokens").cast("long"), F.col("open_calls").cast("long"), F.col("pinned").cast("boolean"))
    return fold(rows, key, ["idx"], rule, ["tokens", "open_calls", "pinned"], StructField("section", LongType()))


def prefix_fit(rounds: DataFrame, pages: int, key: str = "request_id") -> DataFrame:
    """``rounds`` (key, run, idx, pages: of the run's prefix up to idx) plus taken: each run in order takes its longest prefix that fits the pages left."""

    def rule():
        left, taken, now = pages, 0, None

        def step(run, size):
            nonlocal left, taken, now
            if run != now:
                left, taken, now = left - taken, 0, run
            if size > left:
                return False
            taken = max(taken, size)
            return True

        return step

    rows = rounds.select(key, F.col("run").cast("long"), F.col("idx").cast("long"), F.col("pages").cast("long"))
    return fold(rows, key, ["run", "idx"], rule, ["run", "pages"], StructField("taken", BooleanType()))
