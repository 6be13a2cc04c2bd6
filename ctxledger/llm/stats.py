"""Exact per-document text statistics, computed in one vectorised pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxledger.llm import _text as T

#: Column -> bytes counted. The symbols come from the contract.
CLASSES = {
    "n_symbols": b"#*$%&|<>",
    "n_upper": bytes(range(65, 91)),
    "n_lower": bytes(range(97, 123)),
    "n_digits": bytes(range(48, 58)),
    "n_bangs": b"!",
    "n_stops": b".?!",
}
COUNTS = ("n_words", "word_chars", *CLASSES, "n_wide", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct")
SCHEMA = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS)])


def _per_text(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _bytes_in(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Bytes of each text that ``table`` marks."""
    out = np.zeros(len(offsets) - 1, np.int64)
    for lo, hi in T.segments(raw, offsets):
        at = np.clip(offsets, lo, hi) - lo
        out += _per_text(table[raw[lo:hi]], at)
    return out


def _repeats(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once in its text."""
    mixed = T.mix(keys ^ (doc.astype(np.uint64) + T.U64(1)) * T.U64(0x9E3779B97F4A7C15))
    order = np.argsort(mixed)
    ordered = mixed[order]
    same = ordered[1:] == ordered[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def measure(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of ``COUNTS`` for each text."""
    w = T.words(raw, offsets, fold=False)
    out = {"n_words": w.counts.astype(np.int64)}
    table = np.zeros(256, bool)
    table[(np.arange(256) & 0xC0) != 0x80] = True
    table &= ~T.SEPARATOR
    out["word_chars"] = _bytes_in(raw, offsets, table)
    for name, members in CLASSES.items():
        table = np.zeros(256, bool)
        table[list(members)] = True
        out[name] = _bytes_in(raw, offsets, table)
    table = np.zeros(256, bool)
    table[0xC0:] = True
    out["n_wide"] = _bytes_in(raw, offsets, table)

    cuts = np.flatnonzero(raw == 10)
    start = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
    doc = np.clip(np.searchsorted(offsets, start, "right") - 1, 0, max(0, len(offsets) - 2))
    # a line ends at its newline or with its text; empty texts and lines share a start with the next and hold no word
    nl = np.append(cuts, len(raw))
    end = np.minimum(nl[np.searchsorted(cuts, start)], offsets[doc + 1]) if len(start) else start
    filled = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, doc = start[filled], end[filled], doc[filled]
    lines = np.bincount(doc, minlength=len(offsets) - 1)
    keys = T.mix(T.range_hashes(raw, start, end) ^ (doc.astype(np.uint64) + T.U64(1)) * T.U64(0x9E3779B97F4A7C15))
    _, at = np.unique(keys, return_index=True)
    out["n_lines"] = lines.astype(np.int64)
    out["n_dup_lines"] = (lines - np.bincount(doc[at], minlength=len(offsets) - 1)).astype(np.int64)

    h, at = T.windows(w, 3)
    wdoc = np.searchsorted(w.first, at, "right") - 1
    twice = at[_repeats(h, wdoc)]
    covered = np.zeros(len(w.hash), bool)
    for j in range(3):
        covered[twice + j] = True
    out["n_repeat_words"] = _per_text(covered, w.first)
    wdoc = w.doc()
    _, at = np.unique(T.mix(w.hash ^ (wdoc.astype(np.uint64) + T.U64(1)) * T.U64(0x9E3779B97F4A7C15)), return_index=True)
    out["n_distinct"] = np.bincount(wdoc[at], minlength=len(offsets) - 1).astype(np.int64)
    return out


def _run(batches):
    for b in T.slices(batches):
        found = measure(*T.buffers(b.column("text")))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(found[c]) for c in COUNTS)], names=["doc_id", *COUNTS])


def text_stats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and the columns of ``COUNTS`` over the whole text.

    word_chars counts code points in words; n_lines and n_dup_lines count
    newline-split lines that hold a word (all, and those equal to an earlier line);
    n_repeat_words counts words inside a 3-word window found twice or more; n_distinct
    counts distinct words. A null text counts as empty, all zero.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_run, SCHEMA)
