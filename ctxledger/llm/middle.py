"""Fill-in-the-middle transformation by rotating blocks in place.

A document's bytes lie in one bytearray. Line ends are scanned for the two cuts, the
sentinels are put in at the places where the parts begin, so that the buffer reads
prefix, middle, suffix; then parts change places by rotations, each of three reversals:
psm exchanges middle and suffix, spm moves the suffix to the front. The inverse rotation
and the removal of the sentinels give the text back, from the output and its form alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxledger.llm import _text as T
from ctxledger.llm._work import table

#: What marks prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = len(PREFIX)
#: Bytes that a reversal swaps at once.
SWAP = 1 << 16


def _reverse(view: np.ndarray, lo: int, hi: int) -> None:
    """Reverse view[lo:hi] in place, a block from either end at a time."""
    while hi - lo > 1:
        n = min(SWAP, (hi - lo) // 2)
        head = view[lo : lo + n].copy()
        view[lo : lo + n] = view[hi - n : hi][::-1]
        view[hi - n : hi] = head[::-1]
        lo, hi = lo + n, hi - n


def rotate(view: np.ndarray, lo: int, mid: int, hi: int) -> None:
    """Exchange the blocks view[lo:mid] and view[mid:hi] in place."""
    _reverse(view, lo, mid)
    _reverse(view, mid, hi)
    _reverse(view, lo, hi)


def cuts(raw: np.ndarray, first: int, second: int) -> tuple[int, int, int]:
    """(n, end of the prefix, end of the middle): lines of a text, and where two draws cut it.

    A line ends with its line feed; what follows the last one is a line if there is
    anything. A cut falls after as many lines as its draw leaves modulo n + 1.
    """
    ends = np.flatnonzero(raw == 10) + 1
    n = len(ends) + (len(raw) > (int(ends[-1]) if len(ends) else 0))
    at = [0 if k == 0 else int(ends[k - 1]) if k <= len(ends) else len(raw) for k in sorted((first % (n + 1), second % (n + 1)))]
    return n, at[0], at[1]


def arrange(raw: np.ndarray, prefix: int, middle: int, form: str) -> bytearray:
    """The output of a text whose prefix and middle end at these bytes."""
    out = bytearray(raw.tobytes())
    for at, mark in ((middle, SUFFIX), (prefix, MIDDLE), (0, PREFIX)):
        out[at:at] = mark
    view = np.frombuffer(out, np.uint8)
    m, s = prefix + MARK, middle + 2 * MARK
    rotate(view, m if form == "psm" else 0, s, len(out))
    del view
    return out


def restore(output: bytes, form: str) -> bytes:
    """The text of an output: no sentinel occurs in a text that was arranged, so each is found where it was put."""
    if form == "plain":
        return output
    out = bytearray(output)
    view = np.frombuffer(out, np.uint8)
    if form == "psm":  # P, S, M
        rotate(view, out.find(SUFFIX), out.find(MIDDLE), len(out))
    else:  # S, P, M
        rotate(view, 0, out.find(PREFIX), len(out))
    del view
    for mark in (SUFFIX, MIDDLE, PREFIX):  # the last first, so that the others stay where they are
        at = out.find(mark)
        del out[at : at + MARK]
    return bytes(out)


def _draws(seed: int, doc_id) -> list[int]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def _characters(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def _arranged(seed: int, rate: int, spm: int):
    def run(batches):
        for b in T.slices(batches):
            raw, off = T.buffers(b.column("text"))
            rows: list[tuple] = []
            for doc_id, lo, hi in zip(b.column("doc_id").to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                text = raw[lo:hi]
                h1, h2, h3, h4 = _draws(seed, doc_id)
                n, prefix, middle = cuts(text, h1, h2)
                whole = text.tobytes()
                if not whole or h3 % 100 >= rate or any(mark in whole for mark in (PREFIX, SUFFIX, MIDDLE)):
                    rows.append((n, "plain", None, None, whole))
                    continue
                form = "spm" if h4 % 100 < spm else "psm"
                rows.append((n, form, _characters(text[:prefix]), _characters(text[prefix:middle]), bytes(arrange(text, prefix, middle, form))))
            n, forms, before, within, outputs = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(c, k) for c, k in zip((n, forms, before, within), kinds[:4], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns, pa.array(outputs, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


ARRANGED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """One row per document: doc_id, n (lines), form, prefix_chars, middle_chars, output.

    ``rate`` percent of the documents are arranged, ``spm`` percent of these with the
    suffix first; a hash of ``seed`` and doc_id decides, and draws the cuts. The rest
    are plain, as are empty and null texts (an empty output, n = 0) and texts that hold
    a sentinel; plain ones have null prefix_chars and middle_chars. A null doc_id draws
    as an empty one; repeated rows come out alike; other columns are ignored; an empty
    table gives no rows. No shuffle: each text is arranged where it is read, one at a time.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_arranged(seed, rate, spm), ARRANGED)


def restored(arranged: DataFrame) -> DataFrame:
    """``arranged`` with ``text``, rebuilt from its columns form and output."""
    names = arranged.columns

    def run(batches):
        for b in T.slices(batches, "output"):
            texts = [restore(o.as_buffer().to_pybytes(), f) for o, f in zip(b.column("output").cast(pa.binary()), b.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in arranged.schema.fields)
    return arranged.mapInArrow(run, f"{fields}, text string")


def op13_block_rotation(spark, sf_dir):
    out = restored(fill_in_middle(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS u, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::UBIGINT) AS h FROM d),
c AS (SELECT doc_id, t, u, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(list_slice(u, 1, a), '') AS prefix, array_to_string(list_slice(u, a + 1, b), '') AS middle, array_to_string(list_slice(u, b + 1, n), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
