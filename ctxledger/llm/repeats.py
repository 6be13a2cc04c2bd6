"""Repeated passages by suffix arrays of shards, exactly, over all texts.

Every string of ``width`` bytes (a window) is decided by content:

1. A window's mark is the least hash of the short strings in it. Runs of windows with
   one mark at one place make a piece; equal windows lie in pieces with equal marks. One
   pass counts the pieces of each mark. A mark seen once holds nothing repeated;
   where all pieces of a mark are equal, every window of theirs is repeated.
2. What is left are marks whose pieces differ. The distinct pieces of a mark go to
   one shard, whose suffix array is made by induced sorting; permuted common prefixes
   tell which windows occur more than once.
3. A mark with very many distinct pieces is dealt to several shards. Their windows
   that are not repeated within the shard, and one of each class that is, meet by hash.

Copies of a text share one row of findings. Marks, pieces and texts are told apart by
hashes of 128 bits (mark and digest; two of a text).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxledger.llm import _text as T
from ctxledger.llm import suffixes
from ctxledger.llm._work import materialize, read_columns, table, written

U64 = np.uint64
WIDTH = 200
#: Distinct pieces of a mark from which its pieces are dealt to several shards; bytes of a suffix array (whole marks, so a little more).
GROUP, SHARD = 2000, 1 << 21
#: Windows that are worked at once, and the bits of a place among them.
STEP, _PLACE = 1 << 20, 21
#: Bits of the bitmap that thins pieces before they are joined, and of a row of its table, as powers of two.
BITMAP, _ROW = 27, 20
#: Digests that a task remembers, so as to send equal pieces once.
SEEN = 1_000_000


def pieces(raw: np.ndarray, offsets: np.ndarray, width: int):
    """(start, size, times, mark, digest) of the pieces of several texts, in parts.

    ``times`` equal pieces that start one byte after the other (text of a short
    period) come as one. Long texts come in parts of STEP windows; a piece that is cut
    there differs from its copies elsewhere, and is compared like any other.
    """
    gram = max(1, width // 4)
    many = width - gram + 1  # short strings in a window
    ends = np.repeat(offsets[1:], np.diff(offsets))
    for lo in range(0, len(raw) - width + 1, STEP):
        b = raw[lo : lo + STEP + width - 1]
        n = len(b)
        up, down = T.powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(T._BYTE[b] * up[:n], out=total[1:])
        g = n - gram + 1
        key = T.mix((total[gram:] - total[:g]) * down[:g])
        key &= ~U64((1 << _PLACE) - 1)
        key |= np.arange(g, dtype=np.uint64)  # equal hashes: the leftmost
        # least of each run of ``many``: of the end of one block and the beginning of the next
        blocks = np.full(-(-g // many) * many, ~U64(0))
        blocks[:g] = key
        blocks = blocks.reshape(-1, many)
        begin = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        end = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        w = n - width + 1
        place = (np.minimum(end[:w], begin[many - 1 : many - 1 + w]) & U64((1 << _PLACE) - 1)).astype(np.int64)
        start = np.flatnonzero(np.arange(lo + width, lo + width + w) <= ends[lo : lo + w])
        if not len(start):
            continue
        at = place[start]
        first = np.flatnonzero(np.append(True, (start[1:] != start[:-1] + 1) | (at[1:] != at[:-1])))
        last = start[np.append(first[1:], len(start)) - 1] + width
        start, at = start[first], at[first]
        size = last - start
        mark = T.mix(T.mix((total[at + gram] - total[at]) * down[at]) + U64(gram))
        digest = T.mix((total[last] - total[start]) * down[start] + size.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
        run = np.flatnonzero(np.append(True, (mark[1:] != mark[:-1]) | (digest[1:] != digest[:-1]) | (start[1:] != start[:-1] + 1)))
        yield start[run] + lo, size[run], np.diff(np.append(run, len(start))), mark[run], digest[run]


def _marks(width: int):
    def run(batches):
        for b in T.slices(batches):
            for _, _, times, mark, digest in pieces(*T.buffers(b.column("text")), width):
                order = np.lexsort((digest, mark))
                mark, digest, times = mark[order], digest.view(np.int64)[order], times[order]
                first = np.flatnonzero(np.append(True, mark[1:] != mark[:-1]))
                columns = (mark[first].view(np.int64), np.minimum.reduceat(digest, first), np.maximum.reduceat(digest, first), np.add.reduceat(times, first))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["mark", "low", "high", "n"])

    return run


def _bitmap(marks: DataFrame) -> str:
    """The path of a table (part, repeated, contested): bits of the leading BITMAP bits of marks."""

    def rows(batches):
        bits: dict[int, np.ndarray] = {}
        for b in batches:
            slot = (b.column("mark").to_numpy().view(np.uint64) >> U64(64 - BITMAP)).astype(np.int64)
            contested = b.column("contested").to_numpy(zero_copy_only=False)
            for part in np.unique(slot >> _ROW).tolist():
                both = bits.setdefault(part, np.zeros((2, 1 << _ROW), bool))
                here = slot >> _ROW == part
                both[0, slot[here] & ((1 << _ROW) - 1)] = True
                both[1, slot[here & contested] & ((1 << _ROW) - 1)] = True
        columns = [pa.array(list(bits), pa.int32()), *(pa.array([np.packbits(x[i]).tobytes() for x in bits.values()], pa.binary()) for i in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "repeated", "contested"])

    part = F.shiftrightunsigned("mark", 64 - BITMAP + _ROW)
    return written(marks.select("mark", "contested").repartition(part).mapInArrow(rows, "part int, repeated binary, contested binary"), "bitmap")


#: The worker's bitmaps, by their path.
_bitmaps: dict = {}


def _load(path: str) -> np.ndarray:
    if path not in _bitmaps:
        _bitmaps.clear()
        bits = np.zeros((2, 1 << (BITMAP - 3)), np.uint8)
        for part, *both in zip(*read_columns(path, ["part", "repeated", "contested"]), strict=True):
            for i, row in enumerate(both):
                bits[i, int(part) << (_ROW - 3) : (int(part) + 1) << (_ROW - 3)] = np.frombuffer(row, np.uint8)
        _bitmaps[path] = bits
    return _bitmaps[path]


def _hit(bits: np.ndarray, mark: np.ndarray) -> np.ndarray:
    at = (mark >> U64(64 - BITMAP)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


FOUND = "t1 long, t2 long, start long, size int, times long, mark long, digest long, bytes binary"


def _found(width: int, path: str):
    """Pieces whose mark may be repeated; where its pieces may differ, with their bytes, once a task."""

    def run(batches):
        repeated, contested = _load(path)
        seen: set[int] = set()
        for b in T.slices(batches):
            raw, off = T.buffers(b.column("text"))
            for start, size, times, mark, digest in pieces(raw, off, width):
                some = np.flatnonzero(_hit(repeated, mark))
                start, size, times, mark, digest = (x[some] for x in (start, size, times, mark, digest))
                text = np.searchsorted(off, start, "right") - 1
                sent: list = [None] * len(start)
                for i in np.flatnonzero(_hit(contested, mark)).tolist():
                    if (d := int(digest[i])) not in seen:
                        seen.add(d)
                        sent[i] = raw[start[i] : start[i] + size[i]].tobytes()
                if len(seen) > SEEN:
                    seen.clear()
                columns = [b.column("t1").take(pa.array(text)), b.column("t2").take(pa.array(text))]
                columns += [pa.array(start - off[text]), pa.array(size, pa.int32()), pa.array(times), pa.array(mark.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(sent, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in FOUND.split(", ")])

    return run


SHARDED = "mark long, digest long, lo int, hi int, hash long, n long"


def _shard(width: int, marks: np.ndarray, digests: np.ndarray, split: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
    """Repeated windows [lo, hi) of the pieces of a shard; of split marks also what the shards exchange."""
    size = np.array([len(x) for x in texts], np.int64)
    first = np.cumsum(size) - size
    t = np.frombuffer(b"".join(texts), np.uint8)
    piece = np.repeat(np.arange(len(texts)), size)
    whole = np.arange(len(t)) + width <= (first + size)[piece]
    sa = suffixes.suffix_array(t)
    of, n = suffixes.repeated(t, sa, suffixes.permuted_prefixes(t, sa), width, whole)
    at = np.flatnonzero(whole & (n > 1))
    begin = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (piece[at[1:]] != piece[at[:-1]]))[: len(at)])
    lo = at[begin]
    hi = at[np.append(begin[1:], len(at))[: len(begin)] - 1] + 1
    p = piece[lo]
    rows = [(marks[p], digests[p], lo - first[p], hi - first[p], None, np.zeros(len(p), np.int64))]
    shared = np.flatnonzero(whole & split[piece])
    if len(shared):
        up, down = T.powers(len(t) + 1)
        total = np.zeros(len(t) + 1, np.uint64)
        np.cumsum(T._BYTE[t] * up[: len(t)], out=total[1:])
        one = shared[n[shared] == 1]
        more = shared[n[shared] > 1]
        more = more[np.unique(of[more], return_index=True)[1]]
        for x, known in ((one, True), (more, False)):
            h = T.mix((total[x + width] - total[x]) * down[x] + U64(width)).view(np.int64)
            p = piece[x]
            rows.append((marks[p], digests[p] if known else None, x - first[p], x - first[p] + 1, h, n[x]))
    columns = []
    for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())):
        columns.append(pa.concat_arrays([pa.nulls(len(r[0]), kind) if r[i] is None else pa.array(r[i], kind) for r in rows]))
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SHARDED.split(", ")])


def _shards(width: int):
    """Rows come sorted by mark, salt and digest; a shard takes whole groups of mark and salt."""

    def run(batches):
        held, size, last = [[], [], [], []], 0, (None, None, None)
        for b in batches:
            rows = zip(b.column("mark").to_pylist(), b.column("salt").to_pylist(), b.column("digest").to_pylist(), b.column("salts").to_pylist(), b.column("bytes"), strict=True)
            for mark, salt, digest, salts, content in rows:
                if size > SHARD and last[:2] != (mark, salt):
                    yield _shard(width, np.array(held[0]), np.array(held[1]), np.array(held[2]), held[3])
                    held, size = [[], [], [], []], 0
                if last == (mark, salt, digest):
                    continue
                last = (mark, salt, digest)
                for x, v in zip(held, (mark, digest, salts > 1, content.as_py()), strict=True):
                    x.append(v)
                size += len(held[3][-1])
        if size:
            yield _shard(width, np.array(held[0]), np.array(held[1]), np.array(held[2]), held[3])

    return run


def _verdicts(contested: DataFrame, width: int) -> DataFrame:
    """(mark, digest, ranges) of pieces with repeated windows; ranges null: all of them."""
    counts = materialize(contested.groupBy("mark", "digest").agg(F.sum("times").alias("n")), "digests")
    hot = counts.groupBy("mark").agg(F.count("*").alias("distinct")).where(F.col("distinct") > GROUP)
    hot = materialize(hot.select("mark", F.ceil(F.col("distinct") / GROUP).cast("int").alias("salts")), "hot")
    sent = contested.where("bytes is not null").select("mark", "digest", "bytes").join(hot, "mark", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    sent = sent.withColumn("salt", F.pmod(F.xxhash64("digest"), F.col("salts")).cast("int"))
    sharded = materialize(sent.repartition("mark", "salt").sortWithinPartitions("mark", "salt", "digest").mapInArrow(_shards(width), SHARDED), "shards")
    windows = sharded.where("hash is not null")
    twice = windows.groupBy("mark", "hash").agg(F.sum("n").alias("all")).where("all > 1").select("mark", "hash")
    late = windows.where("digest is not null").join(twice, ["mark", "hash"], "left_semi")
    ranges = sharded.where("hash is null").unionByName(late).groupBy("mark", "digest").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    told = counts.join(ranges, ["mark", "digest"], "left").where("n > 1 or ranges is not null")
    return materialize(told.select("mark", "digest", F.when(F.col("n") == 1, F.col("ranges")).alias("ranges")), "verdicts")


def repeated_spans(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(t1, t2, spans) of each distinct text with repeated windows: the bytes [start, end) that repeated pieces cover, unmerged.

    ``texts`` has the columns t1, t2 (hashes of the text) and text, without nulls.
    """
    marks = texts.select("text").mapInArrow(_marks(width), "mark long, low long, high long, n long")
    marks = marks.groupBy("mark").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).where("n > 1")
    marks = materialize(marks.select("mark", (F.col("low") < F.col("high")).alias("contested")), "marks")
    found = texts.select("t1", "t2", "text").mapInArrow(_found(width, _bitmap(marks)), FOUND)
    found = materialize(found.join(marks, "mark"), "found")
    end = F.col("start") + F.col("size") + F.col("times") - 1
    covered = found.where("not contested").select("t1", "t2", "start", end.alias("end"))
    contested = found.where("contested")
    told = contested.select("t1", "t2", "start", end.alias("end"), "mark", "digest").join(_verdicts(contested, width), ["mark", "digest"])
    whole = F.array(F.struct(F.lit(0).alias("lo"), (F.col("end") - F.col("start") - width + 1).cast("int").alias("hi")))
    part = told.select("t1", "t2", "start", F.explode(F.coalesce("ranges", whole)).alias("r"))
    part = part.select("t1", "t2", (F.col("start") + F.col("r.lo")).alias("start"), (F.col("start") + F.col("r.hi") - 1 + width).alias("end"))
    spans = covered.unionByName(part).distinct()  # copies of a text found the same
    return spans.groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that the spans cover."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > reach[:-1])[: len(start)]
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:], len(start))[: len(first)] - 1]


def _removed(batches):
    for b in T.slices(batches):
        raw, off = T.buffers(b.column("text"))
        lists = b.column("spans")
        edges = np.concatenate([[0], np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))])
        flat = lists.flatten()
        starts, ends = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        first, spans, kept = [0], [np.zeros((0, 2), np.int64)], []
        for i in range(b.num_rows):
            text = raw[off[i] : off[i + 1]]
            s, e = _merged(starts[edges[i] : edges[i + 1]], ends[edges[i] : edges[i + 1]])
            spans.append(np.stack([s, e], axis=1))
            first.append(first[-1] + len(s))
            kept.append(b"".join(text[x:y].tobytes() for x, y in zip([0, *e.tolist()], [*s.tolist(), len(text)], strict=True)))
        runs = np.concatenate(spans)
        structs = pa.StructArray.from_arrays([pa.array(runs[:, 0].copy()), pa.array(runs[:, 1].copy())], names=["start", "end"])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(off)), pa.ListArray.from_arrays(pa.array(first, pa.int32()), structs), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (removed runs [start, end) of bytes, in order), kept (what is left, in bytes).

    A byte is removed if a string of ``width`` bytes over it also starts anywhere else in
    any document, the same one included, judged on the texts as given. Strings never
    cross documents. A null text is empty and, like any shorter than ``width``, loses nothing; repeated rows are
    copies and lose all that is long enough; null ids are kept as they are; other
    columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long"), text.alias("text")).select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"), "text")
    spans = materialize(repeated_spans(texts, width), "spans")
    return texts.join(spans, ["t1", "t2"], "left").select("doc_id", "text", "spans").mapInArrow(_removed, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op12_induced_suffix_dedup(spark, sf_dir):
    out = without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
