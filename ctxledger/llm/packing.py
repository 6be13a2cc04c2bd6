"""Packing of tokenised documents into windows by the sum-of-squares rule.

Each task packs the documents of its input split as they come. A document's full
windows stand alone. Of its rest, as much as is a multiple of GRAIN ids is one item; what is
left, under GRAIN ids, follows the tails of earlier documents, and every GRAIN ids of
them are an item too. So an item fills whole units, and a window has few levels. An item goes
to the fill level h for which the sum over levels of N(h)**2 (N: windows partially
filled to level h) grows least, a new window being level 0. Levels are few and counts
meet, so placement alone fills the windows and few are ever open.

At most OPEN windows are open, a bound on memory that an item meets only where the
rule itself leaves thousands partially filled: then it is cut to fill the level
whose emptying lowers the sum most, and the sequence says so. At the end of the split the
open windows are consolidated: pieces of the emptiest are cut to close the gaps of the
fullest, and the last one is cut into lengths that are powers of two, which need no padding.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxledger.llm import _text as T
from ctxledger.llm._work import table

WINDOW = 1024
#: Ids of a unit: levels are counted in units.
GRAIN = 32
#: Windows that a task may hold open: 16 MB of ids.
OPEN = 4096
#: Fixed value: how the public byte-level vocabulary splits text into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct chunks whose ids a worker remembers.
REMEMBER = 600_000


def _ranked(path: str):
    """The same vocabulary in tiktoken, which merges faster, or None.

    Byte-level BPE merges by the order of its merge list; where ids follow that
    order, ids serve as ranks and both libraries give the same ids.
    """
    model = json.loads(open(path, encoding="utf-8").read())
    split, bpe = model.get("pre_tokenizer") or {}, model["model"]
    if bpe.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or model.get("normalizer"):
        return None
    vocabulary = bpe["vocab"]
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in bpe["merges"]]
    if any(x >= y for x, y in zip(merged, merged[1:], strict=False)):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    char = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in model.get("added_tokens", ())}
    import tiktoken

    ranks = {bytes(char[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids of many texts at once.

    The tokenizer splits text into pieces before merging, and no piece crosses a
    lone space between two characters that are not white space. Texts are cut
    there, and only chunks that are new to the worker are given to the tokenizer,
    joined again: the byte lengths of the ids tell where a chunk's ids end.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.ranked = _ranked(path)
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size() + 1, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token)  # byte-level: one character stands for a byte
        self.forget()

    def forget(self):
        self.slot: dict[int, int] = {}
        self.start, self.size, self.pool = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        self.used = 0

    @staticmethod
    def cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where chunks begin: each text's start, and each safe space in it."""
        n = len(raw)
        if n < 3:
            return np.unique(offsets[:-1][np.diff(offsets) > 0])
        blank = np.zeros(256, bool)
        blank[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
        lead = np.zeros(256, bool)  # first bytes of multi-byte characters that may be white space
        lead[[0xC2, 0xE1, 0xE2, 0xE3]] = True
        at = np.flatnonzero(raw[1:-1] == 32) + 1
        before, after = raw[at - 1], raw[at + 1]
        tail = before >= 0x80
        unsure = tail & (lead[raw[np.maximum(at - 2, 0)]] | lead[raw[np.maximum(at - 3, 0)]])
        at = at[~blank[before] & ~unsure & ~blank[after] & ~lead[after]]
        edge = np.zeros(n + 2, bool)
        edge[offsets] = True
        at = at[~edge[at] & ~edge[at + 1]]  # both neighbours belong to the same text
        first = np.zeros(n, bool)
        first[at] = True
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(first)

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids)."""
        start = self.cuts(raw, offsets)
        end = np.append(start[1:], len(raw))[: len(start)]
        keys = T.range_hashes(raw, start, end)
        distinct, where, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.slot) > REMEMBER:
            self.forget()
        known = np.array([self.slot.get(k, -1) for k in distinct.tolist()], np.int64)
        new = np.flatnonzero(known < 0)
        if len(new):
            lo, hi = start[where[new]], end[where[new]]
            edge = np.zeros(len(raw) + 1, bool)
            edge[offsets] = True
            whole = edge[lo] | edge[hi]  # a text's first and last chunk may not be joined to others
            order = np.argsort(whole, kind="stable")
            new, lo, hi = new[order], lo[order], hi[order]
            joined = int((~whole).sum())
            size = (hi - lo)[:joined]
            ends = np.cumsum(size)
            blob = raw[np.repeat(lo[:joined] - (ends - size), size) + np.arange(int(ends[-1]) if joined else 0)].tobytes()
            texts = [blob.decode("utf-8")] if joined else []
            if self.ranked is not None and joined:
                texts = []
            alone = [raw[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(lo[joined:].tolist(), hi[joined:].tolist(), strict=True)]
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts + alone, add_special_tokens=False)]
            if self.ranked is not None and joined:
                found.insert(0, self.ranked.encode_to_numpy(blob.decode("utf-8"), disallowed_special=()))
            upto = [np.zeros(1, np.int64)]
            if joined:
                upto.append(np.searchsorted(np.cumsum(self.bytes_of[found[0]]), ends, "left") + 1)
                sizes = np.diff(np.concatenate(upto))
            else:
                sizes = np.zeros(0, np.int64)
            sizes = np.concatenate([sizes, np.array([len(x) for x in found[bool(joined) :]], np.int64)])
            base = len(self.slot)
            known[new] = base + np.arange(len(new))
            self.slot.update(zip(distinct[new].tolist(), range(base, base + len(new)), strict=True))
            self.start.append(self.used + np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            self.size.append(sizes)
            self.pool += found
            self.used += int(sizes.sum())
            for name in ("start", "size", "pool"):
                setattr(self, name, [np.concatenate(getattr(self, name))])
        slots = known[back.reshape(-1)]
        size = self.size[0][slots]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[0][np.repeat(self.start[0][slots] - (ends - size), size) + np.arange(total)]
        edges = np.concatenate([[0], ends])
        return ids, edges[np.searchsorted(start, offsets)]


class SumOfSquares:
    """Online placement of rests into windows, with an array of open windows by fill level (in units of ``grain`` ids)."""

    def __init__(self, window: int, first_id: int, most_open: int = OPEN, grain: int = GRAIN):
        self.window, self.grain, self.full = window, grain, window // grain
        self.next, self.most_open = first_id, most_open
        self.count = np.zeros(self.full + 1, np.int64)  # the level array; level 0 and the full level cost nothing
        self.open: list[list[list[tuple]]] = [[] for _ in range(self.full)]
        self.held = 0
        self.tail: list[tuple] = []  # pieces of under a unit of ids together
        self.tail_ids = 0
        self.rows: list[tuple] = []

    def emit(self, pieces: list, closed: str) -> None:
        """A closed sequence; pieces are (doc_id, start, ids, doc_tokens)."""
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            self.rows.append((doc_id, start, len(ids), ids.tobytes(), doc_tokens, self.next, offset, closed))
            offset += len(ids)
        self.next += 1

    def _take(self, level: int) -> list:
        """An open window of a level, no longer open."""
        self.count[level] -= 1
        self.held -= 1
        return self.open[level].pop()

    def _level(self, size: int) -> int | None:
        """The level that an item of ``size`` units goes to whole; None if there is none."""
        levels = np.flatnonzero(self.count[: self.full - size + 1])
        # change of the sum of squares: leaving level h, entering level h + size
        enter = 2 * self.count + 1
        enter[self.full] = 0
        new = self.held < self.most_open
        if len(levels):
            change = 1 - 2 * self.count[levels] + enter[levels + size]
            i = len(levels) - 1 - int(change[::-1].argmin())  # ties: the fullest
            if not new or change[i] <= enter[size]:
                return int(levels[i])
        return 0 if new else None

    @staticmethod
    def cut(pieces: list, ids: int) -> tuple[list, list]:
        """The first ``ids`` ids of pieces, and the rest."""
        head, rest = [], list(pieces)
        while ids:
            doc_id, start, own, n = rest.pop(0)
            head.append((doc_id, start, own[:ids], n))
            if ids < len(own):
                rest.insert(0, (doc_id, start + ids, own[ids:], n))
            ids -= min(ids, len(own))
        return head, rest

    def place(self, pieces: list, size: int) -> None:
        """An item: pieces of ``size`` units together."""
        while (level := self._level(size)) is None:
            levels = np.flatnonzero(self.count[: self.full])
            fill = int(levels[len(levels) - 1 - int(self.count[levels][::-1].argmax())])
            room = self.full - fill
            head, pieces = self.cut(pieces, room * self.grain)
            self.emit([*self._take(fill), *head], "cut")
            size -= room
        held = self._take(level) if level else []
        held += pieces
        level += size
        if level == self.full:
            self.emit(held, "placed")
        else:
            self.open[level].append(held)
            self.count[level] += 1
            self.held += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        n = len(ids)
        lo = n - n % self.window
        for x in range(0, lo, self.window):
            self.emit([(doc_id, x, ids[x : x + self.window], n)], "document")
        if size := (n - lo) // self.grain:
            self.place([(doc_id, lo, ids[lo : lo + size * self.grain], n)], size)
            lo += size * self.grain
        if lo < n:
            self.tail.append((doc_id, lo, ids[lo:], n))
            self.tail_ids += n - lo
            if self.tail_ids >= self.grain:
                item, self.tail = self.cut(self.tail, self.grain)
                self.tail_ids -= self.grain
                self.place(item, 1)

    def close(self) -> None:
        """Consolidate the open windows; one may be short, and it is cut at powers of two."""
        left = [p for level in range(self.full - 1, 0, -1) for p in self.open[level]]
        left += [self.tail] if self.tail else []
        fills = [sum(len(x[2]) for x in p) for p in left]
        i, j = 0, len(left) - 1
        while i < j:
            gap = self.window - fills[i]
            if not gap:
                self.emit(left[i], "end")
                i += 1
                continue
            doc_id, start, ids, n = left[j].pop()
            take = min(gap, len(ids))
            left[i].append((doc_id, start, ids[:take], n))
            if take < len(ids):
                left[j].append((doc_id, start + take, ids[take:], n))
            fills[i] += take
            fills[j] -= take
            if not fills[j]:
                j -= 1
        if i == j and fills[i]:
            rest, size, have = left[i], self.window, fills[i]
            while rest:
                while size > have:
                    size //= 2
                part, rest = self.cut(rest, size)
                have -= size
                self.emit(part, "end")
        self.open = [[] for _ in range(self.full)]
        self.count[:] = 0
        self.held, self.tail, self.tail_ids = 0, [], 0


SCHEMA = "doc_id long, start long, length long, tokens binary, doc_tokens long, sequence_id long, offset long, closed string"


def _pack(path: str | None, window: int):
    def run(batches):
        where = path
        if where is None:
            import public_tokenizers

            where = public_tokenizers.path("byte_bpe_50k.json")
        encode = Encoder(where)
        packer = SumOfSquares(window, TaskContext.get().partitionId() << 40)

        def flush():
            columns = list(zip(*packer.rows, strict=True)) or [[]] * 8
            packer.rows = []
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for b in T.slices(batches):
            raw, off = T.buffers(b.column("text"))
            ids, first = encode(raw, off)
            for i, doc_id in enumerate(b.column("doc_id").to_pylist()):
                packer.add(doc_id, np.append(ids[first[i] : first[i + 1]], np.uint32(0)))
            yield flush()
        packer.close()
        yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, tokens, doc_tokens, sequence_id, offset, closed.

    closed tells what closed the sequence: ``document``, which fills it alone; ``placed``, an item
    that the rule put there whole; ``cut``, one cut because OPEN windows were open; ``end``
    of the split. tokens holds the piece's ids as little-endian unsigned 32-bit numbers. Each
    document ends with id 0, so a null or empty text has one token; each id lies in
    one piece; sequences are full, or have a power of two as length. Repeated rows
    are packed each; a null doc_id stays null; equal lengths are placed as they come. Sequence ids carry the input split's number, so a task that
    runs again after a lost executor gives the same rows. ``tokenizer`` is the path
    of a tokenizer file (default: the public byte-level vocabulary). Other columns
    are ignored; an empty table gives no rows. ``window`` is a multiple of GRAIN and a power of two.
    """
    if window % GRAIN or window & (window - 1):
        raise ValueError(f"a window of {window} ids")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pack(tokenizer, window), SCHEMA)


def op9_sum_of_squares_packing(spark, sf_dir):
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "closed")
