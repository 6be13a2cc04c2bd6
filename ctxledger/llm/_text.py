"""Vectorised text kernels shared by the operators of this subpackage.

Everything works on the UTF-8 bytes of an Arrow string array: no Python object
is made per word. A word is a maximal run of bytes outside 0x20 and 0x09-0x0D,
which is what the pattern ``[^\\x20\\x09-\\x0D]+`` matches in the decoded text,
because those bytes never occur inside a multi-byte character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes handled at once; bounds the memory of a kernel call (about 60 bytes per byte).
SEGMENT = 1 << 20

_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 2**64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n (grown on demand, kept per worker)."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT + 1)
        tables = []
        for base in (_P, _PINV):
            table = np.full(size, U64(base))
            table[0] = U64(1)
            tables.append(np.multiply.accumulate(table))
        _powers[:] = tables
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); spreads every input bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without a copy; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, column: str = "text", most: int = SEGMENT):
    """Cut record batches so that each holds about ``most`` bytes of text, at least one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def segments(raw: np.ndarray, offsets: np.ndarray, most: int = SEGMENT):
    """Ranges of about ``most`` bytes that begin and end between words or texts."""
    lo, n = 0, len(raw)
    while lo < n:
        hi = lo + most
        if hi >= n:
            hi = n
        else:
            cut = int(offsets[np.searchsorted(offsets, hi, "right") - 1])
            if cut <= lo:
                gaps = np.flatnonzero(SEPARATOR[raw[lo + 1 : hi]])
                if len(gaps):
                    cut = lo + 1 + int(gaps[-1])
                else:  # one word longer than a segment
                    step = hi
                    while step < n and not SEPARATOR[raw[step]]:
                        step += 1
                    cut = min(step, int(offsets[np.searchsorted(offsets, lo, "right")]))
            hi = cut
        yield lo, hi
        lo = hi


class Words:
    """Words of several texts: byte ranges, 64-bit hashes, and where each text's words begin."""

    __slots__ = ("start", "end", "hash", "first")

    def __init__(self, start, end, hashes, first):
        self.start, self.end, self.hash, self.first = start, end, hashes, first

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(raw: np.ndarray, offsets: np.ndarray, fold: bool = True) -> Words:
    """All words. ``fold`` lower-cases A-Z before hashing."""
    starts, ends, hashes = [], [], []
    for lo, hi in segments(raw, offsets):
        b = raw[lo:hi]
        n = hi - lo
        gap = SEPARATOR[b]
        edge = np.zeros(n + 1, bool)
        inner = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")] - lo
        edge[inner] = True
        edge[0] = edge[n] = True
        before = np.empty(n, bool)
        before[0] = True
        before[1:] = gap[:-1]
        after = np.empty(n, bool)
        after[-1] = True
        after[:-1] = gap[1:]
        solid = ~gap
        s = np.flatnonzero(solid & (before | edge[:-1]))
        e = np.flatnonzero(solid & (after | edge[1:])) + 1
        up, down = powers(n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[LOWER[b] if fold else b] * up[:n], out=total[1:])
        h = (total[e] - total[s]) * down[s]
        starts.append(s + lo)
        ends.append(e + lo)
        hashes.append(mix(h + (e - s).astype(np.uint64)))
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return Words(start, end, h, np.searchsorted(start, offsets))


def range_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the exact bytes of ordered ranges; ranges over a segment go through blake2b."""
    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = int(np.searchsorted(end, start[i] + SEGMENT, "right"))
        if j <= i:
            out[i] = np.frombuffer(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
            i += 1
            continue
        lo, hi = int(start[i]), int(end[j - 1])
        up, down = powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[raw[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


_COEF = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | U64(1)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words inside a text, and the index of its first word."""
    n = len(w.hash)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = w.hash[: n - k + 1] * _COEF[0]
    for j in range(1, k):
        h = h + w.hash[j : n - k + 1 + j] * _COEF[j]
    last = np.repeat(w.first[1:], w.counts)[: n - k + 1]  # one past the text's words
    at = np.flatnonzero(np.arange(n - k + 1) + k <= last)
    return mix(h[at]), at


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each text, sorted within a text, and their offsets.

    A text of 1 to k-1 words has its whole word sequence as its only shingle; one
    without words has none.
    """
    w = words(raw, offsets)
    h, at = windows(w, k)
    doc = np.searchsorted(w.first, at, "right") - 1
    counts = w.counts
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            extra[has] += w.hash[w.first[short][has] + j] * _COEF[j]
        extra = mix(extra + counts[short].astype(np.uint64) * _COEF[63])
        h, doc = np.concatenate([h, extra]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    first = np.searchsorted(doc, np.arange(len(offsets)))
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        h[lo:hi].sort()
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(offsets)))


def set_digest(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 128-bit digest of each set as an (n, 2) array: equal sets, equal digests."""
    out = np.zeros((len(first) - 1, 2), np.uint64)
    if len(h):
        for i, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ U64(salt)))])
            out[:, i] = total[first[1:]] - total[first[:-1]]
    return out


def ragged(first: np.ndarray, values: np.ndarray) -> pa.Array:
    """An Arrow list column from offsets and values."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values))
