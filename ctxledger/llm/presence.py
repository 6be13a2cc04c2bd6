"""Hashed byte n-gram presence features and a logistic scorer on them."""

from __future__ import annotations

import numpy as np

from ctxledger.llm import _text as T

_MULT = [pow(0x9E3779B97F4A7C15, n + 1, 2**64) | 1 for n in range(9)]


def ngram_bins(raw: np.ndarray, offsets: np.ndarray, orders, log2: int, fold: bool = True, mark: np.ndarray | None = None):
    """(text index, bin) of each byte n-gram inside a text, by segment and order; bins are in [0, 2**log2).

    ``mark`` keeps the bins of interest only, before anything else is worked out.
    Each order's key extends the one before.
    """
    orders = sorted(orders)
    for lo in range(0, len(raw), T.SEGMENT):
        hi = min(len(raw), lo + T.SEGMENT + orders[-1] - 1)
        b = raw[lo:hi]
        b = (T.LOWER[b] if fold else b).astype(np.uint64)
        doc = room = None
        key, done = b, 1
        for n in orders:
            m = min(T.SEGMENT, hi - lo - n + 1)
            if m <= 0:
                break
            key = key[:m]
            for j in range(done, n):
                key = key | (b[j : m + j] << T.U64(8 * j))
            done = n
            bins = (((key ^ (key >> T.U64(29))) * T.U64(_MULT[n])) >> T.U64(64 - log2)).astype(np.int32)
            if mark is not None:
                at = np.flatnonzero(mark[bins])
                where = np.searchsorted(offsets, lo + at, "right") - 1
                inside = lo + at + n <= offsets[where + 1]
                yield where[inside], bins[at[inside]]
                continue
            if doc is None:
                doc = _docs(offsets, lo, m)
                room = offsets[doc + 1] - np.arange(lo, lo + m)
            inside = np.flatnonzero(room[:m] >= n)
            yield doc[inside], bins[inside]


def _docs(offsets, lo, m):
    """Text index of each byte of [lo, lo + m)."""
    a = int(np.searchsorted(offsets, lo, "right")) - 1
    z = int(np.searchsorted(offsets, lo + m - 1, "right")) - 1
    cuts = np.clip(offsets[a : z + 2], lo, lo + m)
    return np.repeat(np.arange(a, z + 1), np.diff(cuts))


def presence(raw: np.ndarray, offsets: np.ndarray, orders, log2: int, fold: bool = True, block: int = 64):
    """Blocks (first text, 0/1 matrix) of hashed n-gram presence, all orders in one space."""
    n_docs = len(offsets) - 1
    for first in range(0, n_docs, block):
        last = min(n_docs, first + block)
        part, off = raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        bits = np.zeros((last - first, 1 << log2), np.uint8)
        flat = bits.reshape(-1)
        for doc, bins in ngram_bins(part, off, orders, log2, fold):
            flat[(doc << log2) + bins] = 1
        yield first, bits


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(packed: np.ndarray, y: np.ndarray, weight: np.ndarray, scale: np.ndarray | None = None, norm: bool = True, epochs: int = 12, rate: float = 0.3, l2: float = 1e-5, seed: int = 0):
    """Logistic weights on packed 0/1 rows (Adagrad in mini-batches, deterministic).

    y may be soft labels. ``scale`` multiplies the features; ``norm`` divides a row
    by the root of its number of features. Returns (weights on 0/1 features, bias).
    """
    d = packed.shape[1] * 8
    w, b = np.zeros(d, np.float32), 0.0
    gw, gb = np.full(d, 1e-6, np.float32), 1e-6
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in np.array_split(order, max(1, len(y) // 128)):
            x = np.unpackbits(packed[at], axis=1).astype(np.float32)
            if norm:
                x /= np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))
            if scale is not None:
                x *= scale
            g = (sigmoid(x @ w + b) - y[at]) * weight[at] / max(1, len(at))
            dw, db = x.T @ g.astype(np.float32) + l2 * w, float(g.sum())
            gw += dw * dw
            gb += db * db
            w -= rate * dw / np.sqrt(gw)
            b -= rate * db / np.sqrt(gb)
    return (w if scale is None else w * scale), b
