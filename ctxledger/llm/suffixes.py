"""Suffix arrays by induced sorting, and permuted longest common prefixes, of one shard's bytes.

Suffixes are L (larger than the next one) or S (smaller). Sorting the leftmost S of each
run, by their substrings and, where these repeat, recursively by the names of the
substrings, induces all L and then all S suffixes in two passes. A pass takes bucket by
bucket: what a bucket holds puts its predecessors, in order, into buckets further on,
and those that fall into the bucket itself follow wave by wave. Where a level has
so many characters that buckets hold few suffixes each, the pass goes suffix by suffix.
"""

from __future__ import annotations

import numpy as np

#: Levels with fewer suffixes a character than this are scanned suffix by suffix.
SCAN = 200


def _types(t: np.ndarray) -> np.ndarray:
    """Which suffixes are S; the last one is L."""
    n = len(t)
    step = np.full(n, -1, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1])
    at = np.where(step != 0, np.arange(n), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where the character changes
    return step[at] > 0


def _scan(t, small, sa, head, tail, starts) -> None:
    """Both passes suffix by suffix; ``sa`` holds the leftmost S suffixes at their buckets' ends, -1 elsewhere."""
    text, is_s, out, head, tail = t.tolist(), small.tolist(), sa.tolist(), head.tolist(), tail.tolist()
    n = len(text)
    out[head[text[n - 1]]] = n - 1
    head[text[n - 1]] += 1
    for i in range(n):
        j = out[i] - 1
        if j >= 0 and not is_s[j]:
            c = text[j]
            out[head[c]] = j
            head[c] += 1
    for i in range(n - 1, -1, -1):
        j = out[i] - 1
        if j >= 0 and is_s[j]:
            c = text[j]
            tail[c] -= 1
            out[tail[c]] = j
    sa[:] = out


def _deal(t: np.ndarray, found: np.ndarray, sa: np.ndarray, edge: np.ndarray, sign: int) -> None:
    """Put suffixes into their buckets, in order, from ``edge`` on (sign 1) or down from it (-1)."""
    c = t[found]
    order = np.argsort(c, kind="stable")
    c, found = c[order], found[order]
    first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    size = np.diff(np.append(first, len(c)))
    within = np.arange(len(c)) - np.repeat(first, size)
    at = edge[c] + (within if sign > 0 else -1 - within)
    sa[at] = found
    edge[c[first]] += sign * size


def _buckets(t, small, sa, head, tail, starts) -> None:
    """Both passes bucket by bucket, with the same result as ``_scan``."""
    n, ends = len(t), starts[1:]
    sa[head[t[n - 1]]] = n - 1
    head[t[n - 1]] += 1
    some = np.flatnonzero(np.diff(starts)).tolist()
    for c in some:
        done = lo = int(starts[c])
        while done < head[c]:
            wave = sa[done : head[c]] - 1
            done = int(head[c])
            wave = wave[wave >= 0]
            wave = wave[(t[wave] == c) & ~small[wave]]
            sa[done : done + len(wave)] = wave
            head[c] += len(wave)
        held = sa[lo : ends[c]]
        before = held[held > 0] - 1
        before = before[(t[before] > c) & ~small[before]]
        if len(before):
            _deal(t, before, sa, head, 1)
    for c in reversed(some):
        done = hi = int(ends[c])
        while done > tail[c]:
            wave = sa[tail[c] : done][::-1] - 1
            done = int(tail[c])
            wave = wave[wave >= 0]
            wave = wave[(t[wave] == c) & small[wave]]
            sa[done - len(wave) : done] = wave[::-1]
            tail[c] -= len(wave)
        # the bucket's L suffixes lie before head, its S suffixes from tail on
        held = np.concatenate([sa[tail[c] : hi][::-1], sa[starts[c] : head[c]][::-1]])
        before = held[held > 0] - 1
        before = before[(t[before] < c) & small[before]]
        if len(before):
            _deal(t, before, sa, tail, -1)


def _induced(t: np.ndarray, small: np.ndarray, left: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the leftmost S suffixes ``left``, taken in this order, induce."""
    n = len(t)
    sa = np.full(n, -1, np.int64)
    tail = starts[1:].copy()
    if len(left):
        _deal(t, left[::-1], sa, tail, -1)
    head, tail = starts[:-1].copy(), starts[1:].copy()
    (_scan if n < SCAN * (len(starts) - 1) else _buckets)(t, small, sa, head, tail, starts)
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``t`` (numbers of 0 or more) in order; a suffix comes before those it begins."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    t = t.astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(np.bincount(t))])
    small = _types(t)
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sa = _induced(t, small, left, starts)
    if len(left) < 2:
        return sa
    leftmost = np.zeros(n, bool)
    leftmost[left] = True
    order = sa[leftmost[sa]]  # by their substrings, each up to the next leftmost S
    size = np.zeros(n, np.int64)
    size[left] = np.append(np.diff(left), n - left[-1]) + 1  # the last one runs to the end and is like no other
    same = np.append(False, (size[order[1:]] == size[order[:-1]]) & (order[1:] != left[-1]) & (order[:-1] != left[-1]))
    pair, j = np.flatnonzero(same), 0
    while len(pair):
        differ = t[order[pair] + j] != t[order[pair - 1] + j]
        same[pair[differ]] = False
        j += 1
        pair = pair[~differ & (size[order[pair]] > j)]
    name = np.zeros(n, np.int64)
    name[order] = np.cumsum(~same) - 1
    if same.any():
        order = left[suffix_array(name[left])]
    return _induced(t, small, order, starts)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """By position: the longest common prefix of a suffix and the one before it in ``sa``.

    Where the bytes before both are equal it is that of the position before, less one;
    the others are compared, eight bytes at a time.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    follows = np.zeros(n, bool)
    both = (i > 0) & (before > 0)
    follows[both] = t[i[both] - 1] == t[before[both] - 1]
    follows &= before >= 0
    # what is compared afresh: the first of each chain, and single suffixes without one before
    padded = np.concatenate([t.astype(np.uint8), np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    found = np.zeros(n, np.int64)
    at = np.flatnonzero(~follows & (before >= 0))
    at = at[before[at] >= 0]
    room = n - np.maximum(at, before[at])
    active = np.arange(len(at))
    size = np.zeros(len(at), np.int64)
    while len(active):
        x, y = at[active] + size[active], before[at[active]] + size[active]
        equal = words[x] == words[y]
        run = np.where(equal.all(axis=1), 8, equal.argmin(axis=1))
        size[active] += run
        over = size[active] >= room[active]
        size[active] = np.minimum(size[active], room[active])
        active = active[(run == 8) & ~over & (size[active] < room[active])]
    found[at] = size
    chain = np.maximum.accumulate(np.where(follows, -1, i))
    return np.where(follows, found[chain] - (i - chain), found)


def repeated(t: np.ndarray, sa: np.ndarray, common: np.ndarray, width: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, occurrences) of each position's string of ``width`` bytes; equal strings share a class.

    ``counts`` tells which positions count as occurrences (0: the string does not lie in one text).
    """
    group = np.cumsum(common[sa] < width) if len(sa) else np.zeros(0, np.int64)
    of = np.zeros(len(t), np.int64)
    of[sa] = group
    return of, np.bincount(of, weights=counts, minlength=int(group[-1]) + 1 if len(group) else 1).astype(np.int64)[of]
