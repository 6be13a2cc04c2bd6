"""Counts of the byte-context trie stay whole, however large."""

import math
import random

import numpy as np

from ctxledger.llm import lm


def brute(counts, key):
    """log10 probability of a window by looking at every order in turn."""
    masked, p = set(), 1.0
    for order in range(lm.ORDER, -1, -1):
        gram = key & ((1 << 8 * (order + 1)) - 1)
        seen = {}
        for k, n in counts.items():
            if (k & ((1 << 8 * (order + 1)) - 1)) >> 8 == gram >> 8:
                seen[k & 255] = seen.get(k & 255, 0) + n
        seen = {c: n for c, n in seen.items() if c not in masked}
        t, d = sum(seen.values()), len(seen)
        if (key & 255) in seen:
            return math.log10(p * (2 * seen[key & 255] - 1) / (2 * t))
        if t:
            p *= d / (2 * t)
        masked |= set(seen)
    return math.log10(p / (256 - len(masked)))


def test_counts_beyond_floats(spark):
    """Cells that occur over 2**24 times: cached and joined windows agree with exact arithmetic, one more occurrence shows."""
    rng = random.Random(1)
    letters = b"abc"
    counts = {}
    for _ in range(60):
        key = 0
        for _ in range(lm.ORDER + 1):
            key = key << 8 | rng.choice(letters)
        counts[key] = rng.choice([1, 2, 2**24 + 1, 2**24 + 3, 3 * 2**25 + 1])
    grams = lm._grams(spark.createDataFrame(list(counts.items()), "key long, n long")).cache()
    held = [tuple(np.array(x) for x in zip(*((r["key"], r["n"]) for r in grams.where(f"`order` = {o}").collect()), strict=True)) for o in range(lm.ORDER + 1)]
    trie = lm.Trie(((k.astype(np.uint64), n) for k, n in held), True)
    assert trie.orders[-1][-1].sum() == sum(counts.values())
    wanted = sorted({*counts, *(k ^ 1 for k in counts), *(k ^ (3 << 16) for k in counts), 0x7A7A7A7A7A7A})
    expect = [brute(counts, k) for k in wanted]
    assert np.allclose(trie.logs(np.array(wanted, np.uint64)), expect, rtol=0, atol=1e-12)
    joined = {r["key"]: r["p"] for r in lm._probabilities(spark.createDataFrame([(k,) for k in wanted], "key long"), grams).collect()}
    assert np.allclose([joined[k] for k in wanted], expect, rtol=0, atol=1e-12)
    assert np.log10(2.0 * (2**24 + 1) - 1) != np.log10(2.0 * 2**24 - 1)
