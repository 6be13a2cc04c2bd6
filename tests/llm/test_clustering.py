"""Exact centroid clustering against plain rounds in integers, and its edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxledger.llm import clustering

EMB = "vec_id long, embedding array<float>"


def plain(rows, k, rounds, scale, seed, dim):
    """(vec_id, cluster, distance) by looking at every centroid."""
    kept = [(i, [math.floor(float(np.float32(x)) * scale) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0, r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted((str(i), nearest(v)[1], nearest(v)[0]) for i, v in kept), centroids


def found(spark, rows, **how):
    df, centroids = clustering.cluster(spark.createDataFrame(rows, EMB).repartition(3), **how)
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in df.collect()), centroids.tolist()


@pytest.mark.parametrize("k,dim,spread", [(1, 3, 9), (2, 2, 3), (7, 4, 4), (40, 6, 30)])
def test_clusters_equal_plain_rounds(spark, k, dim, spread):
    """Coarse grids make ties and repeated vectors; more centroids make searches shrink."""
    rng = random.Random(k)
    rows = [(i, [rng.randint(-spread, spread) / 2 + rng.choice([0, 60]) for _ in range(dim)]) for i in range(300)]
    how = dict(k=k, rounds=6, dim=dim, scale=2, seed=5)
    assert found(spark, rows, **how) == plain(rows, rounds=6, k=k, scale=2, seed=5, dim=dim)


def test_search_spares_vectors_and_keeps_bounds_true():
    """After a small move few vectors are searched, and the bounds still hold for every centroid."""
    rng = np.random.default_rng(1)
    v = rng.integers(-50, 50, (2000, 8)) + 1000 * rng.integers(0, 6, (2000, 1))
    before = np.array([v[i] for i in range(12)])
    one, two = np.zeros(2000, np.int32), np.ones(2000, np.int32)
    upper, lower = np.full(2000, np.inf), np.zeros(2000)
    assert clustering.search(v, clustering.Centroids(before, None), one, two, upper, lower) > 1900
    now = before + rng.integers(-2, 3, before.shape)
    few = clustering.search(v, clustering.Centroids(now, before), one, two, upper, lower)
    assert 0 < few < 1500
    d = ((v[:, None, :] - now[None]) ** 2).sum(axis=2)
    assert (one == d.argmin(axis=1)).all()
    own = d[np.arange(2000), one]
    d[np.arange(2000), one] = d.max() + 1
    assert (upper >= np.sqrt(own)).all() and (lower <= np.sqrt(d.min(axis=1))).all()


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [5.0, 5.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [-0.4, 0.3]), (9, [1.0, 2.0, 3.0])]
    how = dict(k=8, rounds=3, dim=2, scale=10, seed=3)
    assert found(spark, rows, **how) == plain(rows, k=8, rounds=3, dim=2, scale=10, seed=3)
    clashing = spark.createDataFrame(rows, EMB).withColumns({n: F.lit(1) for n in ("vector", "one", "two", "upper", "lower", "cluster", "hash", "n")})
    got, _ = clustering.cluster(clashing, **how)
    assert got.count() == 4 and got.columns == ["vec_id", "cluster", "distance"]
    none, centroids = clustering.cluster(clashing.limit(0), **how)
    assert none.count() == 0 and len(centroids) == 0
    far, centroids = clustering.cluster(spark.createDataFrame([(1, [3e38, -3e38]), (2, [0.0, 0.0])], EMB), **how)
    assert sorted(r["distance"] for r in far.collect()) == [0, 0] and abs(centroids).max() == clustering.LARGEST


def test_first_centroids_with_many_rows_of_one_id(spark, monkeypatch):
    """Where the bound on the hash lets too few rows pass, it is raised until all are sorted."""
    rows = [(7, [float(i % 5), 1.0]) for i in range(3000)]
    how = dict(k=3, rounds=1, dim=2, scale=1, seed=3)
    assert found(spark, rows, **how) == plain(rows, k=3, rounds=1, dim=2, scale=1, seed=3)
