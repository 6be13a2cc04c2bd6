"""Exact centroid clustering with the bounds and the search of Shallot.

Every vector carries its nearest and second-nearest centroid of the last search, an
upper bound of its distance to the first and a lower bound of its distance to all
others. When centroids move, bounds move with them; a vector whose bounds still
part its centroid from the others (or that lies nearer to it than half the way to
the next centroid) is not searched. Else its distances to the two remembered centroids are
taken, and the search starts from the closer one, through the other centroids in
order of their distance from it. The ball searched has the distance to the start
plus that to the second best so far as its radius, so it shrinks while the search
goes on. Bounds are doubles, rounded outwards at each step, and only leave out what
can't be nearest or tie; whatever survives is compared in integers, ties by number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxledger.llm._work import discard, table, written

#: Components are held to this magnitude, so that a squared distance of 64 of them fits a long.
LARGEST = 1 << 27
#: Rows that a task works on at once.
BLOCK = 4096


def _up(x):
    return np.nextafter(np.nextafter(x, np.inf), np.inf)


def _down(x):
    return np.nextafter(np.nextafter(x, -np.inf), -np.inf)


def _squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows; both int64."""
    d = v - c
    return np.einsum("ij,ij->i", d, d)


class Centroids:
    """The centroids of a round, how far each has come, and each one's neighbours by distance."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None):
        self.at, k = now, len(now)
        self.gap = np.array([_squared(now, np.broadcast_to(c, now.shape)) for c in now]).reshape(k, k)
        self.near = np.argsort(self.gap, axis=1, kind="stable")
        self.far = _down(np.sqrt(self.gap.astype(float)))
        self.half = _down(self.far[np.arange(k), self.near[:, 1]] / 2) if k > 1 else np.full(k, np.inf)
        came = np.zeros(k) if before is None else _up(np.sqrt(_squared(now, before).astype(float)))
        self.came = came
        # the furthest that any other centroid came
        first = int(came.argmax()) if k else 0
        self.others = np.full(k, came[first] if k else 0.0)
        if k > 1:
            self.others[first] = np.partition(came, -2)[-2]


def search(v: np.ndarray, c: Centroids, one: np.ndarray, two: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Nearest (``one``) and second-nearest (``two``) centroid and the bounds of each row of ``v``, in place; rows searched."""
    if len(c.at) == 1:
        one[:], two[:], upper[:], lower[:] = 0, 0, np.inf, np.inf
        return 0
    upper[:] = _up(upper + c.came[one])
    lower[:] = np.maximum(_down(lower - c.others[one]), 0.0)
    parted = np.maximum(lower, c.half[one])
    left = np.flatnonzero(upper >= parted)
    if len(left):  # the true distance may part them
        upper[left] = _up(np.sqrt(_squared(v[left], c.at[one[left]]).astype(float)))
        left = left[upper[left] >= parted[left]]
    if not len(left):
        return 0
    x, a, b = v[left], one[left], two[left]
    da, db = _squared(x, c.at[a]), _squared(x, c.at[b])
    swap = (db < da) | ((db == da) & (b < a))
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    da, db = np.where(swap, db, da), np.where(swap, da, db)
    for start in np.unique(a).tolist():
        rows = np.flatnonzero(a == start)
        best, d1, second, d2 = a[rows], da[rows], b[rows], db[rows]
        from_start = _up(np.sqrt(d1.astype(float)))
        at = np.arange(len(rows))
        for other in c.near[start].tolist():
            if other == start:
                continue
            # all that come later lie further from the start: rows whose ball ends before this one are done
            at = at[c.far[start, other] <= _up(from_start[at] + _up(np.sqrt(d2[at].astype(float))))]
            if not len(at):
                break
            some = at[second[at] != other] if (second[at] == other).any() else at
            some = some[best[some] != other]
            if not len(some):
                continue
            d = _squared(x[rows[some]], np.broadcast_to(c.at[other], (len(some), v.shape[1])))
            first = (d < d1[some]) | ((d == d1[some]) & (other < best[some]))
            then = ~first & ((d < d2[some]) | ((d == d2[some]) & (other < second[some])))
            up, mid = some[first], some[then]
            second[up], d2[up] = best[up], d1[up]
            best[up], d1[up] = other, d[first]
            second[mid], d2[mid] = other, d[then]
        a[rows], da[rows], b[rows], db[rows] = best, d1, second, d2
    one[left], two[left] = a, b
    upper[left], lower[left] = _up(np.sqrt(da.astype(float))), _down(np.sqrt(db.astype(float)))
    return len(left)


STATE = "vec_id long, vector array<int>, one int, two int, upper double, lower double"


def _vectors(b: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch as rows of int64."""
    lists = b.column("vector")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, -1)


def _assigned(now: np.ndarray, before: np.ndarray | None, last: bool):
    """Assign to the centroids ``now``; ``before``: those that the bounds of the rows hold for (None: there are none yet)."""

    def run(batches):
        c = Centroids(now, before)
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK):
                b = whole.slice(lo, BLOCK)
                v = _vectors(b)
                if before is None:
                    one, two = np.zeros(len(v), np.int32), np.full(len(v), min(1, len(now) - 1), np.int32)
                    upper, lower = np.full(len(v), np.inf), np.zeros(len(v))
                else:
                    one, two, upper, lower = (b.column(n).to_numpy(zero_copy_only=False).copy() for n in ("one", "two", "upper", "lower"))
                search(v, c, one, two, upper, lower)
                if last:
                    yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(one), pa.array(_squared(v, now[one]))], names=["vec_id", "cluster", "distance"])
                else:
                    yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vector"), *(pa.array(x) for x in (one, two, upper, lower))], names=["vec_id", "vector", "one", "two", "upper", "lower"])

    return run


def whole_vectors(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, vector) of the rows whose embedding has ``dim`` components, all finite: each floor(scale * x), x as double."""
    e = F.col("embedding")
    fit = F.forall(e, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    step = F.transform(e, lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), x.cast("double") * scale))))).cast("int"))
    return vectors.where((F.size(e) == dim) & fit).select(F.col("vec_id").cast("long").alias("vec_id"), step.alias("vector"))


def first_centroids(vectors: DataFrame, total: int, k: int, seed: int) -> np.ndarray:
    """The k vectors of least sha256 of seed and vec_id, in that order; equal hashes by vec_id and vector.

    A bound on the hash, which is even over its range, lets few rows be sorted; it is
    raised where too few pass (many rows of one id).
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    hashed = vectors.withColumn("hash", key)
    share = 16 * k / max(total, 1)
    while share < 1:
        few = hashed.where(F.col("hash") < f"{int(share * 16**12):012x}").orderBy("hash", "vec_id", "vector").limit(k).collect()
        if len(few) == k:
            break
        share *= 64
    else:
        few = hashed.orderBy("hash", "vec_id", "vector").limit(k).collect()
    return np.array([r["vector"] for r in few], np.int64)


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: floors of the exact means of their vectors; empty ones stay."""
    sums = [F.sum(F.col("vector")[i].cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for r in state.groupBy("one").agg(F.count("*").alias("n"), *sums).collect():  # a row a centroid
        out[r["one"]] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every kept vector, the final centroids).

    Lloyd's rounds, exactly: the bounds spare distances and change no result. A vector
    is kept if its embedding has ``dim`` components, none null or non-finite; a null
    embedding is not. Components beyond 2**27 count as 2**27. Ties go to the smaller centroid; repeated rows
    and null ids are clustered like others (a null id hashes as an empty one). With
    fewer vectors than ``k`` each is a centroid; no vectors give no rows. Other columns
    are ignored. Between rounds vectors and bounds lie in a shared table, the one
    before is removed once the next is written; rounds end early when no centroid
    moves, which the remaining ones could not change.
    """
    spark = vectors.sparkSession
    path = written(whole_vectors(vectors, dim, scale), "vectors")
    state = spark.read.schema("vec_id long, vector array<int>").parquet(path)
    now, before = first_centroids(state, state.count(), k, seed), None
    if not len(now):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), now
    for _ in range(rounds):
        done = path
        path = written(state.mapInArrow(_assigned(now, before, False), STATE), "round")
        state = spark.read.schema(STATE).parquet(path)
        discard(spark, done)
        now, before = _moved(state, now), now
        if np.array_equal(now, before):
            break
    return state.mapInArrow(_assigned(now, before, True), "vec_id long, cluster int, distance long"), now


def op11_shallot_clusters(spark, sf_dir):
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    path = written(found, "clusters")
    found = spark.read.schema("vec_id long, cluster int, distance long").parquet(path)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(i, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest()) for i, s in sorted(sums.items())]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row a centroid
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 8, rounds: int = 10) -> str:
    near = "min(struct_pack(d := list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::BIGINT, c := c))"
    parts = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::INT AS c, v AS m FROM v ORDER BY sha256('3:' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, {near} AS a FROM v, c{r} GROUP BY vec_id)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT a.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) AS t(i) GROUP BY a.c, i)")
            parts.append(f"f{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM s{r} GROUP BY c)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(f.m, o.m) AS m FROM c{r} o LEFT JOIN f{r} f USING (c))")
    last = f"SELECT vec_id, a.c AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c = a.c"
    return "WITH " + ",\n".join(parts) + "\n" + last


OP11_SQL = _sql()
