"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

1. One pass over the texts makes each document's set of distinct k-word shingle
   hashes, a 128-bit digest of the set, and a fast similarity sketch: in round i < t
   every element is thrown by its hash into one of t bins and claims it if no
   earlier round did; in round t + j every element goes to bin j, so each coordinate
   fills after 2 t rounds at most, and the estimate concentrates as that of t
   independent permutations would.
2. Documents with equal digests are one node; near-duplicate search runs on nodes,
   so a group of exact copies costs one row.
3. Bands of the sketch make buckets. Each node is compared with two hubs of its
   bucket; links are confirmed on whole sets and joined into components.
4. Buckets that still span several components have every pair across components
   considered (once, in the bucket of the first band it shares; dropped only if
   the sketches put it 4.5 standard deviations under the threshold) and confirmed
   on whole sets; large buckets are worked in blocks that many tasks share. A first pass
   over the blocks holds sketches only and tells which of a block's nodes have a candidate
   there; only these come again with their sets, and links go out, not pairs. Pairs inside a component cannot change it, so blocks of a bucket's
   largest component meet those of the others only, never one another.

No bucket is capped and no links, components or sketches reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxledger.llm import _text as T
from ctxledger.llm._work import materialize
from ctxledger.llm.components import connected_components

U64 = np.uint64
_GOLD = U64(0x9E3779B97F4A7C15)
_EMPTY = U64(0xFFFFFFFFFFFFFFFF)
ROWS = 5
#: Buckets up to SMALL rows emit pairs; larger ones are worked in blocks of BLOCK rows.
SMALL, BLOCK = 32, 256


def row_of():
    """What rows of documents are told apart by: the doc_id, or for want of one a hash of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")))


def bands_for(percent: int, rows: int = ROWS, miss: float = 1e-5) -> int:
    """Bands needed so that a pair at the threshold shares none with probability ``miss`` at most."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows))))


def sketch(h: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches, one row of t coordinates a set (empty sets keep a filler)."""
    n = len(first) - 1
    out = np.full((n, t), _EMPTY)
    flat = out.reshape(-1)
    doc = np.repeat(np.arange(n), np.diff(first))
    x = h
    for i in range(2 * t):
        if not len(x):
            break
        z = T.mix(x + U64((i + 1) * int(_GOLD) % 2**64))
        at = ((z >> U64(40)) * U64(t) >> U64(24)).astype(np.int64) if i < t else i - t
        at = doc * t + at
        low = U64(i << 40)
        free = np.flatnonzero(flat[at] >= low)
        np.minimum.at(flat, at[free], low | (z[free] & U64((1 << 40) - 1)))
        if i < 6 or i % 8 == 0:
            open_docs = (out == _EMPTY).any(axis=1)
            left = open_docs[doc]
            x, doc = x[left], doc[left]
    return out


def band_keys(sk: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key a band; equal keys mean equal coordinates in the same band."""
    n, t = sk.shape
    bands = t // rows
    coef = np.random.default_rng(5).integers(1, 2**63, rows, dtype=np.uint64) | U64(1)
    cube = sk[:, : bands * rows].reshape(n, bands, rows) * coef
    return T.mix(cube.sum(axis=2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _GOLD).view(np.int64)


def _digest_column(digest: np.ndarray, sizes: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(digest).tobytes()
    return pa.array([raw[16 * i : 16 * i + 16] if k else None for i, k in enumerate(sizes.tolist())], pa.binary())


def _signatures(k: int, bands: int, rows: int):
    def run(batches):
        for b in T.slices(batches):
            raw, off = T.buffers(b.column("text"))
            h, first = T.shingle_sets(raw, off, k)
            sizes = np.diff(first)
            sk = sketch(h, first, bands * rows)
            keys = band_keys(sk, rows)
            width = np.where(sizes > 0, bands, 0)
            starts = np.concatenate([[0], np.cumsum(width)])
            small = (T.mix(sk) & U64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("row"),
                    _digest_column(T.set_digest(h, first), sizes),
                    pa.array(sizes.astype(np.int64)),
                    T.ragged(starts, keys[sizes > 0].reshape(-1)),
                    pa.array([x.tobytes() for x in small], pa.binary()),
                ],
                names=["doc_id", "row", "node", "n", "bands", "bits"],
            )

    return run


def _sets(k: int):
    def run(batches):
        for b in T.slices(batches):
            raw, off = T.buffers(b.column("text"))
            h, first = T.shingle_sets(raw, off, k)
            sets = [h[lo:hi].tobytes() for lo, hi in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([_digest_column(T.set_digest(h, first), np.diff(first)), pa.array(sets, pa.binary())], names=["node", "members"])

    return run


def _similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two whole sets meet the threshold."""
    both = np.concatenate([p, q])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)


def _confirm(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
                keep.append(_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole sets meet the threshold."""
    b_side = sets.select(F.col("node").alias("b"), F.col("members").alias("set_b"))
    a_side = sets.select(F.col("node").alias("a"), F.col("members").alias("set_a"))
    return pairs.join(b_side, "b").join(a_side, "a").select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a binary, b binary")


def _pair(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _fits(n, m, percent: int):
    """Sets of these sizes can reach the threshold."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


#: What comes out of two blocks of a bucket: candidate pairs, the nodes that are in one, or links (rows then hold whole sets).
OUT = {"pairs": "a binary, b binary", "nodes": "key long, i int, j int, node binary", "links": "a binary, b binary"}


def _across(percent: int, bands: int, bits: int, out: str):
    """Pairs of two blocks of a bucket that lie in different components and may reach the threshold.

    A pair is looked at only in the bucket of the first band that it shares. With ``links``
    pairs are confirmed here; one link joins two components.
    """
    p = percent / 100
    least = (p - 4.5 * math.sqrt(p * (1 - p) / bits)) * bits

    def group(key, i, j, block, n, component, node, coded, keys, members, found):
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            return
        band = int(np.flatnonzero(keys[left[0]] == key)[0])
        joined: dict[int, int] = {}
        near_one = np.zeros(len(block), bool)

        def root(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        for z, at in enumerate(left.tolist()):
            others = right[z + 1 :] if i == j else right
            m = n[others]
            others = others[(np.minimum(n[at], m) * 100 >= np.maximum(n[at], m) * percent) & (component[others] != component[at])]
            if not len(others):
                continue
            alike = (coded[others] == coded[at]).sum(axis=1)
            near = (alike >= least) & ((keys[others] == keys[at]).argmax(axis=1) == band)
            others, alike = others[near], alike[near]
            if out == "nodes":
                near_one[others] = True
                near_one[at] |= len(others) > 0
                continue
            for x in others[np.argsort(-alike, kind="stable")].tolist():
                if out == "links":
                    c, d = root(int(component[at])), root(int(component[x]))
                    if c == d or not _similar(members[at], members[x], percent):
                        continue
                    joined[c] = d
                found[0].append(min(node[at], node[x]))
                found[1].append(max(node[at], node[x]))
        for x in np.flatnonzero(near_one).tolist():
            for column, v in zip(found, (key, i, j, node[x]), strict=True):
                column.append(v)

    names = [x.split()[0] for x in OUT[out].split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()] if out == "nodes" else [pa.binary()] * 2

    def run(batches):
        held: list[pa.RecordBatch] = []  # rows of the group that the next batch may continue
        for b, final in _with_last(batches):
            rows = pa.Table.from_batches([*held, b] if b is not None else held, None if b is not None or held else _NO_ROWS).combine_chunks()
            if not rows.num_rows:
                held = []
                continue
            key, i, j = (rows.column(c).to_numpy() for c in ("key", "i", "j"))
            new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            edges = [0, *new.tolist(), rows.num_rows]
            done = len(edges) - 1 if final else len(edges) - 2
            found: list[list] = [[] for _ in names]
            if done > 0:
                end = edges[done]
                block, n = rows.column("block").to_numpy()[:end], rows.column("n").to_numpy()[:end]
                component, node = rows.column("component").to_pylist()[:end], rows.column("node").to_pylist()[:end]
                coded = np.frombuffer(b"".join(rows.column("bits").to_pylist()[:end]), np.uint8).reshape(end, bits)
                keys = np.array(rows.column("bands").to_pylist()[:end], np.int64).reshape(end, bands)
                members = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("members").slice(0, end)] if out == "links" else None
                labels = np.unique(np.array(component, dtype=object), return_inverse=True)[1]
                for lo, hi in zip(edges[:done], edges[1 : done + 1], strict=True):
                    group(key[lo], i[lo], j[lo], block[lo:hi], n[lo:hi], labels[lo:hi], node[lo:hi], coded[lo:hi], keys[lo:hi], members and members[lo:hi], found)
            held = rows.slice(edges[done]).to_batches()
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(found, kinds, strict=True)], names=names)

    return run


_NO_ROWS = pa.schema([("key", pa.int64())])


def _with_last(batches):
    """Each batch with False, then (None, True)."""
    for b in batches:
        yield b, False
    yield None, True


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, row (the doc_id, or for want of one a hash of the text).

    Documents whose sets of distinct k-word shingles have a Jaccard similarity of
    ``percent`` / 100 or more are linked; component_id is the smallest doc_id that
    links reach, kept tells whether it is the document's own. Words are cut at
    ASCII white space, A-Z lower-cased. A shorter text is one shingle; a null,
    empty or blank text has no shingle and is linked with nothing. Repeated rows
    are exact copies (both keep their row). A null doc_id links like any other, gets the
    smallest doc_id that it reaches, or null, and is kept only where it reaches none.
    Other columns are ignored; an empty table gives no rows.
    """
    bands = bands_for(percent, rows)
    # sets are fetched by row: the doc_id, or for want of one a hash of the text
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = texts.withColumn("row", row_of())
    signatures = texts.mapInArrow(_signatures(k, bands, rows), "doc_id long, row long, node binary, n long, bands array<long>, bits binary")
    signatures = materialize(signatures, "signatures")
    nodes = signatures.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.max("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    nodes = materialize(nodes, "nodes")

    each = nodes.select("node", "n", F.explode("bands").alias("key"))
    row = F.struct("node", "n")
    hubs = each.groupBy("key").agg(F.count("*").alias("size"), F.min(row).alias("lo"), F.max(row).alias("hi")).where("size > 1").drop("size")
    buckets = materialize(each.join(hubs, "key"), "buckets")

    wanted = buckets.select("node").distinct().join(nodes.select("node", "row"), "node").select("row").distinct()
    sets = texts.select("row", "text").join(wanted, "row", "left_semi").select("text").mapInArrow(_sets(k), "node binary, members binary")
    sets = materialize(sets.where("node is not null").dropDuplicates(["node"]), "sets")

    hub = F.explode(F.array("lo", "hi")).alias("hub")
    near = buckets.select("node", "n", hub).where((F.col("node") != F.col("hub.node")) & _fits(F.col("n"), F.col("hub.n"), percent))
    near = materialize(near.select(*_pair(F.col("node"), F.col("hub.node"))).distinct(), "pairs")
    links = materialize(_verify(near, sets, percent), "links")
    first = connected_components(links)

    label = F.coalesce("component", "node")
    spread = materialize(buckets.select("key", "node", "n").join(first, "node", "left").withColumn("component", label), "labelled")
    count = spread.groupBy("key", "component").agg(F.count("*").alias("c"))
    count = count.groupBy("key").agg(F.sum("c").alias("size"), F.max(F.struct("c", "component")).alias("most")).where("size > most.c")
    spread = spread.join(count, "key").withColumn("minor", F.col("component") != F.col("most.component"))
    spread = materialize(spread.join(nodes.select("node", "bits", "bands"), "node"), "spread")
    small = spread.where(F.col("size") <= SMALL).select("*", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("block"))
    # blocks of the others come first; those of the largest component follow, and meet the others' only
    others = F.ceil((F.col("size") - F.col("most.c")) / BLOCK).cast("int")
    largest = F.ceil(F.col("most.c") / BLOCK).cast("int")
    dealt_to = F.xxhash64("node", F.lit(1))
    block = F.when(F.col("minor"), F.pmod(dealt_to, others)).otherwise(others + F.pmod(dealt_to, largest)).cast("int")
    numbered = spread.where(F.col("size") > SMALL).withColumn("block", block)
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("minor"), others + largest).otherwise(others) - 1)).alias("other")
    large = numbered.select("*", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})

    def dealt(df: DataFrame, out: str) -> DataFrame:
        df = df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        return df.mapInArrow(_across(percent, bands, bands * rows, out), OUT[out])

    named = materialize(dealt(large, "nodes"), "candidates")
    whole = named.join(numbered, ["key", "node"]).join(sets, "node")
    more = materialize(_verify(dealt(small, "pairs"), sets, percent).unionByName(dealt(whole, "links")), "links")
    members = connected_components(links.unionByName(more))

    named = nodes.select("node", "doc_id").join(members, "node", "left").withColumn("component", label)
    ids = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(ids, "component").select("node", "component_id")
    out = signatures.select("doc_id", "row", "node", F.col("n").alias("n_shingles")).join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), "row")


def op2_fast_similarity(spark, sf_dir):
    """Contract query: 3-word shingles, similarity 0.85, all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85).drop("row")


OP2_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(sh) AS n FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT doc_id, n AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM r JOIN n USING (doc_id) GROUP BY doc_id, n
"""
