"""Benchmark decontamination by size-partitioned MinHash containment search.

1. The universe is the set of shingles of all test items. A document's shingles
   outside it cannot count towards any containment, so each document is reduced to
   the part of its shingle set inside the universe, exactly. Documents with equal
   parts share one row, a domain.
2. Domains are partitioned by size. In a partition with sizes up to u, an item of n
   shingles contained by a share c has Jaccard similarity c n / (u + (1 - c) n) at
   least; from that follow the widest bands whose chance to miss is under 1e-5.
   Items and domains that share a band are candidates.
3. Where a partition is so large against an item that even single coordinates
   would miss, items are looked up by their shingles instead: by the rarest of them, so
   many that a domain without any of these can't hold enough of the others.
4. Candidates are verified by the exact share of the item's shingles in the domain.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxledger.llm import _text as T
from ctxledger.llm._work import materialize, read_columns, table, written

U64 = np.uint64
COORDINATES = 64
#: Universes up to this many shingles (8 bytes each) are broadcast. Larger ones are joined, by
#: those shingles of a document that pass a bitmap of the universe (2**BITMAP bits, read by the workers).
BROADCAST, BITMAP = 1_000_000, 28
#: Bits of a row of the bitmap's table, as a power of two.
_ROW = 20
_WIDTHS = (4, 2, 1)


def _sized(w: T.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words, told apart by size, and the texts they are in."""
    h, at = T.windows(w, size)
    return T.mix(h + U64(size)), np.searchsorted(w.first, at, "right") - 1


def _item_sets(k: int):
    def run(batches):
        for b in T.slices(batches):
            w = T.words(*T.buffers(b.column("text")))
            counts = w.counts
            found: list[list[int]] = [[] for _ in range(b.num_rows)]
            for size in range(1, k + 1):
                fits = (counts >= k) if size == k else (counts == size)
                h, doc = _sized(w, size)
                edge = np.searchsorted(doc, np.arange(b.num_rows + 1))
                for i in np.flatnonzero(fits).tolist():
                    found[i] = np.unique(h[edge[i] : edge[i + 1]]).view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([min(k, c) for c in counts.tolist()], pa.int32()), pa.array(found, pa.list_(pa.int64()))], names=["item_id", "size", "members"])

    return run


def _distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], doc[keep]


def _bitmap(shingles: DataFrame) -> str:
    """The path of a table (part, bits) of the bitmap that marks the leading BITMAP bits of each shingle (s)."""

    def rows(batches):
        marks: dict[int, np.ndarray] = {}
        for b in batches:
            slot = (b.column("s").to_numpy().view(np.uint64) >> U64(64 - BITMAP)).astype(np.int64)
            for part in np.unique(slot >> _ROW).tolist():
                mark = marks.setdefault(part, np.zeros(1 << _ROW, bool))
                mark[slot[slot >> _ROW == part] & ((1 << _ROW) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(marks), pa.int32()), pa.array([np.packbits(m).tobytes() for m in marks.values()], pa.binary())], names=["part", "bits"])

    part = F.shiftrightunsigned("s", 64 - BITMAP + _ROW)
    return written(shingles.repartition(part).mapInArrow(rows, "part int, bits binary"), "bitmap")


#: The worker's bitmap, by its path.
_bitmaps: dict = {}


def _marked(path: str, h: np.ndarray) -> np.ndarray:
    """Whether the bitmap at ``path`` marks the hashes."""
    if path not in _bitmaps:
        _bitmaps.clear()
        bits = np.zeros(1 << (BITMAP - 3), np.uint8)
        for part, row in zip(*read_columns(path, ["part", "bits"]), strict=True):
            bits[int(part) << (_ROW - 3) : (int(part) + 1) << (_ROW - 3)] = np.frombuffer(row, np.uint8)
        _bitmaps[path] = bits
    at = (h >> U64(64 - BITMAP)).astype(np.int64)
    return (_bitmaps[path][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _reduced(sizes: list[int], universe, bitmap: str | None = None):
    """Each document's shingles inside the universe (a superset, those that the bitmap marks, where that is given)."""

    def run(batches):
        if bitmap is None:
            inside = universe.value
            quick = np.zeros(1 << 22, bool)
            quick[(inside >> U64(42)).astype(np.int64)] = True
        for b in T.slices(batches):
            w = T.words(*T.buffers(b.column("text")))
            hs, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for size in sizes:
                h, at = T.windows(w, size)
                h = T.mix(h + U64(size))
                maybe = np.flatnonzero(quick[(h >> U64(42)).astype(np.int64)] if bitmap is None else _marked(bitmap, h))
                h, at = h[maybe], at[maybe]
                if bitmap is None:
                    spot = np.minimum(np.searchsorted(inside, h), len(inside) - 1)
                    hit = inside[spot] == h
                    h, at = h[hit], at[hit]
                hs.append(h)
                docs.append(np.searchsorted(w.first, at, "right") - 1)
            h, doc = _distinct(np.concatenate(hs), np.concatenate(docs))
            first = np.searchsorted(doc, np.arange(b.num_rows + 1))
            keep = np.diff(first) > 0
            rows = pa.RecordBatch.from_arrays([b.column("doc_id"), T.ragged(first, h.view(np.int64))], names=["doc_id", "members"])
            yield rows.filter(pa.array(keep))

    return run


def _bands(width: int) -> int:
    return COORDINATES // width


def plan(n: int, upper: int, share: float, miss: float = 1e-5) -> int:
    """Band width for items of n shingles against domains of up to ``upper``; 0: look shingles up."""
    s = share * n / (upper + (1 - share) * n)
    for width in _WIDTHS:
        if s >= 1 or _bands(width) * math.log1p(-(s**width)) <= math.log(miss):
            return width
    return 0


def _minhash(batches):
    """MinHash band keys of a set for every band width: columns + keys (width, key)."""
    seeds = T.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
    for b in batches:
        keys, widths = [], []
        for members in b.column("members").to_pylist():
            h = np.array(members, np.int64).view(np.uint64)
            sk = np.array([T.mix(h ^ s).min() for s in seeds]) if len(h) < 4096 else np.array([np.min([T.mix(h[i : i + 65536] ^ s).min() for i in range(0, len(h), 65536)]) for s in seeds])
            mine, size = [], []
            for width in _WIDTHS:
                cube = sk.reshape(-1, width)
                key = np.full(len(cube), U64(width))
                for j in range(width):
                    key = T.mix(key * U64(31) + cube[:, j])
                mine += T.mix(key + np.arange(len(cube), dtype=np.uint64)).view(np.int64).tolist()
                size += [width] * len(cube)
            keys.append(mine)
            widths.append(size)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(keys, pa.list_(pa.int64())), pa.array(widths, pa.list_(pa.int32()))], names=["id", "keys", "widths"])


def find_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, broadcast: int = BROADCAST) -> DataFrame:
    """One row per (document, contained item): doc_id, item_id, n_item, n_common, containment.

    An item (item_id, text) is contained if at least ``percent`` % of its distinct
    k-word shingles are in the document's whole set. Words are cut at ASCII white
    space, A-Z lower-cased. An item under k words is one run of its words, found
    in order; null, empty and blank items and documents match nothing. A share of
    exactly ``percent`` % is contained. Rows that repeat a pair of ids give one row, with
    the largest counts; null ids stay null and count as one id. Other columns are
    ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sets = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(_item_sets(k), "item_id long, size int, members array<long>")
    sets = materialize(sets.where(F.size("members") > 0).withColumn("n", F.size("members")), "items")
    sizes = sorted(r["size"] for r in sets.select("size").distinct().collect())  # k at most
    shingles = sets.select(F.explode("members").alias("s")).distinct()
    some = shingles.limit(broadcast + 1).count()
    if some <= broadcast:
        known = np.sort(np.array([r["s"] for r in shingles.collect()], np.int64).view(np.uint64))
        if not len(known):
            known = np.zeros(1, np.uint64)
        parts = texts.mapInArrow(_reduced(sizes, spark.sparkContext.broadcast(known)), "doc_id long, members array<long>")
    else:
        rows = texts.withColumn("row", F.monotonically_increasing_id())
        rows = materialize(rows, "rows")
        found = rows.select(F.col("row").alias("doc_id"), "text").mapInArrow(_reduced(sizes, None, _bitmap(shingles)), "doc_id long, members array<long>")
        found = found.select(F.col("doc_id").alias("row"), F.explode("members").alias("s")).join(shingles, "s", "left_semi")
        found = found.groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("members"))
        parts = found.join(rows.select("row", "doc_id"), "row").select("doc_id", "members")
    parts = materialize(parts.withColumn("domain", F.unhex(F.sha2(F.concat_ws(",", F.transform("members", lambda x: x.cast("string"))), 256))), "parts")
    domains = parts.select("domain", "members").groupBy("domain").agg(F.first("members").alias("members"))
    domains = materialize(domains.withColumn("class", F.floor(F.log2(F.size("members").cast("double"))).cast("int")), "domains")

    share = percent / 100
    counts = [r["n"] for r in sets.select("n").distinct().collect()]  # distinct item sizes
    classes = [r["class"] for r in domains.select("class").distinct().collect()]  # 31 at most
    chosen = [(n, c, plan(n, 2 ** (c + 1) - 1, share)) for n in counts for c in classes if 2 ** (c + 1) - 1 >= share * n]
    chosen = spark.createDataFrame(chosen, "n int, class int, width int")

    def keyed(df: DataFrame, ident: str) -> DataFrame:
        rows = df.select(F.col(ident).alias("id"), "members").mapInArrow(_minhash, f"id {dict(df.dtypes)[ident]}, keys array<long>, widths array<int>")
        return rows.select(F.col("id").alias(ident), F.explode(F.arrays_zip("keys", "widths")).alias("z")).select(ident, F.col("z.keys").alias("key"), F.col("z.widths").alias("width"))

    def node(df: DataFrame) -> DataFrame:
        return df.withColumn("item", F.xxhash64(F.lit(1), "members"))

    nodes = node(sets).groupBy("item").agg(F.first("members").alias("members"), F.first("n").alias("n"))
    probes = keyed(nodes, "item").join(nodes.select("item", "n"), "item").join(F.broadcast(chosen), ["n", "width"]).select("item", "key", "class", "width")
    wide = F.broadcast(chosen.where("width > 0").select("class", "width").distinct())
    built = keyed(domains, "domain").join(domains.select("domain", "class"), "domain").join(wide, ["class", "width"])
    near = built.join(probes, ["key", "class", "width"]).select("item", "domain")
    exact = F.broadcast(chosen.where("width = 0").select("class").distinct())
    held = domains.join(exact, "class").select("domain", "class", F.explode("members").alias("s"))
    often = held.groupBy("s").agg(F.count("*").alias("often"))
    looked = nodes.join(F.broadcast(chosen.where("width = 0")), "n").select("item", "n", "class", F.explode("members").alias("s")).join(often, "s")
    looked = looked.groupBy("item", "class").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("often", "s"))).alias("held"))
    # an item needs so many of its n shingles; of those that any domain holds, more than held - needed of the rarest must be tried
    tried = F.size("held") - F.ceil(F.col("n") * percent / 100) + 1
    looked = looked.where(tried > 0).select("item", "class", F.explode(F.slice("held", F.lit(1), tried.cast("int"))).alias("x")).select("item", "class", F.col("x.s").alias("s"))
    near = near.unionByName(held.join(looked, ["class", "s"]).select("item", "domain")).distinct()

    pairs = near.join(nodes, "item").join(domains.select("domain", F.col("members").alias("held")), "domain")
    pairs = pairs.withColumn("n_common", F.size(F.array_intersect("members", "held"))).where(F.col("n_common") * 100 >= F.col("n") * percent)
    pairs = pairs.select("domain", "item", "n_common").join(node(sets).select("item", "item_id", F.col("n").alias("n_item")), "item")
    out = parts.select("doc_id", "domain").join(pairs, "domain").groupBy("doc_id", "item_id").agg(F.max("n_item").cast("long").alias("n_item"), F.max("n_common").cast("long").alias("n_common"))
    return out.withColumn("containment", F.col("n_common") / F.col("n_item"))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id no match of ``find_items`` names (a null id counts as one id)."""
    found = find_items(docs, items, **options).select(F.col("doc_id").alias("found_id")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["found_id"]), "left_anti")


def op10_minhash_containment(spark, sf_dir):
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SHINGLES = """SELECT DISTINCT {0}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [] END) AS sh
  FROM (SELECT {0}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {1})"""
#: Exact containment of items of five words or more (the benchmark has no shorter ones).
OP10_SQL = f"""
WITH d AS ({_SHINGLES.format("doc_id", "documents")}), i AS ({_SHINGLES.format("item_id", "benchmark")}),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_common FROM d JOIN i USING (sh) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_common, n_common::DOUBLE / n_item AS containment FROM c JOIN n USING (item_id) WHERE 100 * n_common >= 80 * n_item
"""
