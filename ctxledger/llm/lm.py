"""Language-model scoring: prediction by partial matching over byte contexts.

Training counts every window of ORDER + 1 bytes of the learning texts, each text
framed by ORDER opening marks and one closing mark (byte 0xFF, which UTF-8 never
uses). The trie of contexts up to ORDER bytes follows from those counts. A byte is
looked up in the longest context that has been seen. One not seen there escapes to
the next shorter one: of t windows with d distinct successors a byte seen n times has
(2 n - 1) / 2 t, and d / 2 t is left to escape (method D). What the longer context has
seen is excluded there, and under the shortest one the 256 byte values are alike.

The counts stay whole in a table. The trie that workers hold is a cache of its most
frequent contexts, each with all that followed it, which they read from the shared
folder, so that none of it passes through the driver; a window whose context is not cached, and
may have been seen, is handed out and scored by joins with the counts of all orders.

The unigram base score needs the count of every token. The most frequent tokens
are broadcast in a table of fixed size; the others are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxledger.llm import _text as T
from ctxledger.llm._work import materialize, most_frequent, read_columns, table, written
from ctxledger.llm.langid import held_out

MARK = 0xFF
#: Bytes of the longest context; 7 at most, so that a window fits a signed long.
ORDER = 5
#: Bounds of what a worker holds: cells (a context and a byte after it) of the trie, frequent tokens.
CELLS, FREQUENT = 4_000_000, 131_072
#: Distinct counts that a task holds before it hands them on.
HELD = 1_000_000
WORD, WINDOW, TEXT = 0, 1, 2


def _tail(n: int) -> int:
    """Mask of a key's last n bytes."""
    return (1 << 8 * n) - 1


def windows(raw: np.ndarray, offsets: np.ndarray):
    """Windows of ORDER + 1 bytes, one for each byte of each text and its closing mark, in parts; text i has offsets[i + 1] - offsets[i] + 1."""
    n, wide = len(offsets) - 1, ORDER + 1
    framed = np.full(len(raw) + wide * n, MARK, np.uint8)
    framed[np.arange(len(raw)) + np.repeat(wide * np.arange(n) + ORDER, np.diff(offsets))] = raw
    first = offsets + np.arange(n + 1)
    for lo in range(0, int(first[-1]), T.SEGMENT):
        at = np.arange(lo, min(int(first[-1]), lo + T.SEGMENT))
        at += ORDER * (np.searchsorted(first, at, "right") - 1)
        keys = np.zeros(len(at), np.uint64)
        for j in range(wide):
            keys = (keys << np.uint64(8)) | framed[at + j]
        yield keys


def _merge(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def _count(batches):
    """(kind, key, n) of words, windows and texts, merged within the task."""
    kept = {WORD: [[], [], 0], WINDOW: [[], [], 0]}
    texts = 0

    def hand(kind, keys, counts):
        for lo in range(0, len(keys), 100_000):
            k, c = keys[lo : lo + 100_000].astype(np.uint64).view(np.int64), counts[lo : lo + 100_000].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(c)], names=["kind", "key", "n"])

    for b in T.slices(batches):
        raw, off = T.buffers(b.column("text"))
        texts += b.num_rows
        for kind, keys in [(WORD, T.words(raw, off).hash), *((WINDOW, k) for k in windows(raw, off))]:
            keys, counts = np.unique(keys, return_counts=True)
            held = kept[kind]
            held[0].append(keys)
            held[1].append(counts)
            held[2] += len(keys)
            if held[2] > HELD:
                keys, counts = _merge(held[0], held[1])
                if len(keys) > HELD // 2:
                    yield from hand(kind, keys, counts)
                    kept[kind] = [[], [], 0]
                else:
                    kept[kind] = [[keys], [counts], len(keys)]
    for kind, held in kept.items():
        if held[0]:
            yield from hand(kind, *_merge(held[0], held[1]))
    yield from hand(TEXT, np.zeros(1, np.uint64), np.array([texts]))


def _find(names: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, whether there) of ``wanted`` in sorted ``names``."""
    if not len(names):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return at, names[at] == wanted


class Trie:
    """Cells and contexts of each order, sorted by key.

    A context holds t windows, d distinct successors, and r windows of its next
    shorter context that end in one of these successors: what exclusion takes there.
    """

    def __init__(self, grams, whole: bool):
        """``grams``: by order, (keys, counts) of contexts with all their successors; ``whole``: whether every context is there."""
        self.whole, self.orders = whole, []
        for order, (keys, counts) in enumerate(grams):
            turn = np.argsort(keys)
            keys, counts = keys[turn], counts[turn].astype(np.int64)
            first = np.flatnonzero(np.append(True, (keys[1:] ^ keys[:-1]) >> np.uint64(8) != 0)) if len(keys) else np.zeros(0, np.int64)
            if not len(keys):
                t = d = r = np.zeros(0)
            else:
                t, d = np.add.reduceat(counts, first, dtype=np.float64), np.diff(np.append(first, len(keys))).astype(np.uint16)
                r = np.zeros(1)
                if order:
                    _, _, _, _, below, under = self.orders[-1]
                    r = np.add.reduceat(under[_find(below, keys & np.uint64(_tail(order)))[0]], first, dtype=np.float64)
            self.orders.append((keys[first] >> np.uint64(8), t, d, r, keys, counts))

    def _unseen(self, order: int, context: np.ndarray) -> np.ndarray:
        """Whether contexts of ``order`` bytes surely never occurred: as a window, with a cached context of its own, they have no cell."""
        names, _, _, _, cells, _ = self.orders[order - 1]
        return _find(names, context >> np.uint64(8))[1] & ~_find(cells, context)[1] & ((context & np.uint64(255)) != MARK)

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each window; NaN where the cache can't tell."""
        out = np.full(len(keys), np.nan)
        at = np.arange(len(keys))
        total, begun = np.zeros(len(keys)), np.zeros(len(keys), bool)
        used_t, used_d = np.zeros(len(keys)), np.zeros(len(keys))
        for order in range(ORDER, -1, -1):
            names, t, d, r, cells, counts = self.orders[order]
            gram = keys[at] & np.uint64(_tail(order + 1))
            context, there = _find(names, gram >> np.uint64(8))
            if not self.whole and order:
                sure = there | begun
                sure[~sure] = self._unseen(order, gram[~sure] >> np.uint64(8))
                at, total, begun, used_t, used_d, gram, context, there = (x[sure] for x in (at, total, begun, used_t, used_d, gram, context, there))
            cell, seen = _find(cells, gram)
            some = np.flatnonzero(there)
            open_t, open_d = np.zeros(len(at)), np.zeros(len(at))
            open_t[some], open_d[some] = t[context[some]] - used_t[some], d[context[some]] - used_d[some]
            hit = np.flatnonzero(seen)
            out[at[hit]] = total[hit] + np.log10((2.0 * counts[cell[hit]] - 1) / (2 * open_t[hit]))
            escape = np.flatnonzero(~seen & (open_t > 0))
            total[escape] += np.log10(open_d[escape] / (2 * open_t[escape]))
            used_t[some], used_d[some] = r[context[some]], d[context[some]]
            begun |= there
            left = ~seen
            at, total, begun, used_t, used_d = (x[left] for x in (at, total, begun, used_t, used_d))
        out[at] = total - np.log10(256 - used_d)
        return out

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each text without its unsettled windows; the texts and keys of these."""
        first = offsets + np.arange(len(offsets))
        total, texts, left = np.zeros(len(offsets) - 1), [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        lo = 0
        for keys in windows(raw, offsets):
            distinct, back = np.unique(keys, return_inverse=True)
            logs = self.logs(distinct)[back]
            doc = np.searchsorted(first, np.arange(lo, lo + len(keys)), "right") - 1
            unsure = np.flatnonzero(np.isnan(logs))
            logs[unsure] = 0
            total += np.bincount(doc, weights=logs, minlength=len(total))
            texts.append(doc[unsure])
            left.append(keys[unsure])
            lo += len(keys)
        return total, np.concatenate(texts), np.concatenate(left)


#: The worker's trie, by the path of its cells.
_tries: dict = {}


def _scores(model):
    def run(batches):
        path, whole, frequent, known, ends = model.value
        if path not in _tries:
            _tries.clear()
            _tries[path] = _load(path, whole)
        trie = _tries[path]
        logs = np.append(np.log10(known + 1.0), 0.0)
        for b in T.slices(batches):
            raw, off = T.buffers(b.column("text"))
            w = T.words(raw, off)
            at = np.searchsorted(frequent, w.hash)
            at[at == len(frequent)] = 0
            hit = frequent[at] == w.hash if len(frequent) else np.zeros(len(w.hash), bool)
            at = np.where(hit, at, len(known))
            part = np.concatenate([[0.0], np.cumsum(logs[at])])
            hits = np.concatenate([[0], np.cumsum(hit)])
            miss = np.flatnonzero(~hit)
            score, texts, left = trie.score(raw, off)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("row"),
                    b.column("doc_id"),
                    pa.array((w.counts + 1).astype(np.int64)),
                    pa.array(hits[w.first[1:]] - hits[w.first[:-1]] + (ends > 0)),
                    pa.array(part[w.first[1:]] - part[w.first[:-1]] + np.log10(ends + 1.0)),
                    T.ragged(np.searchsorted(miss, w.first), w.hash[miss].view(np.int64)),
                    pa.array(score),
                    T.ragged(np.searchsorted(texts, np.arange(len(off))), left.astype(np.int64)),
                ],
                names=["row", "doc_id", "n_tokens", "n_known", "logs", "rare", "score", "left"],
            )

    return run


def _grams(windows_: DataFrame) -> DataFrame:
    """(order, key, n) of orders 0 to ORDER: every context with the byte after it."""
    found = windows_.select(F.lit(ORDER).alias("order"), "key", "n")
    for order in range(ORDER):
        shorter = windows_.groupBy(F.col("key").bitwiseAND(F.lit(_tail(order + 1))).alias("key")).agg(F.sum("n").alias("n"))
        found = found.unionByName(shorter.select(F.lit(order).alias("order"), "key", "n"))
    return found


def _cached(grams: DataFrame) -> tuple[DataFrame, bool]:
    """Rows of ``grams`` of the most frequent contexts, and whether they are all.

    Orders 0 and 1 have 65,792 cells at most and are taken whole; of the others, the
    contexts seen most often, as far as CELLS cells in all go. A context comes with
    all its cells or not at all, and never without the shorter ones, which are seen no
    less often.
    """
    context = F.shiftright("key", 8)
    contexts = grams.where("order > 1").groupBy("order", context.alias("context")).agg(F.sum("n").alias("t"), F.count("*").alias("d"))
    step = F.floor(F.log2(F.col("t").cast("double")) * 64).cast("int")
    steps = sorted(((r["s"], r["d"]) for r in contexts.groupBy(step.alias("s")).agg(F.sum("d").alias("d")).collect()), reverse=True)
    cells, least, whole = 0, None, True
    for s, d in steps:
        if cells + d > CELLS:
            whole = False
            break
        cells, least = cells + d, s
    if whole:
        return grams, True
    chosen = contexts.where(F.lit(False) if least is None else step >= least).select("order", "context")
    long = grams.where("order > 1").withColumn("context", context).join(chosen, ["order", "context"], "left_semi").drop("context")
    return grams.where("order < 2").unionByName(long), False


def _load(path: str, whole: bool) -> Trie:
    def cells():
        for order in range(ORDER + 1):
            key, n = read_columns(path, ["key", "n"], order=order)
            yield key.view(np.uint64), n

    return Trie(cells(), whole)


def _probabilities(wanted: DataFrame, grams: DataFrame) -> DataFrame:
    """(key, log10 probability p) of the distinct windows ``wanted`` (key), from the whole counts.

    What a context has seen its shorter ones have seen too, so under exclusion a
    shorter context has the distinct successors d less those of the longer one, and
    the total t less what it counts for them, r.
    """
    out = wanted
    for order in range(ORDER + 1):
        cells = grams.where(F.col("order") == order).select("key", "n")
        rows = cells.withColumn("m", F.lit(0))
        if order:
            below = grams.where(F.col("order") == order - 1).select(F.col("key").alias("under"), F.col("n").alias("m"))
            rows = cells.join(below, F.col("key").bitwiseAND(F.lit(_tail(order))) == F.col("under"))
        contexts = rows.groupBy(F.shiftright("key", 8).alias("c")).agg(F.sum("n").alias(f"t{order}"), F.count("*").alias(f"d{order}"), F.sum("m").alias(f"r{order}"))
        gram = F.col("key").bitwiseAND(F.lit(_tail(order + 1)))
        cells = cells.select(F.col("key").alias("cell"), F.col("n").alias(f"n{order}"))
        out = out.join(cells, gram == F.col("cell"), "left").drop("cell")
        out = materialize(out.join(contexts, F.shiftright(gram, 8) == F.col("c"), "left").drop("c"), "paths")
    out = out.fillna(0)
    p = 1.0 / (256 - F.col("d0"))
    for order in range(ORDER + 1):
        n, t, d = (F.col(f"{x}{order}") for x in "ntd")
        if order < ORDER:
            t, d = t - F.col(f"r{order + 1}"), d - F.col(f"d{order + 1}")
        p = F.when(n > 0, (2 * n - 1) / (2 * t)).otherwise(F.when(t > 0, d / (2 * t)).otherwise(1.0) * p)
    return out.select("key", F.log10(p).alias("p"))


def score_texts(docs: DataFrame, learn: DataFrame) -> DataFrame:
    """One row per document of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    score is the log10 probability of the whole text, bytes and end, under the byte
    model learnt from ``learn``; base_score that of its tokens under add-one
    unigrams. Tokens are words (cut at ASCII white space, A-Z lower-cased) and one
    end. A null text is an empty one: its end alone is scored. With nothing to learn
    from, bytes are alike and base_score is 0. Repeated rows are scored each; null
    ids stay null; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    found = learn.select(F.col("text").cast("string")).mapInArrow(_count, "kind int, key long, n long")
    counts = materialize(found.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words = counts.where(F.col("kind") == WORD)
    sums = {r["kind"]: (r["s"], r["v"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("s"), F.count("*").alias("v")).collect()}
    ends = sums.get(TEXT, (0, 0))[0]
    tokens, distinct = sums.get(WORD, (0, 0))[0] + ends, sums.get(WORD, (0, 0))[1] + (ends > 0)
    top = most_frequent(words.select("key", "n"), FREQUENT).toPandas()
    frequent = top.key.to_numpy().view(np.uint64)
    order = np.argsort(frequent)
    path = written(_grams(counts.where(F.col("kind") == WINDOW).select("key", "n")), "grams")
    grams = spark.read.schema("order int, key long, n long").parquet(path)
    cells, whole = _cached(grams)
    model = spark.sparkContext.broadcast((path if whole else written(cells, "cached"), whole, frequent[order], top.n.to_numpy()[order].astype(float), int(ends)))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = rows.mapInArrow(_scores(model), "row long, doc_id long, n_tokens long, n_known long, logs double, rare array<long>, score double, left array<long>")
    scored = materialize(scored, "scored")
    rare = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times")).join(words.select("key", "n"), "key")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1) * F.col("times")).alias("more"), F.sum("times").alias("known"))
    out = scored.drop("rare", "left").join(rare, "row", "left")
    score = F.col("score")
    if not whole:
        left = scored.select("row", F.explode("left").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
        left = materialize(left, "left")
        left = left.join(_probabilities(left.select("key").distinct(), grams), "key").groupBy("row").agg(F.sum(F.col("p") * F.col("times")).alias("late"))
        out = out.join(left, "row", "left")
        score = score + F.coalesce("late", F.lit(0.0))
    base = F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(tokens + distinct + 1))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def op7_ppm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = score_texts(docs, docs.where(~held_out(7, 2)))
    return out.select("doc_id", held_out(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
