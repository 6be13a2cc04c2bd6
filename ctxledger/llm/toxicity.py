"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxledger.llm import _text as T
from ctxledger.llm import presence as P
from ctxledger.llm._work import first_rows, materialize, smallest_hashes, table
from ctxledger.llm.langid import held_out

ORDERS = (4, 5, 6)
LOG2 = 20
#: N-grams that the classifier looks at: those whose scaled ratio separates best, of all that LEAST labelled rows or more hold.
FEATURES, LEAST = 4096, 3
#: Bounds: labels that are learnt from (their ratios count every one), and rows that the weights are fitted on.
LABELLED, TRAIN_ROWS = 100_000, 12_000


def _hits(raw, off, most: np.ndarray):
    """Distinct (text, bin) pairs of the n-grams whose bins ``most`` marks."""
    pairs = [np.zeros(0, np.int64)]
    for d, b in P.ngram_bins(raw, off, ORDERS, LOG2, mark=most):
        pairs.append((d << LOG2) | b)
    pair = np.unique(np.concatenate(pairs))
    return pair >> LOG2, pair & ((1 << LOG2) - 1)


def _each(raw, off):
    """The distinct bins of each text in turn."""
    for lo, hi in zip(off[:-1].tolist(), off[1:].tolist()):
        found = [b for _, b in P.ngram_bins(raw[lo:hi], np.array([0, hi - lo]), ORDERS, LOG2)]
        bins = np.concatenate(found) if found else np.zeros(0, np.int32)
        bins.sort()
        yield bins[np.append(True, bins[1:] != bins[:-1])] if len(bins) else bins


def _frequencies(batches):
    """Document frequency of each bin by class, of rows and of distinct texts, summed over the task."""
    total, texts = np.zeros((2, 1 << LOG2), np.int64), np.zeros((2, 1 << LOG2), np.int64)
    for b in T.slices(batches):
        raw, off = T.buffers(b.column("text"))
        label = b.column("label").to_numpy(zero_copy_only=False)
        for c, n, bins in zip(label.tolist(), b.column("copies").to_pylist(), _each(raw, off), strict=True):
            total[c][bins] += n
            texts[c][bins] += 1
    at = np.flatnonzero(total.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at]), pa.array(texts[0][at]), pa.array(texts[1][at])], names=["bin", "clean", "toxic", "clean_texts", "toxic_texts"])


def _rows(chosen):
    index = np.full(1 << LOG2, -1, np.int64)
    index[chosen] = np.arange(len(chosen))
    mark = index >= 0

    def run(batches):
        for b in T.slices(batches):
            raw, off = T.buffers(b.column("text"))
            doc, bins = _hits(raw, off, mark)
            bits = np.zeros((b.num_rows, FEATURES), np.uint8)
            bits[doc, index[bins]] = 1
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], names=["doc_id", "label", "bits"])

    return run


def train(labelled: DataFrame):
    """(bins, weights, bias) from rows of doc_id, text and label (0 or 1).

    Log-count ratios count every row; the FEATURES n-grams are those of greatest gain
    by distinct texts, so that copies of one text do not crowd out others, ties by a
    hash of the bin; a fit on all 2**LOG2 bins finds fewer toxic texts (README). The weights are fitted on about TRAIN_ROWS rows at most, chosen
    by doc_id, half of them of each class where there are enough, each class at its
    true weight. No rows, or one class only: no bins, and a bias of the
    class share.
    """
    rows = labelled.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("label").cast("int")).dropna(subset=["doc_id", "label"])
    counts = {r["label"]: r["count"] for r in rows.where("label in (0, 1)").groupBy("label").count().collect()}
    clean, toxic = counts.get(0, 0), counts.get(1, 0)
    if not clean or not toxic:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), 5.0 if toxic else -5.0
    rows = rows.where("label in (0, 1)")
    copies = materialize(rows.groupBy("text", "label").agg(F.count("*").alias("copies")), "copies")
    kinds = {r["label"]: r["count"] for r in copies.groupBy("label").count().collect()}
    found = copies.mapInArrow(_frequencies, "bin long, clean long, toxic long, clean_texts long, toxic_texts long")
    found = found.groupBy("bin").agg(*(F.sum(c).alias(c) for c in found.columns[1:])).where(F.col("toxic") + F.col("clean") >= LEAST)

    def ratio(toxic_n, clean_n, all_toxic, all_clean):
        return F.log((F.col(toxic_n) + 0.5) / (all_toxic + 1)) - F.log((F.col(clean_n) + 0.5) / (all_clean + 1))

    gain = F.abs(ratio("toxic_texts", "clean_texts", kinds[1], kinds[0])) * F.sqrt(F.col("toxic_texts") + 1)
    found = found.select("bin", ratio("toxic", "clean", toxic, clean).alias("ratio"), gain.alias("gain")).where("gain > 0")
    best = first_rows(materialize(found, "ratios"), FEATURES, "gain", "bin").toPandas().sort_values("bin")
    bins, scale_of = best.bin.to_numpy(), best.ratio.to_numpy()
    rates = [min(1.0, max(TRAIN_ROWS / 2, TRAIN_ROWS - other) / n) * 1e6 for n, other in ((clean, toxic), (toxic, clean))]
    some = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_000)) < F.when(F.col("label") == 1, rates[1]).otherwise(rates[0]))
    sample = some.mapInArrow(_rows(bins), "doc_id long, label int, bits binary").toPandas().sort_values(["doc_id", "label"])
    if sample.label.nunique() < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log(toxic / clean))
    packed = np.frombuffer(b"".join(sample.bits), np.uint8).reshape(len(sample), -1)
    scale = np.zeros(FEATURES, np.float32)
    scale[: len(bins)] = scale_of
    y = sample.label.to_numpy().astype(float)
    drawn = np.array([(y == 0).sum(), (y == 1).sum()])
    weight = (np.array([clean, toxic]) / (clean + toxic) / (drawn / len(y)))[y.astype(int)]
    w, bias = P.fit_logistic(packed, y, weight, scale=scale, norm=False, epochs=25, rate=0.05, l2=1e-4)
    return bins, w[: len(bins)], bias


def _scores(model):
    def run(batches):
        bins, w, bias = model.value
        weight = np.zeros(1 << LOG2, np.float32)
        weight[bins] = w
        mark = np.zeros(1 << LOG2, bool)
        mark[bins] = True
        for b in T.slices(batches):
            raw, off = T.buffers(b.column("text"))
            doc, hit = _hits(raw, off, mark)
            z = np.bincount(doc, weights=weight[hit], minlength=b.num_rows) + bias
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(P.sigmoid(z))], names=["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (score >= 0.5).

    Whole texts; A-Z lower-cased. A null or empty text has no n-grams and gets the
    bias. Repeated rows score alike; other columns play no part; an empty table
    gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(labelled))
    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scores(model), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, text, label) of documents with a label, ``most`` labels at most, chosen by doc_id.

    labels: doc_id, label; of several the largest counts, null ones do not. The chosen
    labels are bounded, so they are broadcast and no text is shuffled.
    """
    most = LABELLED if most is None else most
    one = labels.select(F.col("doc_id").cast("long"), F.col("label").cast("int")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    one = materialize(one, "labels")
    chosen = smallest_hashes(one, ["doc_id", "label"], most, one.count(), 5)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.join(F.broadcast(chosen), "doc_id")


def op8_ngram_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out(5, 0)).select("doc_id", F.col("toxic").alias("label"))
    out = score_toxicity(docs, labelled_texts(docs, labels))
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")
