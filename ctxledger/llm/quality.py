"""Quality rules and a quality classifier, both by weak supervision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxledger.llm import _text as T
from ctxledger.llm import presence as P
from ctxledger.llm import weak
from ctxledger.llm._work import materialize, smallest_hashes, table
from ctxledger.llm.stats import text_stats


def rules() -> dict[str, Column]:
    """The overlapping heuristics, as votes on the columns of text_stats.

    Each votes bad (-1) beyond one bound of its measure, good (1) within a stricter
    one, and abstains (0) between them and on texts too short for it. Any defect
    shows in two measures or more, so one that fires alone can be outvoted.
    """
    c = F.col
    words, chars, lines, symbols, stops = (c(x) for x in ("n_words", "word_chars", "n_lines", "n_symbols", "n_stops"))
    letters = c("n_upper") + c("n_lower") + c("n_wide")
    some, many = words >= 5, lines >= 3

    def vote(where, bad, good, always_bad=None):
        found = where & bad if always_bad is None else always_bad | (where & bad)
        return F.when(found, -1).when(where & good, 1).otherwise(0)

    return {
        "symbols": vote(some, symbols * 100 > chars * 5, symbols * 100 <= chars),
        "marks": vote(some, symbols * 5 > words, symbols * 50 <= words),
        "letters": vote(some, letters * 100 < chars * 85, letters * 100 >= chars * 93),
        "capitals": vote(some, c("n_upper") * 100 > letters * 30, c("n_upper") * 100 <= letters * 10),
        "exclamations": vote(some, c("n_bangs") * 10 > words, c("n_bangs") * 100 <= words),
        "repeats": vote(some, c("n_repeat_words") * 100 > words * 30, c("n_repeat_words") * 100 <= words * 10),
        "variety": vote(some, c("n_distinct") < F.pow(words, F.lit(0.75)), c("n_distinct") >= F.pow(words, F.lit(0.85))),
        "lines": vote(many, c("n_dup_lines") * 100 > lines * 30, c("n_dup_lines") * 100 <= lines * 10),
        "stops": vote(some, (stops * 2 > words) | (stops * 100 < words), (stops * 50 >= words) & (stops * 4 <= words), words < 1),
        "word_length": vote(some, (chars < words * 3) | (chars * 2 > words * 15), (chars * 2 >= words * 7) & (chars * 2 <= words * 13)),
    }


def _voted(docs: DataFrame, name: str) -> DataFrame:
    stats = materialize(text_stats(docs), name)
    return stats.withColumn("pattern", weak.pattern(list(rules().values())))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, exact base measures, votes' posterior, verdicts.

    base_failed: under 50 words, or over half of the words in repeated 3-word
    windows. Otherwise a document is kept if its posterior P(good | votes) is at
    least 0.5 (a tie keeps): the fitted rates decide whether a bad vote is believed
    against the good ones. Null, empty and blank texts have zero counts
    and fail the base. Repeated rows are judged alike, one row each, and count as
    often as they occur; other columns are ignored; an empty table gives no rows.
    """
    voted, _, _ = weak.label(_voted(docs, "stats"), len(rules()))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return voted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("posterior") >= 0.5)).alias("kept"), "posterior",
    )


# --- quality classifier -------------------------------------------------------------------

ORDERS = (2, 3, 4)
LOG2 = 15
#: The most rows that the scorer learns from; the labels' fit uses all documents.
TRAIN_ROWS = 4000


def _features(log2: int, orders):
    def run(batches):
        for b in T.slices(batches):
            raw, off = T.buffers(b.column("text"))
            rows = [np.packbits(x, axis=1) for _, x in P.presence(raw, off, orders, log2, fold=False)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([r.tobytes() for m in rows for r in m], pa.binary())], names=["doc_id", "bits"])

    return run


def _scores(model, log2: int, orders):
    def run(batches):
        w, bias = model.value
        for b in T.slices(batches):
            raw, off = T.buffers(b.column("text"))
            out = np.full(b.num_rows, float(P.sigmoid(np.array([bias]))[0]))
            for first, bits in P.presence(raw, off, orders, log2, fold=False):
                x = bits.astype(np.float32)
                z = x @ w / np.sqrt(np.maximum(1, x.sum(axis=1))) + bias
                out[first : first + len(x)] = P.sigmoid(z.astype(float))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out)], names=["doc_id", "score"])

    return run


def quality_model(docs: DataFrame):
    """(weights, bias) of the hashed linear scorer, learnt from posterior labels.

    Every document votes; a sample of TRAIN_ROWS at most, half of it from the
    documents that the votes call bad where there are enough, trains the scorer on
    soft labels. The sample depends on doc_id and votes alone.
    """
    voted, _, found = weak.label(_voted(docs, "stats"), len(rules()))
    totals = {True: 0, False: 0}
    for n, p in found.values():
        totals[p >= 0.5] += n
    known = voted.where("doc_id is not null")
    half = TRAIN_ROWS // 2
    most = {True: max(half, TRAIN_ROWS - totals[False]), False: max(half, TRAIN_ROWS - totals[True])}
    parts = [smallest_hashes(known.where((F.col("posterior") >= 0.5) == c), ["doc_id", "posterior"], most[c], totals[c], 3) for c in (True, False)]
    chosen = parts[0].unionByName(parts[1]).groupBy("doc_id").agg(F.max("posterior").alias("posterior"))
    chosen = materialize(chosen, "chosen")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    rows = texts.mapInArrow(_features(LOG2, ORDERS), "doc_id long, bits binary").toPandas()
    labels = {r["doc_id"]: r["posterior"] for r in chosen.collect()}
    rows = rows.sort_values(["doc_id", "bits"]).drop_duplicates("doc_id")  # of texts under one id the features first in byte order
    if not len(rows):
        return np.zeros(1 << LOG2, np.float32), 1.0
    packed = np.frombuffer(b"".join(rows.bits), np.uint8).reshape(len(rows), -1)
    y = np.array([labels[d] for d in rows.doc_id])
    del rows  # the driver fits on one copy
    weight = np.where(y < 0.5, 1.0, 3.0)  # losing a good document costs more
    return P.fit_logistic(packed, y, weight)


def score_quality(docs: DataFrame) -> DataFrame:
    """The documents' doc_id and score, P(good), by the learnt scorer."""
    model = docs.sparkSession.sparkContext.broadcast(quality_model(docs))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(_scores(model, LOG2, ORDERS), "doc_id long, score double")


def classify_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, score, kept (score >= threshold).

    Learns from the documents' own votes; labels are never read. A null or empty
    text has no features and gets the bias alone; repeated rows score alike; null
    ids are scored but never trained on; an empty table gives no rows.
    """
    return score_quality(docs).select("doc_id", "score", (F.col("score") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, in one pass, all columns as they were."""
    model = docs.sparkSession.sparkContext.broadcast(quality_model(docs))
    score = _scores(model, LOG2, ORDERS)

    def run(batches):
        for b in T.slices(batches):
            (found,) = list(score([b]))[:1]
            yield b.filter(pc.greater_equal(found.column("score"), threshold))

    text = docs.withColumn("text", F.col("text").cast("string"))
    return text.mapInArrow(run, text.schema)


def op3_weak_label_quality(spark, sf_dir):
    return classify_quality(table(spark, sf_dir, "documents"))


def op5_weak_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))
