"""Language identification with a blended-spectrum string kernel.

K(x, y) counts the hashed byte n-grams (n = 2, 3, 4, A-Z lower-cased) that both
texts hold, each once, over the root of the product of their own counts. Nystrom
landmarks span the feature space, and kernel ridge regression one-versus-rest is
solved in it. Because K(x, L) is a product of x's presence vector with the
landmarks' matrix, the landmarks and the dual weights fold into one matrix, and a
batch of texts is scored by one product with it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxledger.llm import _text as T
from ctxledger.llm import presence as P
from ctxledger.llm._work import materialize, table

ORDERS = (2, 3, 4)
LOG2 = 14
#: Bounds of what is gathered: landmarks (one a language at least), labelled rows that the model is fitted on, and
#: languages that it learns (the folded matrix takes 64 KB of a worker for each).
LANDMARKS = 256
TRAIN_ROWS = 3000
LANGUAGES = 500
RIDGE = 1e-3
#: Rows that are unpacked at once.
BLOCK = 64
#: Share of the labelled rows that fitted the model whose ridge score lies under the floor of keep_known.
UNLIKE = 0.001
_LETTER = re.compile(r"[^\W\d_]")  # letters, and a few numerals that isalpha() tells apart


def _packed(batches):
    for b in T.slices(batches):
        raw, off = T.buffers(b.column("text"))
        rows = [r.tobytes() for _, x in P.presence(raw, off, ORDERS, LOG2) for r in np.packbits(x, axis=1)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.binary())], names=["doc_id", "bits"])


def _unit(packed: np.ndarray) -> np.ndarray:
    """Packed presence rows as vectors of length one."""
    x = np.unpackbits(packed, axis=1).astype(np.float32)
    x /= np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))
    return x


def fit(packed: np.ndarray, lang: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, folded matrix, bias) from packed presence rows and their languages.

    Rows are unpacked BLOCK at a time: all of them would take 200 MB of the driver.
    """
    names = sorted(set(lang.tolist()))
    marks = []  # landmarks: the languages take turns
    queues = {c: np.flatnonzero(lang == c).tolist() for c in names}
    most = max(LANDMARKS, len(names))
    while len(marks) < most and any(queues.values()):
        marks += [q.pop(0) for q in queues.values() if q]
    marks = marks[:most]
    land = np.concatenate([_unit(packed[marks[lo : lo + BLOCK]]) for lo in range(0, len(marks), BLOCK)])
    inner = (land @ land.T).astype(np.float64)
    value, vector = np.linalg.eigh(inner)
    keep = value > 1e-6 * value.max()
    whiten = vector[:, keep] / np.sqrt(value[keep])  # K_mm ** -1/2 on its range
    z = np.concatenate([(_unit(packed[lo : lo + BLOCK]) @ land.T).astype(np.float64) @ whiten for lo in range(0, len(packed), BLOCK)])
    y = np.where(lang[:, None] == np.array(names)[None], 1.0, -1.0)
    share = np.array([np.mean(lang == c) for c in lang])
    row = (1 / share / len(names))[:, None]  # every language weighs the same
    mean_z, mean_y = (row * z).sum(0) / row.sum(), (row * y).sum(0) / row.sum()
    zc, yc = z - mean_z, y - mean_y
    alpha = np.linalg.solve(zc.T @ (row * zc) + RIDGE * len(z) * np.eye(z.shape[1]), zc.T @ (row * yc))
    dual = whiten @ alpha
    folded = np.empty((land.shape[1], len(names)), np.float32)
    for lo in range(0, len(folded), 1024):
        folded[lo : lo + 1024] = land[:, lo : lo + 1024].T.astype(np.float64) @ dual
    return names, folded, (mean_y - mean_z @ alpha)


def floor(fitted, packed: np.ndarray, unlike: float) -> float:
    """The ridge score of the best language that all but the share ``unlike`` of the packed rows reach."""
    _, folded, bias = fitted
    best = []
    for lo in range(0, len(packed), BLOCK):
        x = np.unpackbits(packed[lo : lo + BLOCK], axis=1).astype(np.float32)
        best.append(((x @ folded) / np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True))) + bias).max(axis=1))
    return float(np.quantile(np.concatenate(best), unlike))


def train(docs: DataFrame):
    """(languages, folded matrix, bias) fitted on the rows of sample; None if there are none."""
    rows = sample(docs)
    return None if rows is None else fit(*rows)


def sample(docs: DataFrame):
    """(packed presence rows, languages) of about TRAIN_ROWS rows of ``docs`` (doc_id, text, lang) at most.

    Each of the LANGUAGES most frequent languages (ties in order of name) gives the same
    number of rows, one at least, or all it has: those of least hash of the doc_id. Rows
    without lang or doc_id are left out; of a repeated doc_id one counts, the text whose
    features come first in byte order, with the language first in order.
    """
    known = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).dropna(subset=["doc_id", "lang"])
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return None
    each = max(1, TRAIN_ROWS // len(counts))
    # a bound on the hash lets about twice as many rows through before they are put in order
    bounds = [(c, min(2**63 - 1, int(min(1.0, (2 * each + 100) / n) * 2**64) - 2**63)) for c, n in counts.items()]
    bounds = docs.sparkSession.createDataFrame(bounds, "lang string, bound long")
    hashed = F.xxhash64("doc_id", F.lit(6)).alias("hashed")
    near = known.select("doc_id", "lang", hashed).join(F.broadcast(bounds), "lang").where("hashed <= bound")
    near = near.groupBy("doc_id").agg(F.min("lang").alias("lang"), F.min("hashed").alias("hashed"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hashed", "doc_id"))
    chosen = materialize(near.withColumn("place", place).where(F.col("place") <= each).select("doc_id", "lang"), "chosen")
    texts = known.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    rows = texts.mapInArrow(_packed, "doc_id long, bits binary").toPandas().sort_values(["doc_id", "bits"]).drop_duplicates("doc_id")
    lang = {r["doc_id"]: r["lang"] for r in chosen.collect()}
    if not len(rows):
        return None
    packed = np.frombuffer(b"".join(rows.bits), np.uint8).reshape(len(rows), -1)
    return packed, np.array([lang[d] for d in rows.doc_id])


def _predict(model, least: float | None = None):
    def run(batches):
        fitted = model.value
        for b in T.slices(batches):
            raw, off = T.buffers(b.column("text"))
            names, scores = [], []
            if fitted is not None:
                languages, folded, bias = fitted
                for _, bits in P.presence(raw, off, ORDERS, LOG2):
                    x = bits.astype(np.float32)
                    z = (x @ folded) / np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True))) + bias
                    known = np.ones(len(z), bool) if least is None else z.max(axis=1) >= least
                    p = np.exp(4 * (z - z.max(axis=1, keepdims=True)))
                    p /= p.sum(axis=1, keepdims=True)
                    best = p.argmax(axis=1)
                    names += [languages[i] if k else "und" for i, k in zip(best, known, strict=True)]
                    scores += np.where(known, p[np.arange(len(p)), best], 0.0).tolist()
            else:
                names, scores = ["und"] * b.num_rows, [0.0] * b.num_rows
            for i, x in enumerate(b.column("text")):
                if not any(m[0].isalpha() for m in _LETTER.finditer(x.as_py() or "")):
                    names[i], scores[i] = "und", 0.0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row per document of ``docs``: doc_id, lang_pred, score (0 to 1).

    Learns from ``labelled`` (doc_id, text, lang). A null, empty or letterless text
    is ``und`` with score 0, as is every text if nothing is labelled. Ties take the
    language first in order. Repeated rows are predicted alike; other columns,
    null ids and sources play no part; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(labelled))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, labelled: DataFrame, unlike: float | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is recognised (not ``und``), in one pass, all columns as they were.

    With ``unlike``, a text whose best ridge score is under what all but that share of
    the labelled rows reach is ``und`` too: it is like no language that the model
    learnt. So are about that share of texts in a learnt one, mostly of few bytes.
    """
    rows = sample(labelled)
    fitted = None if rows is None else fit(*rows)
    least = None if rows is None or unlike is None else floor(fitted, rows[0], unlike)
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    predict = _predict(model, least)

    def run(batches):
        for b in T.slices(batches):
            (found,) = list(predict([b]))[:1]
            known = pc.not_equal(found.column("lang_pred"), "und")
            yield b.filter(known)

    text = docs.withColumn("text", F.col("text").cast("string"))
    return text.mapInArrow(run, text.schema)


def held_out(mod: int, at: int):
    """Whether crc32 of the id as text leaves ``at`` modulo ``mod``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == at, F.lit(False))


def op6_string_kernel_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, docs.where(~held_out(4, 2)))
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
