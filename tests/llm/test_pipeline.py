"""Each stage of the pipeline against brute force, and its edge cases."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as C
from ctxledger.llm import _text as T
from ctxledger.llm import langid, packing, quality
from ctxledger.llm import presence as P
from tests.llm.test_corpus import DOCS, brute_components, junk, odd_docs, shingles

SYLLABLES = {"aa": ["tam", "tim", "tom", "tum"], "bb": ["lok", "lek", "lik", "luk"]}


def text(rng, lang, n=90):
    w = [rng.choice(SYLLABLES[lang]) + rng.choice(SYLLABLES[lang]) + rng.choice("aeiou") for _ in range(n)]
    return ". ".join(" ".join(w[i : i + 9]) for i in range(0, n, 9)) + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(1000 + i, text(rng, lang), lang, "s", 1) for i, lang in enumerate(["aa", "bb"] * 60)]
    out += [(2000 + i, junk(rng), None, "s", 1) for i in range(15)]
    out += [(3000 + i, " ".join(out[i][1].split()[:-1]), "aa", "s", 1) for i in range(10)]  # near copies
    out += [(3100 + i, out[i][1], "aa", "s", 1) for i in range(5)]  # exact copies
    return out


def ids(df):
    return sorted(str(r["doc_id"]) for r in df.select("doc_id").collect())


def test_language_stage_equals_scores_and_floor(spark, rows):
    docs = spark.createDataFrame([*rows, (9000, "漢字かな" * 40, None, "s", 1), (9001, "12 34", "aa", "s", 1)], DOCS)
    kept = C.language(spark, docs, "")
    packed, lang = langid.sample(docs.where(~langid.held_out(4, 2)))
    fitted = langid.fit(packed, lang)
    least = langid.floor(fitted, packed, langid.UNLIKE)

    def stays(t):
        if not any(c.isalpha() for c in t or ""):
            return False
        raw, off = T.buffers(pa.array([t]))
        (_, bits), *_ = P.presence(raw, off, langid.ORDERS, langid.LOG2)
        x = bits.astype(np.float32)
        return float(((x @ fitted[1]) / np.sqrt(np.maximum(1, x.sum())) + fitted[2]).max()) >= least

    expect = sorted(str(r["doc_id"]) for r in docs.collect() if stays(r["text"]))
    assert ids(kept) == expect and "9000" not in expect and "9001" not in expect and kept.columns == docs.columns


def test_quality_stage_equals_scores(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    scores = {r["doc_id"]: r["score"] for r in quality.classify_quality(docs).collect()}
    kept = C.quality_filter(spark, docs, "")
    assert ids(kept) == sorted(str(d) for d, s in scores.items() if s >= 0.5) and kept.columns == docs.columns
    assert not any(i.startswith("20") for i in ids(kept)) and sum(i.startswith("1") for i in ids(kept)) >= 118


def test_near_dedup_stage_equals_brute_force(spark, rows):
    odd = [(None, rows[0][1], None, None, None), (None, "alone with null id " * 5, None, None, None), (4000, None, None, None, None), (4001, "", None, None, None), (4002, " ", None, None, None), (4003, "tie", None, None, None), (4003, "tie", None, None, None)]
    every = [*rows, *odd]
    docs = spark.createDataFrame(every, DOCS)
    component, sizes = brute_components([(d, t) for d, t, *_ in every], 5, 80)
    expect = {(d, t) for (d, t, *_), c, n in zip(every, component, sizes, strict=True) if n == 0 or d == c or (d is None and c is None)}
    kept = C.near_dedup(spark, docs, "")
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert set(got) == expect and len(got) == len(expect) and kept.columns == docs.columns


def test_decontamination_stage_equals_brute_force(spark, rows, tmp_path):
    items = [(1, rows[3][1][:200]), (2, None), (3, ""), (4, "never seen in any of the texts at all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([*rows, (None, "null id", None, None, None), (5000, None, None, None, None)], DOCS)

    def holds(t, item):
        want = shingles(item, 5)
        return bool(want) and 100 * len(want & shingles(t, 5)) >= 80 * len(want)

    kept = C.decontamination(spark, docs, str(tmp_path))
    expect = sorted(str(r["doc_id"]) for r in docs.collect() if not any(holds(r["text"], x) for _, x in items))
    assert ids(kept) == expect and len(expect) < docs.count() and kept.columns == docs.columns


def test_pack_stage_is_pack(spark, rows):
    docs = spark.createDataFrame(rows[:40], DOCS)
    got = sorted(tuple(r) for r in C.pack(spark, docs, "").collect())
    whole = packing.pack(docs).selectExpr("doc_id", "start", "length", "crc32(tokens) AS ids_crc32", "doc_tokens", "sequence_id", "offset")
    assert got == sorted(tuple(r) for r in whole.collect())
    assert {r[0] for r in got} == {r[0] for r in rows[:40]}


@pytest.mark.parametrize("stage", range(4))
def test_stages_take_odd_tables(spark, stage, tmp_path):
    """Nulls, empties, a long text, repeated rows and clashing columns pass through every stage; an empty table stays empty."""
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd_docs(spark)
    run = C.STAGES[stage][1]
    kept = run(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    empty = run(spark, docs.limit(0), str(tmp_path))
    assert empty.count() == 0 and empty.columns == docs.columns
