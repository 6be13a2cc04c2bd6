"""The learnt models against explicit versions of their methods."""

import collections
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from ctxledger.llm import _text as T
from ctxledger.llm import langid, toxicity
from ctxledger.llm import presence as P


def grams(text, orders):
    b = (text or "").encode().lower() if (text or "").isascii() else bytes(T.LOWER[np.frombuffer((text or "").encode(), np.uint8)])
    return {b[i : i + n] for n in orders for i in range(len(b) - n + 1)}


def bin_of(gram, log2):
    """The bin of one n-gram, as the only one of its length in a text."""
    found = [b for _, b in P.ngram_bins(np.frombuffer(gram, np.uint8), np.array([0, len(gram)]), (len(gram),), log2)]
    return int(found[0][0])


def test_presence_equals_sets_of_grams():
    texts = ["Abcabc", "", "é漢 xyz", "aaaa", "ab"]
    raw, off = T.buffers(pa.array(texts))
    (_, bits), *_ = P.presence(raw, off, (2, 3, 4), 14)
    for text, row in zip(texts, bits, strict=True):
        assert set(np.flatnonzero(row).tolist()) == {bin_of(g, 14) for g in grams(text, (2, 3, 4))}


def brute_scores(sets, lang, tests, marks, ridge):
    """Kernel ridge regression on Nystrom features, from explicit kernels: one-versus-rest, every language of the same weight."""

    def kernel(x, y):
        return len(x & y) / math.sqrt(max(1, len(x)) * max(1, len(y)))

    land = [sets[i] for i in marks]
    k_mm = np.array([[kernel(a, b) for b in land] for a in land])
    value, vector = np.linalg.eigh(k_mm)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] @ np.diag(value[keep] ** -0.5)
    z = np.array([[kernel(a, b) for b in land] for a in sets]) @ root
    names = sorted(set(lang))
    weight = np.array([len(lang) / lang.count(c) / len(names) for c in lang])
    out = []
    for c in names:
        y = np.array([1.0 if x == c else -1.0 for x in lang])
        mz, my = weight @ z / weight.sum(), weight @ y / weight.sum()
        a = np.vstack([np.sqrt(weight)[:, None] * (z - mz), math.sqrt(ridge * len(lang)) * np.eye(z.shape[1])])
        w = np.linalg.lstsq(a, np.concatenate([np.sqrt(weight) * (y - my), np.zeros(z.shape[1])]), rcond=None)[0]
        out.append([(np.array([kernel(t, b) for b in land]) @ root - mz) @ w + my for t in tests])
    return names, np.array(out).T


def test_language_scores_equal_explicit_kernel_ridge(monkeypatch):
    monkeypatch.setattr(langid, "LANDMARKS", 12)
    rng = random.Random(1)
    make = {"aa": ["tam", "tim", "tom"], "bb": ["lok", "lek", "lim"], "cc": ["öß", "äß", "tim"]}
    texts = [(" ".join(rng.choice(make[c]) + rng.choice(make[c]) for _ in range(rng.randint(1, 12))), c) for c in ["aa"] * 20 + ["bb"] * 12 + ["cc"] * 5]
    tests = ["tam lok", "öß", "", "tamtim lek", "zzz"]
    bits = {t: {bin_of(g, langid.LOG2) for g in grams(t, langid.ORDERS)} for t in [x for x, _ in texts] + tests}

    def rows(names):
        out = np.zeros((len(names), 1 << langid.LOG2), np.uint8)
        for i, n in enumerate(names):
            out[i, list(bits[n])] = 1
        return out

    lang = [c for _, c in texts]
    names, folded, bias = langid.fit(np.packbits(rows([t for t, _ in texts]), axis=1), np.array(lang))
    queues, marks = {c: [i for i, x in enumerate(lang) if x == c] for c in names}, []
    while len(marks) < 12:
        marks += [q.pop(0) for q in queues.values() if q]
    x = rows(tests).astype(float)
    got = x @ folded / np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True))) + bias
    expect_names, expect = brute_scores([bits[t] for t, _ in texts], lang, [bits[t] for t in tests], marks[:12], langid.RIDGE)
    assert names == expect_names and got == pytest.approx(expect, abs=2e-3)


def test_language_sample(spark, monkeypatch):
    """The same number of rows of each language, all of a rare one, whatever the partitions; the most frequent languages of many."""
    monkeypatch.setattr(langid, "TRAIN_ROWS", 90)
    rows = [(i, f"text {i}", ["aa", "aa", "aa", "bb"][i % 4]) for i in range(4000)] + [(5000, "rare", "cc"), (5000, "rare", "cc"), (None, "x", "aa"), (6000, "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    packed, lang = langid.sample(docs)
    assert collections.Counter(lang.tolist()) == {"aa": 30, "bb": 30, "cc": 1}
    again, _ = langid.sample(docs.repartition(5))
    assert (packed == again).all()
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    assert set(langid.sample(docs)[1].tolist()) == {"aa", "bb"}


def test_language_ties_and_long_texts(spark):
    train = spark.createDataFrame([(1, "abab abab", "yy"), (2, "abab abab", "xx")], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, "abab " * 300_000), (2, "abab abab"), (2, "abab abab")], "doc_id long, text string")
    got = langid.identify(docs, train).collect()
    assert len(got) == 3 and {r["lang_pred"] for r in got} == {"xx"} and all(r["score"] == pytest.approx(0.5, abs=1e-3) for r in got)


def brute_ratios(rows, orders, log2):
    """Log-count ratio and gain of each bin, with dictionaries."""
    total, texts = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    n, kinds = [0, 0], [set(), set()]
    for text, y in rows:
        found = {bin_of(g, log2) for g in grams(text, orders)}
        total[y].update(found)
        if text not in kinds[y]:
            texts[y].update(found)
        kinds[y].add(text)
        n[y] += 1
    out = {}
    for b in set(total[0]) | set(total[1]):
        if total[0][b] + total[1][b] >= toxicity.LEAST:
            ratio = math.log((total[1][b] + 0.5) / (n[1] + 1)) - math.log((total[0][b] + 0.5) / (n[0] + 1))
            by_text = math.log((texts[1][b] + 0.5) / (len(kinds[1]) + 1)) - math.log((texts[0][b] + 0.5) / (len(kinds[0]) + 1))
            if by_text:
                out[b] = (ratio, abs(by_text) * math.sqrt(texts[1][b] + 1))
    return out


def test_toxicity_equals_explicit_ratios_and_logistic(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FEATURES", 64)
    rng = random.Random(3)
    rows = []
    for i in range(140):
        w = [rng.choice(["house", "water", "people", "often", "near"]) for _ in range(8)]
        if i % 3 == 0:
            w[rng.randrange(8)] = rng.choice(["idiot", "moron"])
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    rows += [(200 + i, rows[0][1], 1) for i in range(10)]  # copies
    bins, weights, bias = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    ratios = brute_ratios([(t, y) for _, t, y in rows], toxicity.ORDERS, toxicity.LOG2)
    gains = sorted((g for _, g in ratios.values()), reverse=True)
    assert len(bins) == min(64, len(ratios))
    assert sorted((ratios[b][1] for b in bins.tolist()), reverse=True) == pytest.approx(gains[: len(bins)])
    # the logistic fit, in plain float64, a mini-batch at a time
    y = np.array([r[2] for r in rows], float)
    x = np.array([[(b in {bin_of(g, toxicity.LOG2) for g in grams(t, toxicity.ORDERS)}) * ratios[b][0] for b in bins.tolist()] for _, t, _ in rows])
    w, b, gw, gb = np.zeros(len(bins)), 0.0, np.full(len(bins), 1e-6), 1e-6
    order = np.random.default_rng(0)
    for _ in range(25):
        for at in np.array_split(order.permutation(len(y)), max(1, len(y) // 128)):
            g = (1 / (1 + np.exp(-(x[at] @ w + b))) - y[at]) / len(at)
            dw, db = x[at].T @ g + 1e-4 * w, g.sum()
            gw += dw * dw
            gb += db * db
            w -= 0.05 * dw / np.sqrt(gw)
            b -= 0.05 * db / np.sqrt(gb)
    assert weights == pytest.approx(w * np.array([ratios[b][0] for b in bins.tolist()]), abs=5e-3) and bias == pytest.approx(b, abs=5e-3)
    tests = ["you idiot", "people near water", "", None]
    docs = spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, spark.createDataFrame(rows, "doc_id long, text string, label int")).collect()}
    for i, t in enumerate(tests):
        z = bias + sum(wt for b, wt in zip(bins.tolist(), weights, strict=True) if b in {bin_of(g, toxicity.LOG2) for g in grams(t, toxicity.ORDERS)})
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


def test_toxicity_of_identical_toxic_rows(spark):
    """Forty exact copies of one toxic text are learnt, and no clean text is blamed."""
    rows = [(i, "a rude and vile sentence that is copied " * 3, 1) for i in range(40)] + [(100 + i, f"clean text number {i} about rivers and stones", 0) for i in range(200)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(labelled, labelled).collect()}
    assert all(got[i] == y for i, _, y in rows)


def test_labels_are_drawn_exactly(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3000)], "doc_id long, label int")
    first = {r["doc_id"] for r in toxicity.labelled_texts(docs, labels, 100).collect()}
    assert len(first) == 100 and first == {r["doc_id"] for r in toxicity.labelled_texts(docs.repartition(3), labels.repartition(7), 100).collect()}


def test_every_language_has_a_landmark(monkeypatch):
    """More languages than landmarks asked for: each is still told."""
    monkeypatch.setattr(langid, "LANDMARKS", 4)
    rng = np.random.default_rng(2)
    base = rng.random((30, 512)) < 0.05
    rows = np.concatenate([base | (rng.random((30, 512)) < 0.002) for _ in range(6)]).astype(np.uint8)
    lang = np.array([f"l{i:02}" for i in range(30)] * 6)
    names, folded, bias = langid.fit(np.packbits(rows, axis=1), lang)
    unit = rows / np.sqrt(rows.sum(axis=1, keepdims=True))
    assert len(names) == 30 and (np.array(names)[(unit @ folded + bias).argmax(axis=1)] == lang).all()


def test_language_fit_unpacks_rows_in_blocks():
    """A fit on as many rows as sample() gives holds a few blocks of them unpacked, and its weights are those of the whole matrix."""
    rng = np.random.default_rng(4)
    packed = np.packbits(rng.random((langid.TRAIN_ROWS, 1 << langid.LOG2), np.float32) < 0.02, axis=1)
    lang = np.array([f"l{i % 7}" for i in range(len(packed))])
    tracemalloc.start()
    names, folded, bias = langid.fit(packed, lang)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    unit = np.unpackbits(packed, axis=1).astype(np.float32)
    unit /= np.sqrt(unit.sum(axis=1, keepdims=True))
    land = unit[: langid.LANDMARKS]  # the languages take turns
    value, vector = np.linalg.eigh((land @ land.T).astype(np.float64))
    whiten = vector / np.sqrt(value)
    z = (unit @ land.T) @ whiten
    y = np.where(lang[:, None] == np.array(names), 1.0, -1.0)
    row = np.array([len(lang) / np.sum(lang == x) / len(names) for x in lang])[:, None]
    mean_z, mean_y = (row * z).sum(0) / row.sum(), (row * y).sum(0) / row.sum()
    alpha = np.linalg.solve((z - mean_z).T @ (row * (z - mean_z)) + langid.RIDGE * len(z) * np.eye(len(land)), (z - mean_z).T @ (row * (y - mean_y)))
    np.testing.assert_allclose(folded, land.T @ (whiten @ alpha), atol=1e-5)
    np.testing.assert_allclose(bias, mean_y - mean_z @ alpha, atol=1e-5)
