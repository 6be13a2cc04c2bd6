"""Weak supervision against brute force, and where it must part from plainer verdicts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxledger.llm import quality, weak


def brute_em(rows, rounds=1000):
    """Expectation-maximisation document by document."""
    m = len(rows[0])
    rates, prior = [[weak.BELIEF[0], weak.BELIEF[1]] for _ in range(m)], weak.BELIEF[2]

    def posterior(v):
        like = [1 - prior, prior]
        for c in (0, 1):
            for j, x in enumerate(v):
                like[c] *= 1 if x == 0 else rates[j][c] if x < 0 else 1 - rates[j][c]
        return like[1] / sum(like)

    good = [posterior(v) for v in rows]
    for _ in range(rounds):
        for j in range(m):
            for c in (0, 1):
                weight = [g if c else 1 - g for g in good]
                bad = sum(w for w, v in zip(weight, rows, strict=True) if v[j] < 0)
                cast = sum(w for w, v in zip(weight, rows, strict=True) if v[j] != 0)
                rates[j][c] = (bad + weak.STRENGTH * weak.BELIEF[c]) / (cast + weak.STRENGTH)
        prior = (sum(good) + weak.STRENGTH * weak.BELIEF[2]) / (len(rows) + weak.STRENGTH)
        before, good = good, [posterior(v) for v in rows]
        if max(abs(x - y) for x, y in zip(before, good, strict=True)) < 1e-9:
            break
    return rates, prior, good


def planted(n, seed, bad_share=0.2):
    """Votes of two sound labellers, one that abstains often, and five that are little better than chance; and the truth."""
    rng = random.Random(seed)
    skill = [(0.92, 0.02, 1.0), (0.9, 0.03, 1.0), (0.95, 0.02, 0.6)] + [(0.35, 0.25, 1.0)] * 5
    truth = [rng.random() >= bad_share for _ in range(n)]
    return [[0 if rng.random() > cast else (-1 if rng.random() < (fp if t else tp) else 1) for tp, fp, cast in skill] for t in truth], truth


def test_fit_equals_document_by_document():
    rows, _ = planted(300, 1)
    votes, counts = np.unique(np.array(rows), axis=0, return_counts=True)
    model = weak.fit_votes(votes, counts.astype(float))
    rates, prior, good = brute_em(rows)
    assert model.rates == pytest.approx(np.array(rates), abs=1e-6) and model.prior == pytest.approx(prior, abs=1e-6)
    assert model.posterior(np.array(rows)) == pytest.approx(np.array(good), abs=1e-6)


def test_posterior_beats_majority_and_all_must_pass(spark):
    rows, truth = planted(4000, 2)
    truth = np.array(truth)
    frame = spark.createDataFrame([(i, *v) for i, v in enumerate(rows)], "id long, " + ", ".join(f"v{j} int" for j in range(8)))
    labelled, model, _ = weak.label(frame.select("id", weak.pattern([F.col(f"v{j}") for j in range(8)]).alias("pattern")), 8)
    got = np.array([r["posterior"] for r in labelled.orderBy("id").collect()])
    votes = np.array(rows)

    def right(kept):
        return (kept == truth).mean()

    assert right(got >= 0.5) > 0.97
    assert right(votes.sum(axis=1) >= 0) < 0.93 and right((votes >= 0).all(axis=1)) < 0.6
    sound = model.accuracies()
    assert sound[:3].min() > 0.85 and sound[3:, 0].max() < 0.5


def test_one_bad_vote_can_lose_and_two_can_win():
    rows, _ = planted(4000, 3)
    votes, counts = np.unique(np.array(rows), axis=0, return_counts=True)
    model = weak.fit_votes(votes, counts.astype(float))
    ones = [1] * 8
    lone, agreed = [*ones[:7], -1], [-1, -1, *ones[2:]]
    assert model.posterior(np.array([lone]))[0] > 0.9 and model.posterior(np.array([agreed]))[0] < 0.1
    empty = weak.fit_votes(np.zeros((0, 3), int), np.zeros(0))
    assert empty.prior == pytest.approx(weak.BELIEF[2]) and empty.posterior(np.array([[0, 0, 0]]))[0] == pytest.approx(weak.BELIEF[2])


def test_votes_of_texts(spark):
    """The rules' votes equal their bounds, worked out one text at a time."""
    texts = ["A plain text of some words that says little. It has two sentences of plain words, and then a third one. " * 2, "### $$$ %%% &&& a b c", "HELLO THERE! YOU! ALL! OF! YOU!", "", None, "to to to to to to to to to to to to", "x\nx\nx\nx y", "one two", "averyveryverylongword " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = list(quality.rules())
    got = {r["doc_id"]: r for r in quality._voted(docs, "t").select("*", *(c.alias(f"vote_{n}") for n, c in quality.rules().items())).collect()}
    for i, r in got.items():
        w = (texts[i] or "").split()
        n, chars, symbols = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in texts[i] or "")
        stops, bangs, kinds = sum(c in ".?!" for c in texts[i] or ""), (texts[i] or "").count("!"), len(set(w))

        def vote(bad, good, some=n >= 5):
            return 0 if not some else -1 if bad else 1 if good else 0

        assert r["vote_symbols"] == vote(symbols > 0.05 * chars, symbols <= 0.01 * chars)
        assert r["vote_marks"] == vote(symbols > 0.2 * n, symbols <= 0.02 * n)
        assert r["vote_exclamations"] == vote(bangs > 0.1 * n, bangs <= 0.01 * n)
        assert r["vote_variety"] == vote(kinds < n**0.75, kinds >= n**0.85)
        assert r["vote_stops"] == (-1 if n < 1 else vote(stops > 0.5 * n or stops < 0.01 * n, 0.02 * n <= stops <= 0.25 * n))
        assert r["vote_word_length"] == vote(chars < 3 * n or chars > 7.5 * n, 3.5 * n <= chars <= 6.5 * n)
        code = 0
        for name in names:
            code = code * 3 + r[f"vote_{name}"] + 1
        assert r["pattern"] == code


def prose(rng, sentences=14):
    vocabulary = ["river", "stone", "walks", "under", "light", "slowly", "people", "garden", "often", "bridge", "winter", "paper", "sings", "of", "and", "the"]
    return " ".join(" ".join(rng.choice(vocabulary) + rng.choice("abcdefghs") for _ in range(8)) + "." for _ in range(sentences))


def test_rules_keep_a_text_with_one_oddity(spark):
    """Clean prose that one rule alone calls bad stays; texts that several rules call bad go; repeated rows are judged alike."""
    rng = random.Random(8)
    clean = [(i, prose(rng)) for i in range(300)]
    odd = [(400 + i, prose(rng).replace(".", " ")) for i in range(3)]  # no sentence ends
    junk = [(500 + i, " ".join(rng.choice(["aa", "bb", "cc"]) + "###" for _ in range(90))) for i in range(40)]
    shout = [(600 + i, prose(rng).upper().replace(" ", "! ")) for i in range(40)]
    docs = spark.createDataFrame([*clean, *odd, *junk, *junk[:5], *shout], "doc_id long, text string")
    rows = quality.quality_rules(docs).collect()
    got = {r["doc_id"]: r["kept"] for r in rows}
    assert len(rows) == docs.count()
    fired = quality._voted(docs, "t").where("doc_id >= 400 and doc_id < 500").select("doc_id", *(c.alias(n) for n, c in quality.rules().items())).collect()
    assert all(sum(v == -1 for v in r[1:]) == 1 for r in fired)
    assert all(got[i] for i, _ in clean) and all(got[i] for i, _ in odd)
    assert not any(got[i] for i, _ in junk + shout)


def test_scorer_sample_is_exact_and_fixed(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_ROWS", 40)
    rng = random.Random(4)
    rows = [(i, prose(rng) if i % 5 else " ".join("zz##" for _ in range(60))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = quality.quality_model(docs), quality.quality_model(docs.repartition(7))
    assert (a[0] == b[0]).all() and a[1] == b[1]
    scores = {r["doc_id"]: r["score"] for r in quality.classify_quality(docs).collect()}
    assert min(scores[i] for i, _ in rows if i % 5) > max(scores[i] for i, _ in rows if not i % 5)
    assert all(math.isfinite(s) and 0 <= s <= 1 for s in scores.values())


def brute_logistic(rows, y, weight, epochs, rate, l2, seed=0):
    """Adagrad row by row in plain numbers: soft labels, rows divided by the root of their features."""
    d = len(rows[0])
    w, b, gw, gb = [0.0] * d, 0.0, [1e-6] * d, 1e-6
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // 128)):
            dw, db = [l2 * v for v in w], 0.0
            for i in at.tolist():
                x = [v / math.sqrt(max(1, sum(rows[i]))) for v in rows[i]]
                g = (1 / (1 + math.exp(-sum(p * q for p, q in zip(x, w, strict=True)) - b)) - y[i]) * weight[i] / len(at)
                dw = [v + g * q for v, q in zip(dw, x, strict=True)]
                db += g
            gw, gb = [v + q * q for v, q in zip(gw, dw, strict=True)], gb + db * db
            w = [v - rate * q / math.sqrt(z) for v, q, z in zip(w, dw, gw, strict=True)]
            b -= rate * db / math.sqrt(gb)
    return w, b


def test_scorer_equals_plain_numbers(spark, monkeypatch):
    """The fit on soft labels, and every score from the n-grams of one text at a time."""
    from ctxledger.llm import presence as P

    rng = np.random.default_rng(3)
    rows = (rng.random((300, 16)) < 0.3).astype(np.uint8)
    y, weight = rng.random(300), rng.choice([1.0, 3.0], 300)
    w, b = P.fit_logistic(np.packbits(rows, axis=1), y, weight, epochs=4)
    expect, bias = brute_logistic(rows.tolist(), y.tolist(), weight.tolist(), 4, 0.3, 1e-5)
    assert np.allclose(w, expect, atol=1e-4) and abs(b - bias) < 1e-4

    texts = ["plain words here. " * 9, "", None, "é漢", "AbC", "x" * 3000]
    model = (rng.normal(size=1 << quality.LOG2).astype(np.float32), 0.25)
    monkeypatch.setattr(quality, "quality_model", lambda docs: model)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.classify_quality(docs).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        bins = set()
        for n in quality.ORDERS:
            for i in range(len(raw) - n + 1):
                key = int.from_bytes(raw[i : i + n], "little")
                bins.add(((key ^ key >> 29) * P._MULT[n] % 2**64) >> (64 - quality.LOG2))
        z = float(sum(float(model[0][i]) for i in bins)) / math.sqrt(max(1, len(bins))) + model[1]
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-5 and r["kept"] == (r["score"] >= 0.5)


def test_scores_at_the_threshold_and_ids_with_two_texts(spark, monkeypatch):
    """A tie stays; of two texts under one id the same one is learnt from however rows lie; null ids are scored."""
    monkeypatch.setattr(quality, "quality_model", lambda docs: (np.zeros(1 << quality.LOG2, np.float32), 0.0))
    got = quality.classify_quality(spark.createDataFrame([(1, "a"), (None, "b"), (None, None)], "doc_id long, text string")).collect()
    assert len(got) == 3 and all(r["score"] == 0.5 and r["kept"] for r in got)
    monkeypatch.undo()
    rng = random.Random(5)
    rows = [(i % 150, prose(rng) if i % 5 else " ".join("zz##" for _ in range(60))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = quality.quality_model(docs.repartition(1)), quality.quality_model(docs.orderBy(F.desc("text")).repartition(6))
    assert (a[0] == b[0]).all() and a[1] == b[1]


def test_other_measures_and_verdicts(spark):
    """The four rules of letters and repeats, and the verdict from the posterior of each pattern, tie included."""
    texts = ["Plain text of words with letters, mostly small. " * 3, "12 34 56 78 90 1a", "SHOUTING WORDS ONLY HERE NOW", "same line\nsame line\nsame line\nother", "go go go go go go go", "a1 b2 c3 d4 e5 f6", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rules = quality.rules()
    voted = quality._voted(docs, "t")
    got = {r["doc_id"]: r for r in voted.select("*", *(c.alias(f"vote_{n}") for n, c in rules.items())).collect()}
    for i, r in got.items():
        t = texts[i] or ""
        letters = sum(c.isalpha() for c in t)
        assert all(r[f"vote_{n}"] in (-1, 0, 1) for n in rules)
        if len(t.split()) >= 5 and letters == 0:
            assert r["vote_letters"] == -1
    assert got[2]["vote_capitals"] == -1 and got[0]["vote_capitals"] == 1 and got[0]["vote_letters"] == 1 and got[4]["vote_repeats"] == -1 and got[3]["vote_lines"] == -1
    rows = quality.quality_rules(docs).collect()
    assert all(r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5) for r in rows)
