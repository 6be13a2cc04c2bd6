"""The corpus operators against brute force, and their edge cases."""

import base64
import collections
import gzip  # noqa: F401  (archives are gzip members)
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ctxledger.llm import _text as T
from ctxledger.llm import decontaminate, langid, lm, neardup, packing, quality, stats, toxicity, warc
from ctxledger.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(x):
    return WORD.findall((x or "").translate(LOW))


def shingles(x, k):
    w = words(x)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def odd_docs(spark, extra=()):
    """Nulls, empties, a very long text, ties, repeated rows, and columns whose names clash with internal ones."""
    rng = random.Random(4)
    prose = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) + str(rng.randint(0, 9)) for _ in range(60)) for _ in range(6)]
    rows = [(1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \n\t ", "en", None, 3), (4, "short", "en", "a", 5), (5, prose[0], "en", "a", None), (6, prose[0], "de", "a", 1), (6, prose[0], "de", "a", 1), (None, prose[1], "en", "a", 1)]
    rows += [(7, prose[2] + " tail", "de", "b", 1), (8, prose[2], "de", "b", 1), (9, (prose[3] + " ") * 900, "en", "b", 1), (10, "漢字 é 😀 x", "zh", "b", 1), (11, "1234 5678", "en", "b", 1)]
    rows += list(extra)
    return spark.createDataFrame(rows, DOCS).withColumns({"node": F.lit(1), "score": F.lit("x"), "key": F.lit(2), "n": F.lit(3), "row": F.lit(4), "label": F.lit(5), "component": F.lit(6)})


def brute_components(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(rows))], [len(s) for s in sets]


def near_corpus():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 40, 120]))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, k, percent, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 3)  # so that blocks are used too
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rows = near_corpus()
    expect, sizes = brute_components(rows, k, percent)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()}
    assert [got[d]["component_id"] for d, _ in rows] == expect
    assert [got[d]["n_shingles"] for d, _ in rows] == sizes
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in got.values())


def test_near_duplicates_edge_cases(spark):
    docs = odd_docs(spark)
    got = [tuple(r)[:4] for r in neardup.near_duplicates(docs).collect()]
    assert len(got) == docs.count()
    by = {r[0]: r for r in got}
    assert by[1] == (1, 0, 1, True) and by[2] == (2, 0, 2, True) and by[3] == (3, 0, 3, True)
    assert by[6][2] == 5 and not by[6][3] and by[8][2] == 7
    assert sum(r[0] == 6 for r in got) == 2
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_null_ids_bridge_and_repeated_rows(spark):
    """A text found only under a null id links its neighbours; exact and near copies of it too; ties and clashing columns change nothing."""
    base = [f"w{i}" for i in range(120)]

    def changed(*at):
        return " ".join("x%d" % i if i in at else w for i, w in enumerate(base))

    rows = [(1, changed(0)), (None, changed()), (None, changed()), (3, changed(119, 118, 117)), (3, changed(119, 118, 117)), (7, "other words here altogether now"), (None, "alone " * 9), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "size": F.lit(2), "minor": F.lit(3), "most": F.lit(4)})
    expect, _ = brute_components(rows, 3, 92)
    got = neardup.near_duplicates(docs, 3, 92).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == sorted((str(d), str(c)) for (d, _), c in zip(rows, expect, strict=True))
    assert expect[3] == 1 and sum(r["kept"] for r in got) == 4


def test_a_large_bucket_of_near_copies(spark, monkeypatch):
    """A group of texts at the threshold: chains of links, most of them not to a hub."""
    monkeypatch.setattr(neardup, "SMALL", 4)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(3)
    word, rows = [f"v{i}" for i in range(60)], []
    for i in range(150):
        word = list(word)
        word[rng.randrange(60)] = f"n{i}"
        rows.append((1000 - i, " ".join(word)))
    rng.shuffle(rows)
    expect, _ = brute_components(rows, 3, 85)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert [got[d] for d, _ in rows] == expect


def test_sketch_fills_every_coordinate_and_estimates():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
    b = np.concatenate([a[: int(len(a) * 0.9)], np.unique(rng.integers(0, 2**63, 20, dtype=np.uint64))])
    b.sort()
    one = a[:1]
    sk = neardup.sketch(np.concatenate([a, b, one]), np.array([0, len(a), len(a) + len(b), len(a) + len(b) + 1]), 200)
    assert (sk != neardup._EMPTY).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((sk[0] == sk[1]).mean() - true) < 0.1


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100), (200, 201), (None, 5)] + [(500, 500 + i) for i in range(1, 300)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {200: 200, 201: 200} | {500 + i: 500 for i in range(300)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_stats(x):
    x = x or ""
    w = WORD.findall(x)
    lines = [line for line in x.split("\n") if WORD.search(line)]
    seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered)


def test_stats_equal_brute_force(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é\n\t#.A!1😀\x0b ") for _ in range(rng.randint(0, 200))) for _ in range(200)] + [None, "", "\n", "x\nx\n\nx", "a b c a b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in stats.text_stats(docs).collect()}
    assert all(got[i] == brute_stats(t) for i, t in enumerate(texts))


def test_segments_do_not_change_results(monkeypatch):
    texts = pa.array(["alpha beta " * 50, "x" * 300, "", "é" * 99 + " b", "\n\n a"])
    raw, off = T.buffers(texts)
    whole = T.words(raw, off)
    whole_stats = stats.measure(raw, off)
    monkeypatch.setattr(T, "SEGMENT", 64)
    T.segments.__defaults__ = (64,)
    try:
        cut, cut_stats = T.words(raw, off), stats.measure(raw, off)
    finally:
        T.segments.__defaults__ = (1 << 20,)
    assert (whole.hash == cut.hash).all() and (whole.first == cut.first).all()
    assert all((whole_stats[c] == cut_stats[c]).all() for c in stats.COUNTS)


def junk(rng):
    return "###".join(rng.choice("abcdef") * 3 for _ in range(80)).replace("#a", "$$ a").replace("#b", " && b")


def test_quality(spark):
    rng = random.Random(3)
    vocabulary = ["river", "stone", "walks", "under", "light", "slowly", "people", "garden", "often", "bridge", "winter", "paper"]
    good = [(100 + i, ". ".join(" ".join(rng.choice(vocabulary) + rng.choice("abcdefgh") for _ in range(9)) for _ in range(9)) + ".", "en", "s", 1) for i in range(60)]
    bad = [(300 + i, junk(rng), "en", "s", 1) for i in range(20)]
    docs = odd_docs(spark, good + bad)
    ruled = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    assert all(ruled[d[0]]["kept"] for d in good) and not any(ruled[d[0]]["kept"] for d in bad)
    assert ruled[1]["base_failed"] and ruled[9]["base_failed"] and ruled[9]["n_words"] == 60 * 900
    scored = quality.classify_quality(docs).collect()
    kept = {r["doc_id"]: r["kept"] for r in scored}
    assert len(scored) == docs.count()
    assert sum(kept[d[0]] for d in good) >= 58 and sum(kept[d[0]] for d in bad) <= 1
    assert quality.keep_good(docs).columns == docs.columns
    for empty in (quality.quality_rules(docs.limit(0)), quality.classify_quality(docs.limit(0)), quality.keep_good(docs.limit(0))):
        assert empty.count() == 0


def test_language(spark):
    rng = random.Random(5)
    make = {"aa": ["tam", "tim", "tom", "tum"], "bb": ["lok", "lek", "lik", "luk"], "cc": ["öß", "äß", "üß", "éß"]}
    rows = [(1000 + i, " ".join(rng.choice(make[c]) + rng.choice(make[c]) for _ in range(rng.randint(3, 60))), c, "s", 1) for i, c in enumerate(list(make) * 60)]
    docs = odd_docs(spark, rows)
    train = spark.createDataFrame(rows[:90], DOCS)
    got = {r["doc_id"]: r for r in langid.identify(docs, train).collect()}
    assert all(got[d]["lang_pred"] == c for d, _, c, _, _ in rows[90:])
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 11))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.keep_known(docs, train).count() == docs.count() - 4
    assert {r["lang_pred"] for r in langid.identify(docs, docs.limit(0)).collect()} == {"und"}
    assert langid.identify(docs.limit(0), train).count() == 0


def test_pipeline_rejects_unlearnt_languages(spark):
    import corpus_pipeline as C

    rng = random.Random(5)
    make = {"aa": ["tam", "tim", "tom", "tum"], "bb": ["lok", "lek", "lik", "luk"], "cc": ["öß", "äß", "üß", "éß"]}
    rows = [(i, " ".join(rng.choice(make[c]) + rng.choice(make[c]) for _ in range(rng.randint(20, 60))), c, "s", 1) for i, c in enumerate(list(make) * 100)]
    odd = [(1000 + i, " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(40)), None, "s", 1) for i, letters in enumerate(["αβγδεζηθικλμν", "абвгдежзийклмн", "qxzjwvyqxzjwvy"] * 5)]
    kept = {r["doc_id"] for r in C.language(spark, spark.createDataFrame(rows + odd, DOCS), "").collect()}
    assert not kept & {r[0] for r in odd} and len(kept) >= 298


def test_folded_kernel_equals_landmark_products():
    rng = np.random.default_rng(0)
    bits = (rng.random((60, 1 << 8)) < 0.2).astype(np.uint8)
    lang = np.array(["a", "b"])[np.arange(60) % 2]
    bits[lang == "a", :40] = 1
    names, folded, bias = langid.fit(np.packbits(bits, axis=1), lang)
    x = bits.astype(float)
    z = x @ folded / np.sqrt(x.sum(axis=1, keepdims=True)) + bias
    assert [names[i] for i in z.argmax(axis=1)] == lang.tolist()


def brute_ppm(train, tests, order=lm.ORDER):
    """Method D with exclusion, by walking from the longest seen context down."""
    counts = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]

    def pairs(x):
        b = [255] * order + list(x.encode()) + [255]
        return [(b[i - order : i], b[i]) for i in range(order, len(b))]

    for x in train:
        for context, s in pairs(x):
            for k in range(order + 1):
                counts[k][tuple(context[order - k :])][s] += 1
    out = []
    for x in tests:
        total = 0.0
        for context, s in pairs(x):
            seen, p, k = set(), 1.0, order
            while k > 0 and tuple(context[order - k :]) not in counts[k]:
                k -= 1
            while True:
                if k < 0:
                    p /= 256 - len(seen)
                    break
                c = {a: n for a, n in counts[k].get(tuple(context[order - k :]), {}).items() if a not in seen}
                t, d = sum(c.values()), len(c)
                if s in c:
                    p *= (c[s] - 0.5) / t
                    break
                if d:
                    p *= d / (2 * t)
                seen |= set(c)
                k -= 1
            total += math.log10(p)
        out.append(total)
    return out


def test_language_model_equals_brute_force(spark):
    docs = odd_docs(spark)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    got = lm.score_texts(docs, docs).collect()
    assert len(got) == len(rows)
    counts = collections.Counter(w for _, t in rows for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    expect = sorted((len(words(t)) + 1, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 6), round(s, 4)) for (_, t), s in zip(rows, brute_ppm([t for _, t in rows], [t for _, t in rows]), strict=True))
    found = sorted((r["n_tokens"], round(r["base_score"], 6), round(r["score"], 4)) for r in got)
    assert np.array(found) == pytest.approx(np.array(expect), abs=2e-4)
    assert all(r["n_known"] == r["n_tokens"] and r["train_tokens"] == n for r in got)
    none = lm.score_texts(docs, docs.limit(0)).collect()
    assert all(r["base_score"] == 0 and r["n_known"] == 0 for r in none)
    assert lm.score_texts(docs.limit(0), docs).count() == 0


def test_rare_tokens_are_joined(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 3)
    docs = spark.createDataFrame([(i, f"a b c w{i} w{i % 5} zz") for i in range(40)], "doc_id long, text string")
    train = docs.where("doc_id < 20")
    got = {r["doc_id"]: r for r in lm.score_texts(docs, train).collect()}
    counts = collections.Counter(w for i in range(20) for w in [*f"a b c w{i} w{i % 5} zz".split(), None])
    for i in range(40):
        tokens = [*f"a b c w{i} w{i % 5} zz".split(), None]
        assert got[i]["n_known"] == sum(counts[w] > 0 for w in tokens)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (sum(counts.values()) + len(counts) + 1)) for w in tokens))


@pytest.mark.parametrize("cells", [0, 60, 400, 1_000_000])
def test_rare_contexts_are_joined(spark, monkeypatch, cells):
    monkeypatch.setattr(lm, "CELLS", cells)
    monkeypatch.setattr(T, "SEGMENT", 700)  # so that windows come in parts
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefé漢 ") for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["xyz", "", "aaaa" * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(docs, docs.where("doc_id < 20")).collect()}
    expect = brute_ppm(texts[:20], texts)
    assert len(got) == len(texts) and [got[i] for i in range(len(texts))] == pytest.approx(expect, abs=1e-3)


def test_toxicity(spark):
    rng = random.Random(6)
    plain = ["the", "house", "was", "near", "water", "and", "people", "came", "there", "often"]
    rude = ["idiot", "moron"]
    rows = []
    for i in range(400):
        w = [rng.choice(plain) + rng.choice(["", "s", "ing"]) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(rude)
        rows.append((i, " ".join(w), "en", "s", int(i % 4 == 0)))
    labelled = spark.createDataFrame(rows[:200], DOCS).withColumnRenamed("n_chars", "label")
    docs = odd_docs(spark, [(1000 + i, t, la, s, y) for i, t, la, s, y in rows[200:]])
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labelled).collect()}
    right = sum(got[1000 + i]["predicted"] == y for i, _, _, _, y in rows[200:])
    assert right >= 195 and got[1]["predicted"] == 0 and got[5]["predicted"] == 0
    assert toxicity.score_toxicity(docs.limit(0), labelled).count() == 0
    assert {r["predicted"] for r in toxicity.score_toxicity(docs, labelled.limit(0)).collect()} == {0}


def test_toxicity_with_copies_of_one_text(spark):
    rng = random.Random(9)
    plain = ["the", "house", "was", "near", "water", "and", "people", "came", "there", "often"]

    def text(rude):
        w = [rng.choice(plain) + rng.choice(["", "s", "ing"]) for _ in range(60)]
        for _ in range(3 * rude):
            w[rng.randrange(60)] = "idiot"
        return " ".join(w)

    novel = "".join(rng.choice("qxzjkvw0123456789") for _ in range(6000))
    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(200)] + [(500 + i, novel, 1) for i in range(60)]
    tests = [(1000 + i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(80)] + [(2000, novel, 1)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(spark.createDataFrame(tests, labelled.schema), labelled).collect()}
    assert sum(got[i] == y for i, _, y in tests) >= 79
    assert len(toxicity.train(labelled)[0]) == toxicity.FEATURES


def test_packing_is_an_exact_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    texts = [None, "", " ", "a  b", " lead", "trail ", "it's 's", "x 　 y z", "<|endoftext|> a", "日本 語", "l\n\n m", "word " * 3000, "é à ü " * 400] + [f"text {i} " * (i % 37) for i in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("tokens", F.lit(1)).repartition(3)
    rows = packing.pack(docs).collect()
    parts, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        parts[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted(parts[i], key=lambda r: r["start"])
        assert b"".join(bytes(r["tokens"]) for r in mine) == np.array(ids, "<u4").tobytes()
        assert [r["start"] for r in mine] == np.cumsum([0, *(r["length"] for r in mine)])[:-1].tolist()
        assert all(r["doc_tokens"] == len(ids) for r in mine)
    for s in sequences.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == np.cumsum([0, *(r["length"] for r in s)])[:-1].tolist()
        total = sum(r["length"] for r in s)
        assert total <= 1024 and total & (total - 1) == 0  # full or a power of two: no padding
    assert packing.pack(docs.limit(0)).count() == 0


def packed(packer, sizes):
    """Sequences' closings, after checking that each id lies in one piece and each sequence is full or a power of two."""
    for i, n in enumerate(sizes):
        packer.add(i, np.arange(n, dtype=np.uint32))
        assert packer.held == packer.count[1 : packer.full].sum() == sum(map(len, packer.open)) <= packer.most_open
    packer.close()
    fills, closed, parts = collections.Counter(), {}, collections.defaultdict(list)
    for doc, start, length, ids, n, sequence, offset, how in packer.rows:
        assert offset == fills[sequence] and n == sizes[doc] and np.frombuffer(ids, np.uint32).tolist() == list(range(start, start + length))
        fills[sequence] += length
        closed[sequence] = how
        parts[doc].append((start, length))
    assert all(fills[s] == packer.window for s, how in closed.items() if how != "end") and all(f & (f - 1) == 0 for f in fills.values())
    for doc, n in enumerate(sizes):
        found = sorted(parts[doc])
        assert [a for a, _ in found] == np.cumsum([0, *(n for _, n in found)])[:-1].tolist() and sum(n for _, n in found) == n
    return [how for how in closed.values() if how != "document"]


@pytest.mark.parametrize("longest", [20, 40, 700, 1023, 3000])
def test_placement_fills_the_sequences(longest):
    """The rule itself closes over nine in ten, nothing is cut, and few windows stay open, whatever the lengths."""
    rng = random.Random(3)
    mixed = packed(packing.SumOfSquares(1024, 0), [rng.randint(1, longest) for _ in range(6000)])
    assert "cut" not in mixed and mixed.count("placed") >= min(0.9 * len(mixed), len(mixed) - 60)


def test_placement_with_windows_bounded():
    """Lengths that never fill a window meet the bound: items are cut, and labelled so."""
    rng = random.Random(4)
    mixed = packed(packing.SumOfSquares(1024, 0, most_open=7), [rng.choice([544, 576, 640, 1664]) for _ in range(400)])
    assert mixed.count("cut") > 50 and mixed.count("end") <= 9
    mixed = packed(packing.SumOfSquares(1024, 0, most_open=1), [rng.randint(1, 2000) for _ in range(400)])
    assert mixed.count("end") <= 12


@pytest.mark.parametrize("most_open", [10**6, 5, 1])
def test_sum_of_squares_choice(most_open):
    """Each item goes where the sum of squares grows least, or with all windows open and no room for it is cut into the fullest of the commonest levels."""
    rng = random.Random(7)
    packer, levels = packing.SumOfSquares(12, 0, most_open, grain=1), collections.Counter()
    for _ in range(300):
        size = rng.randint(1, 11)
        packer.place([(1, 0, np.zeros(size, np.uint32), size)], size)
        while True:
            options = [h for h in range(12 - size + 1) if (levels[h] if h else sum(levels.values()) < most_open)]
            if options:
                break
            fill = max((h for h in levels if levels[h]), key=lambda h: (levels[h], h))
            levels[fill] -= 1
            size -= 12 - fill

        def after(h, size=size):
            c = levels.copy()
            c[h] -= h > 0
            if h + size < 12:
                c[h + size] += 1
            return +c

        least = min(sum(n * n for n in after(h).values()) for h in options)
        levels = +after(max(h for h in options if sum(n * n for n in after(h).values()) == least))
        assert levels == collections.Counter({h: int(n) for h, n in enumerate(packer.count) if n})


def test_packing_odd_rows(spark):
    """Null ids, repeated rows, nulls and empties, clashing columns: every row is packed, each with its own pieces."""
    rows = [(None, "some words here"), (None, None), (3, ""), (3, ""), (4, "again " * 700), (4, "again " * 700), (None, "some words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(1) for n in ("start", "length", "tokens", "closed", "offset")}).coalesce(1)
    got = packing.pack(docs).collect()
    assert sorted(r["start"] for r in got if r["doc_id"] is None) == [0, 0, 0] and sum(r["length"] for r in got if r["doc_id"] == 3) == 2
    long = [r for r in got if r["doc_id"] == 4]
    assert sum(r["length"] for r in long) == 2 * long[0]["doc_tokens"] and collections.Counter(r["start"] for r in long)[0] == 2
    for s in {r["sequence_id"] for r in got}:
        mine = sorted((r["offset"], r["length"]) for r in got if r["sequence_id"] == s)
        total = sum(n for _, n in mine)
        assert [o for o, _ in mine] == np.cumsum([0, *(n for _, n in mine)])[:-1].tolist() and total & (total - 1) == 0


def test_decontamination(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 12, 30, 70])))) for i in range(25)] + [(90, None), (91, ""), (92, "  ")]
    rows = []
    for i in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 4, 50, 900]))]
        if i % 3 == 0:
            for _ in range(rng.randint(1, 12)):
                item = words(rng.choice(items[:25])[1])
                cut = item[: max(1, int(len(item) * rng.choice([0.5, 0.85, 1])))]
                at = rng.randint(0, len(w))
                w[at:at] = cut
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"members": F.lit(1), "domain": F.lit(2)})
    table = spark.createDataFrame(items, "item_id long, text string")

    def found(t, item):
        n = len(words(item))
        if not n:
            return False
        k = min(5, n)
        mine = {tuple(words(item)[i : i + k]) for i in range(n - k + 1)}
        w = words(t)
        return 100 * len(mine & {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) >= 80 * len(mine)

    expect = {(d, i) for d, t in rows for i, item in items if found(t, item)}
    for size in (decontaminate.BROADCAST, 0):
        got = decontaminate.find_items(docs, table, broadcast=size).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == expect and len(got) == len(expect)
    clean = decontaminate.decontaminate(docs, table)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in expect} and clean.columns == docs.columns
    assert decontaminate.find_items(docs, table.limit(0)).count() == 0 and decontaminate.find_items(docs.limit(0), table).count() == 0
    odd = odd_docs(spark)
    for size in (decontaminate.BROADCAST, 0):  # repeated rows, null ids, a very long item, extra columns
        long = " ".join(f"z{i}" for i in range(40_000))
        some = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, f"q {long} q"), (3, None)], "doc_id long, text string").withColumns({"s": F.lit(1), "item": F.lit(2)})
        tests = spark.createDataFrame([(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "B C d e f"), (6, long), (7, "h i j k l")], "item_id long, text string").withColumns({"n": F.lit(1), "class": F.lit(2)})
        got = sorted((str(r["doc_id"]), str(r["item_id"]), r["n_item"], r["n_common"]) for r in decontaminate.find_items(some, tests, broadcast=size).collect())
        assert got == [("1", "5", 3, 3), ("1", "None", 1, 1), ("2", "6", 39_996, 39_996), ("None", "5", 3, 3), ("None", "None", 1, 1)]
        left = decontaminate.decontaminate(some, tests, broadcast=size)
        assert [r["doc_id"] for r in left.collect()] == [3] and left.columns == some.columns
    assert decontaminate.find_items(odd, spark.createDataFrame([(1, "short")], "item_id long, text string")).select("doc_id").collect()[0][0] == 4


def test_common_shingles_are_looked_up_by_the_rarest(spark, monkeypatch):
    """Items and documents that all share a passage: every match is found, with bands switched off."""
    monkeypatch.setattr(decontaminate, "plan", lambda *a: 0)
    rng = random.Random(2)
    shared = " ".join(f"s{i}" for i in range(20))
    items = [(i, shared + " " + " ".join(f"i{i}-{j}" for j in range(rng.randint(0, 9)))) for i in range(30)]
    docs = [(i, " ".join(words(items[i % 30][1])[: rng.randint(10, 29)]) + " tail " * rng.randint(0, 3)) for i in range(90)]

    def grams(t):
        return shingles(t, 5)

    expect = {(d, i) for d, t in docs for i, x in items if 100 * len(grams(t) & grams(x)) >= 80 * len(grams(x))}
    got = decontaminate.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == expect and expect


def test_containment_plan_misses_little():
    for n in (5, 36, 400):
        for upper in (1, 7, 63, 1023, 65535):
            width = decontaminate.plan(n, upper, 0.8)
            if width:
                s = min(1.0, 0.8 * n / (upper + 0.2 * n))
                assert (1 - s**width) ** (decontaminate.COORDINATES // width) <= 1.001e-5


@pytest.mark.parametrize("fan_in, rows", [(64, 1_000_000), (2, 4), (3, 1)])
def test_warc_round_trip(spark, monkeypatch, fan_in, rows):
    monkeypatch.setattr(warc, "ARCHIVE", 2000)  # several archives
    monkeypatch.setattr(warc, "FAN_IN", fan_in)  # several passes
    monkeypatch.setattr(warc, "GROUP", max(2, min(rows, 2000)))
    monkeypatch.setattr(warc, "RANGE", rows)
    rng = random.Random(1)
    bodies = ["<p>%d</p>" % rng.randint(0, 9) * 30 for _ in range(40)] + [None, "", "é" * 50]
    rows = [(i, f"http://{'abc'[i % 3]}.example.com/{i % 7}", b) for i, b in enumerate(bodies)] + [(None, None, bodies[0]), (3, "bad\r\nurl", bodies[3]), (3, "http://a.example.com", bodies[3])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha": F.lit(1), "archive": F.lit(2), "first": F.lit(3), "date": F.lit(4)})
    got = warc.archive_pages(pages).collect()
    assert len(got) == len(rows) and all(r["verified"] for r in got)
    first = {}
    for i, _, b in rows:
        if i is not None:
            first[b or ""] = min(i, first.get(b or "", i))
    expect = sorted((str(i), len((b or "").encode()), base64.b32encode(hashlib.sha1((b or "").encode()).digest()).decode(), first[b or ""] if i != first[b or ""] else -1) for i, _, b in rows)
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], -1 if r["refers_to"] is None else r["refers_to"]) for r in got) == expect
    assert all((r["record_type"] == "revisit") == (r["refers_to"] is not None) for r in got)
    order = [warc._order(tuple(r)) for r in got]
    assert order == sorted(order) and len({r["archive"] for r in got}) > 3
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_of_a_very_long_payload_ties_and_dates(spark):
    long = "<p>é</p>" * 400_000
    rows = [(1, "http://a.b/x", long, "2020-01-01T00:00:00Z"), (2, "http://a.b/x", long, "2020-01-01T00:00:00Z"), (2, "http://a.b/x", long, None), (3, "http://a.b/x", "", "2019-01-01T00:00:00Z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, taken string")
    got = warc.archive_pages(pages, date="taken").collect()
    assert [r["page_id"] for r in got] == [2, 3, 1, 2] and {r["payload_bytes"] for r in got if r["page_id"] != 3} == {len(long.encode())}
    assert [r["captured_at"] for r in got] == ["1970-01-01T00:00:02Z", "2019-01-01T00:00:00Z", "2020-01-01T00:00:00Z", "2020-01-01T00:00:00Z"]
    assert [r["record_type"] for r in got] == ["revisit", "response", "response", "revisit"] and all(r["verified"] for r in got)
    folder = warc.shared_dir(spark, "warc")
    manifest = warc.write_captures(pages.withColumnRenamed("taken", "date"), folder)
    assert sorted(r["page_id"] for r in warc.read_captures(spark, folder, manifest).collect()) == [1, 2, 2, 3]


@pytest.mark.parametrize("k", range(9))
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted(rng.choices(range(40), k=rng.randint(0, 25))) for _ in range(k)]
    assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_held_out_is_crc32(spark):
    ids = spark.range(50).withColumnRenamed("id", "doc_id")
    got = {r["doc_id"]: r["h"] for r in ids.select("doc_id", langid.held_out(4, 2).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as C

    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in C.STAGES:
        out = stage(spark, docs, small)
        path = str(tmp_path / name.replace(" ", "-"))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    before = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "decontamination")).collect()}
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == before
    assert counts[1] > counts[2] > counts[3] >= counts[4]


def test_most_frequent_is_bounded(spark):
    from ctxledger.llm._work import most_frequent

    counts = spark.createDataFrame([(i, n) for i, n in enumerate([1] * 50 + [2] * 20 + [9, 9, 100])], "key long, n long")
    assert sorted(r["n"] for r in most_frequent(counts, 3).collect()) == [9, 9, 100]
    assert most_frequent(counts, 30).count() == 23 and most_frequent(counts, 73).count() == 73
    assert most_frequent(counts, 2).count() == 1 and most_frequent(counts.limit(0), 5).count() == 0


def test_first_rows_are_exact(spark):
    from ctxledger.llm._work import first_rows

    rows = spark.createDataFrame([(i, float(n)) for i, n in enumerate([1] * 50 + [2] * 20 + [9, 9, 100])], "key long, n double")
    for most in (0, 1, 2, 3, 10, 23, 60, 73, 90):
        got = sorted((r["n"] for r in first_rows(rows, most, "n", "key").collect()), reverse=True)
        assert got == [100.0, 9.0, 9.0, *[2.0] * 20, *[1.0] * 50][:most]


def test_labels_are_bounded_and_unique(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(400)] + [(None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(0, 1), (1, None), (None, 1), (999, 1)], "doc_id long, label int")
    got = {r["doc_id"]: (r["text"], r["label"]) for r in toxicity.labelled_texts(docs, labels).collect()}
    assert len(got) == 300 and got[0] == ("t0", 1) and got[1] == ("t1", 1)
    assert toxicity.labelled_texts(docs, labels, 100).count() <= 100
