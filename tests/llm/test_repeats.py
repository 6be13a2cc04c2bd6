"""Induced sorting, common prefixes and repeated passages against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxledger.llm import repeats, suffixes


@pytest.mark.parametrize("scan", [0, 200, 10**9])
def test_suffix_arrays_and_common_prefixes(scan, monkeypatch):
    """Suffix by suffix and bucket by bucket, small alphabets and periods included."""
    monkeypatch.setattr(suffixes, "SCAN", scan)
    rng = random.Random(scan)
    for n in [*range(24), 60, 150]:
        for letters in (1, 2, 3, 5, 200):
            t = np.array([rng.randrange(letters) for _ in range(n)], np.uint8)
            if n > 6 and rng.random() < 0.4:
                t = np.tile(t[: n // 3], 3)
            b = t.tolist()
            sa = suffixes.suffix_array(t)
            assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
            common = suffixes.permuted_prefixes(t, sa)
            for i, j in zip(sa[1:].tolist(), sa[:-1].tolist(), strict=True):
                same = 0
                while max(i, j) + same < len(b) and b[i + same] == b[j + same]:
                    same += 1
                assert common[i] == same


def plain(rows, width):
    """(doc_id, n_bytes, spans, kept) by counting every string of ``width`` bytes."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    n = collections.Counter(t[i : i + width] for _, t in texts for i in range(len(t) - width + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - width + 1):
            if n[t[i : i + width]] > 1:
                gone[i + 1 : i + width + 1] = True
        edge = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
        out.append((str(d), len(t), list(zip(edge[::2], edge[1::2], strict=True)), bytes(c for c, g in zip(t, gone[1:], strict=False) if not g)))
    return sorted(out)


def corpus(seed, width):
    """Copies with edits, a passage in most texts, text of short periods, texts at the width."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "c", "é", "the", "of", "漢", "zz", "q"])
    make = lambda n: " ".join(word() + str(rng.randrange(30)) for _ in range(n))
    passage = make(width // 3)
    rows = []
    for _ in range(8):
        base = make(rng.randint(5, width + 6)).split(" ")
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += [make(rng.randint(0, 40)) + passage[rng.randint(0, 4) :] + make(rng.randint(0, 20)) for _ in range(60)]
    rows += ["a" * (3 * width), "ab" * width, "xyz" * (width // 3), "q" * width, "w" * (width - 1), "w" * (width - 1), "0123456789" * width, None, "", "short"]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def found(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in df.collect())


@pytest.mark.parametrize("width,group,shard,step", [(24, 2000, 1 << 21, 1 << 20), (24, 2, 300, 50), (9, 1, 1, 7), (3, 3, 100, 1 << 20)])
def test_removed_bytes_equal_brute_force(spark, width, group, shard, step, monkeypatch):
    """With marks dealt to several shards, shards of one mark, and long texts cut anywhere."""
    for name, v in (("GROUP", group), ("SHARD", shard), ("STEP", step), ("SEEN", 20)):
        monkeypatch.setattr(repeats, name, v)
    rows = corpus(width + group, width)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(repeats.without_repeats(docs, width)) == plain(rows, width)


def test_odd_tables(spark):
    rows = [(1, "x" * 300), (None, "one " * 90), (None, None), (2, ""), (3, "é" * 120 + "tail"), (3, "é" * 120 + "tail"), (4, "no repeats here"), (5, "".join(map(chr, range(300, 900))))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(1) for n in ("t1", "t2", "mark", "spans", "n", "start", "end", "bytes")})
    assert found(repeats.without_repeats(docs)) == plain(rows, repeats.WIDTH)
    assert repeats.without_repeats(docs.limit(0)).count() == 0


def test_query_on_whole_documents(spark):
    from ctxledger.llm.queries import QUERIES

    small = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op12_induced_suffix_dedup"](spark, small).collect())
    assert got == sorted((d, n, sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest()) for d, n, spans, kept in plain(rows, 200))
