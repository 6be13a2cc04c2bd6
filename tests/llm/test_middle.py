"""Fill-in-the-middle against the definition, and exact round trips."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxledger.llm import middle

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def plain(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    if h4 % 100 < spm:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def texts():
    rng = random.Random(2)
    odd = [None, "", "\n", "\n\n\n", "no end", "é😀\n漢字\r\nx", "a<P>b", "<S>", "x\n<M>\ny", "<\nP>\n<", "<P\n>S>\n", "ends <", "\x0b\x0c \n", "line\n" * 30000, "x" * 200001]
    made = ["".join(rng.choice(["ab", "é", "\n", "<", "P>", " ", "😀"]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    return odd + made


@pytest.mark.parametrize("how", [{}, {"seed": 3, "rate": 40, "spm": 90}])
def test_outputs_and_round_trip(spark, how, monkeypatch):
    monkeypatch.setattr(middle, "SWAP", 1 << 9)
    rows = list(enumerate(texts())) + [(None, "one\ntwo\n"), (5, "same"), (5, "same"), (-3, "neg\native\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(1) for n in ("n", "form", "output", "row")})
    arranged = middle.fill_in_middle(docs, **how)
    got = [tuple(r) for r in arranged.collect()]
    key = lambda r: (str(r[0]), str(r[-1]))
    assert sorted(got, key=key) == sorted((plain(d, t, **how) for d, t in rows), key=key)
    back = middle.restored(arranged).select("doc_id", "text").collect()
    assert sorted((str(r[0]), r[1]) for r in back) == sorted((str(d), t or "") for d, t in rows)
    assert middle.fill_in_middle(docs.limit(0)).count() == 0


def test_rotation_exchanges_blocks(monkeypatch):
    monkeypatch.setattr(middle, "SWAP", 3)
    for n in range(24):
        for lo in range(n + 1):
            for mid in range(lo, n + 1):
                view = np.arange(n, dtype=np.uint8)
                middle.rotate(view, lo, mid, n)
                assert view.tolist() == [*range(lo), *range(mid, n), *range(lo, mid)]
