"""URL filtering against brute force."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from ctxledger.llm import urlfilter

RULES = (("block", "cheapcasino.test/"), ("block", "casinobonus.test/"), ("block", "bonuspills.test/x/"), ("allow", "riverstone.test/"), ("allow", "gardenhouse.test/"), ("allow", "stonegarden.test/"))
HTML = "<html><style>p{cheap}</style><script>var casinobonus</script><p>cheap casino bonus pills <b>river</b> stone garden house straße gärten wörter</p>&nbsp;</html>"


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "bins": F.lit(2), "ruled": F.lit(3), "word": F.lit(4), "n": F.lit(5), "cuts": F.lit(6)})


def sample(spark):
    hosts = ["cheapcasino.test", "casinobonus.test", "bonuspills.test", "riverstone.test", "gardenhouse.test", "stonegarden.test"]
    rows = [(i, f"https://{'www.' * (i % 2)}{hosts[i % 6]}/x/{i}", HTML) for i in range(120)]
    rows += [(200, "http://bonuscasino.other/x/1", HTML), (201, "http://pillscheap.casino.other/y", HTML), (202, "http://stoneriver.other/x/9", HTML), (203, "http://neverseen.other/", None)]
    rows += [(900, None, None), (901, "no scheme", ""), (902, "http://A.net/fr/x?y#z", None), (903, "http://" + "verylonghost" * 300 + ".other/" + "seg/" * 5000, None), (904, "https://x.gärtenwörter.test/", HTML), (905, "http://bonuspills.test", None), (906, "http://riverstone.test/", None), (906, "http://riverstone.test/", None), (None, "http://b.other:80?x", None)]
    return frame(spark, rows)


def test_verdicts(spark):
    pages = sample(spark)
    rows = urlfilter.filter_urls(pages, RULES).collect()
    got = {r["page_id"]: r for r in rows}
    assert len(rows) == pages.count() and sum(r["page_id"] == 906 for r in rows) == 2
    assert all(got[i]["verdict"] == ("block" if i % 6 < 3 else "allow") and got[i]["rule"] is not None for i in range(120))
    # no rule names these hosts, no word list either: the words of blocked hosts do
    assert got[200]["rule"] is None and got[200]["verdict"] == "block" and got[201]["verdict"] == "block"
    assert got[202]["verdict"] == "allow" and got[203]["verdict"] == "allow" and got[203]["odds"] == 0
    assert (got[900]["host"], got[900]["path"], got[900]["verdict"], got[900]["odds"]) == ("", "", "allow", 0) and got[901]["host"] == ""
    assert (got[902]["host"], got[902]["path"]) == ("a.net", "/fr/x") and len(got[903]["path"]) == 20001 and got[905]["rule"] is None
    assert urlfilter.filter_urls(pages.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in urlfilter.filter_urls(pages, ()).collect()} == {"allow"}


def test_contract_rules(spark):
    urls = {902: "http://A.net/fr/x?y#z", 903: "ftp://www.Example.com/en/", 904: "https://x.example.com/en/a", 905: "http://b.com", 906: "http://b.com/", 907: "http://x.www.example.com/en/", 908: "http://com/", 909: "http://a.net/frx", 910: "http://xnet/es/", 911: "x://y://example.com/en/"}
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.filter_urls(frame(spark, [(i, u, None) for i, u in urls.items()])).collect()}
    assert got[902] == ("net/fr/", "block") and got[903] == ("www.example.com/en/", "allow") and got[904] == ("example.com/en/", "block")
    assert got[905][0] is None and got[906] == ("com/", "allow") and got[907] == ("www.example.com/en/", "allow") and got[908] == ("com/", "allow")
    assert got[909][0] is None and got[910][0] is None and got[911][0] is None


def test_odds_equal_brute_force_naive_bayes(spark):
    pages = sample(spark)
    rows = urlfilter.filter_urls(pages, RULES).collect()
    counts, total = urlfilter.unigrams(pages)
    known = {r["word"]: r["n"] for r in counts.collect()}
    model = {w: math.log(n / total) for w, n in known.items()}

    def seen(r):
        out = []
        for piece in re.findall(r"[^\W\d_]+|\d+", r["host"].rpartition(".")[0]):
            out += brute_cut(piece, model, total) if urlfilter._is_run(piece) else [piece]
        return out + [t for t in ("/#" if x.isdigit() else "/" + x for x in re.split(r"\W+", r["path"]) if x) if t != "/x"]

    blocked = {"cheapcasino.test/", "casinobonus.test/", "bonuspills.test/x/"}
    total_of = [collections.Counter(), collections.Counter()]
    for r in rows:
        if r["rule"]:
            total_of[r["rule"] in blocked].update(seen(r))
    kinds = set(total_of[0]) | set(total_of[1])
    for r in rows:
        expect = sum(math.log((total_of[1][t] + 1) / (sum(total_of[1].values()) + len(kinds))) - math.log((total_of[0][t] + 1) / (sum(total_of[0].values()) + len(kinds))) for t in seen(r) if t in kinds)
        assert r["odds"] == pytest.approx(expect, abs=1e-9)
        assert r["rule"] or (r["verdict"] == "block") == (expect >= math.log(9))


def brute_cut(s, model, total):
    """The best of all ways to cut ``s``, by recursion."""
    memo = {"": (0.0, [])}

    def best(x):
        if x not in memo:
            memo[x] = max(((best(x[:i])[0] + model.get(x[i:], math.log(10 / total) - math.log(10) * (len(x) - i)), [*best(x[:i])[1], x[i:]]) for i in range(len(x))), key=lambda c: c[0])
        return memo[x]

    return best(s)[1]


def test_viterbi_equals_brute_force():
    rng = random.Random(5)
    model = {"river": math.log(0.2), "stone": math.log(0.2), "rivers": math.log(0.1), "tone": math.log(0.05), "one": math.log(0.1), "t": math.log(0.01)}

    def cost(words):
        return sum(model.get(w, math.log(10 / 1000) - math.log(10) * len(w)) for w in words)

    for s in ["riverstone", "stoneone", "xriver", "qq", "riversone"] + ["".join(rng.choice(["river", "tone", "s", "q", "one"]) for _ in range(5)) for _ in range(40)]:
        got = urlfilter.segment(s, model, 1000)
        assert "".join(got) == s and cost(got) == pytest.approx(cost(brute_cut(s, model, 1000)))


def test_unigrams_are_those_of_the_visible_text(spark):
    html = ["<p class='hidden'>Straße straße</p><!-- comment --><SCRIPT>code()</SCRIPT >naïve &amp; 日本 a", None, "", "<style>\nbody{}\n</style>two\ntwo <b", "x" * 64 + " " + "y" * 63]
    counts, total = urlfilter.unigrams(spark.createDataFrame([(i, h) for i, h in enumerate(html)], "page_id long, html string"))
    assert {r["word"]: r["n"] for r in counts.collect()} == {"straße": 2, "naïve": 1, "日本": 1, "two": 2, "y" * 63: 1} and total == 7


def test_segments_of_rare_words_and_digits(spark):
    """Every word counts, however many there are and whatever its script."""
    words_ = ["".join("bcdfghklmnprstvw"[(i >> 4 * k) & 15] + "aeio"[(i >> k) & 3] for k in range(4)) for i in range(60_000)]
    html = [" ".join(words_[i::6]) for i in range(6)] + ["cheap flower shop casino bet gärten wörter"]
    hosts = ["cheapflowershop", "cheapcasino24", "bet365shop", "flowershop", "gärtenwörter"]
    pages = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "page_id long, html string")
    counts, total = urlfilter.unigrams(pages)
    hosts_ = spark.createDataFrame([(h,) for h in hosts], "host string")
    cuts = {r["host"]: {c["run"]: c["words"] for c in r["cuts"]} for r in urlfilter.segmented_hosts(hosts_, counts, total).collect()}
    assert cuts["cheapflowershop"] == {"cheapflowershop": ["cheap", "flower", "shop"]} and cuts["gärtenwörter"] == {"gärtenwörter": ["gärten", "wörter"]}
    assert urlfilter.tokens("cheapcasino24.x", "/a/17", cuts["cheapcasino24"]) == ["cheap", "casino", "24", "/a", "/#"]
    assert urlfilter.tokens("bet365shop.x", "", cuts["bet365shop"]) == ["bet", "365", "shop"]
