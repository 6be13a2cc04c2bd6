"""URL filtering: rules first, then naive Bayes over words segmented out of hosts and paths.

The unigram model counts the words of all pages' visible texts. A host label is cut at
its digits, and each run of letters into the words of highest total probability
(Viterbi); an unknown run costs ever more with its length, so it stays whole unless
known words explain it. The counts are never gathered: each distinct run's
substrings are joined to them, and it is cut by its own words.

Naive Bayes is multinomial over hashed tokens and learns from the pages that a rule
decides: it carries the rules' verdicts over to pages that no rule fits, by the words
of their hosts and paths. What only states a rule's scope teaches nothing about other
pages and is left out: the host's last label, and the path segments that rules name.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxledger.llm import _text as T
from ctxledger.llm._work import materialize, table

#: The longest run that is segmented (a host label has no more), and the bins of the token counts.
LONGEST, LOG2 = 63, 18
#: Pseudo-count of each bin in each class.
SMOOTH = 1.0
#: Posterior from which naive Bayes blocks; its classes are taken as equally likely before a token is seen.
SURE = 0.9
#: The rules of the contract, verdict and host/path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HIDDEN = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?[a-z0-9]{1,10};"


def visible(html: Column) -> Column:
    """The text of a page without its tags, comments, scripts, styles and entities."""
    return F.regexp_replace(html.cast("string"), _HIDDEN, " ")


def unigrams(pages: DataFrame) -> tuple[DataFrame, int]:
    """(word, n) of every lower-cased word of 2 to LONGEST letters in all pages' visible texts, and the sum of n, 1 at least."""
    words = pages.select(F.explode(F.split(F.lower(visible(F.col("html"))), r"[^\p{L}]+")).alias("word"))
    counts = words.where(F.length("word").between(2, LONGEST)).groupBy("word").agg(F.count("*").alias("n"))
    counts = materialize(counts, "unigrams")
    return counts, counts.agg(F.sum("n")).first()[0] or 1


def segment(label: str, model: dict[str, float], total: int) -> list[str]:
    """The words of highest total log probability whose concatenation is ``label``.

    A word that ``model`` does not know has probability 10 / (total * 10**length). Ties
    take the longer first cut from the right.
    """
    n = len(label)
    unknown = math.log(10 / total)
    best, cut = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for z in range(1, n + 1):
        for a in range(z):
            p = model.get(label[a:z], unknown - math.log(10) * (z - a))
            if best[a] + p > best[z]:
                best[z], cut[z] = best[a] + p, a
    out, z = [], n
    while z:
        out.append(label[cut[z] : z])
        z = cut[z]
    return out[::-1]


def _pieces(host: str) -> list[str]:
    """The parts of a host's labels: runs of letters of any script, and of digits."""
    return re.findall(r"[^\W\d_]+|\d+", host)


def _is_run(piece: str) -> bool:
    """Whether a piece is segmented; longer ones than a host label may be stay whole."""
    return 3 < len(piece) <= LONGEST and piece.isalpha()


def _runs(batches):
    for b in batches:
        hosts = b.column("host").to_pylist()
        found = [(h, p) for h in hosts for p in sorted(set(filter(_is_run, _pieces(h))))]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([p for _, p in found], pa.string())], names=["host", "run"])


def _substrings(batches):
    """(run, word) of each run's distinct substrings of 2 letters or more."""
    for b in batches:
        for run in b.column("run").to_pylist():
            found = sorted({run[a:z] for a in range(len(run)) for z in range(a + 2, len(run) + 1)})
            yield pa.RecordBatch.from_arrays([pa.array([run] * len(found), pa.string()), pa.array(found, pa.string())], names=["run", "word"])


def _cut(total: int):
    def run(batches):
        for b in batches:
            runs, words = b.column("run").to_pylist(), []
            for label, known in zip(runs, b.column("known").to_pylist(), strict=True):
                words.append(segment(label, {k["word"]: math.log(k["n"] / total) for k in known or ()}, total))
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), pa.array(words, pa.list_(pa.string()))], names=["run", "words"])

    return run


def segmented_hosts(rows: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(host, cuts) of the distinct hosts that hold a run of letters: cuts is an array of (run, words)."""
    runs = materialize(rows.select("host").distinct().mapInArrow(_runs, "host string, run string"), "runs")
    one = runs.select("run").distinct()
    known = one.mapInArrow(_substrings, "run string, word string").join(counts, "word")
    known = known.groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    cut = one.join(known, "run", "left").mapInArrow(_cut(total), "run string, words array<string>")
    return runs.join(cut, "run").groupBy("host").agg(F.collect_list(F.struct("run", "words")).alias("cuts"))


def _path_tokens(path: str) -> list[str]:
    return ["/#" if x.isdigit() else "/" + x.lower() for x in re.split(r"[\W_]+", path) if x]


def tokens(host: str, path: str, cuts: dict[str, list[str]], scope: frozenset[str] = frozenset()) -> list[str]:
    """What naive Bayes sees of a page: the words of all labels but the last, and the path's segments but those in ``scope``."""
    out = []
    for piece in _pieces(host.rpartition(".")[0]):
        out += cuts.get(piece) or [piece]
    return out + [t for t in _path_tokens(path) if t not in scope]


def _bins(tokens_: list[str]) -> list[int]:
    if not tokens_:
        return []
    raw, off = T.buffers(pa.array(tokens_))
    return (T.range_hashes(raw, off[:-1], off[1:]) >> T.U64(64 - LOG2)).astype(np.int64).tolist()


def _tokenised(scope: frozenset[str]):
    def run(batches):
        for b in batches:
            bins = []
            for host, path, cuts in zip(*(b.column(c).to_pylist() for c in ("host", "path", "cuts")), strict=True):
                bins.append(_bins(tokens(host, path, {c["run"]: c["words"] for c in cuts or ()}, scope)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "host", "path", "rule", "ruled")), pa.array(bins, pa.list_(pa.int64()))], names=["page_id", "host", "path", "rule", "ruled", "bins"])

    return run


def _judged(model):
    def run(batches):
        weights = model.value
        for b in batches:
            bins = b.column("bins")
            first = np.asarray(bins.offsets)
            total = np.concatenate([[0.0], np.cumsum(weights[np.asarray(bins.values)])])
            z = total[first[1:]] - total[first[:-1]]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "host", "path", "rule", "ruled")), pa.array(z)], names=["page_id", "host", "path", "rule", "ruled", "odds"])

    return run


def naive_bayes(rows: DataFrame) -> np.ndarray:
    """Weight of each bin, log P(bin | block) - log P(bin | allow), from the rows (ruled, bins) that a rule decides; 0 for bins not seen there."""
    counts = rows.where("ruled is not null").select("ruled", F.explode("bins").alias("bin")).groupBy("ruled", "bin").count().toPandas()  # 2 * 2**LOG2 rows at most
    found = np.zeros((2, 1 << LOG2))
    np.add.at(found, ((counts.ruled == "block").to_numpy().astype(int), counts.bin.to_numpy().astype(int)), counts["count"].to_numpy())
    smooth = found + SMOOTH
    seen = found.sum(axis=0) > 0
    share = np.maximum(found.sum(axis=1) + SMOOTH * seen.sum(), SMOOTH)
    weights = np.zeros(1 << LOG2)
    weights[seen] = (np.log(smooth[1, seen]) - np.log(share[1])) - (np.log(smooth[0, seen]) - np.log(share[0]))
    return weights


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, odds (log odds to block).

    A rule host/path fits its host and all subdomains where the url's path starts
    with the rule's; the longest that fits decides, else naive Bayes does, which blocks
    from a posterior of SURE on. A null url, or one without ://, has an empty host and
    path, no token, and even odds: it is allowed. So is every page that no rule fits
    where rules decide nothing. Hosts of any length are taken whole. Repeated rows
    are judged each and count as often as they occur; other columns are ignored; an
    empty table gives no rows.
    """
    spark = pages.sparkSession
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    start = F.locate("://", url)
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    rows = pages.select("page_id", host.alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"))
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, path = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + path)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    rows = rows.withColumns({"rule": none if rule is None else rule, "ruled": none if verdict is None else verdict})
    counts, total = unigrams(pages)
    rows = rows.join(segmented_hosts(rows, counts, total), "host", "left")
    kinds = f"page_id {dict(pages.dtypes)['page_id']}, host string, path string, rule string, ruled string"
    scope = frozenset(t for _, text in rules for t in _path_tokens(text.partition("/")[2]))
    found = materialize(rows.mapInArrow(_tokenised(scope), kinds + ", bins array<long>"), "tokens")
    out = found.mapInArrow(_judged(spark.sparkContext.broadcast(naive_bayes(found))), kinds + ", odds double")
    method = F.when(F.col("odds") >= math.log(SURE / (1 - SURE)), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "odds")


def op4_segmented_urls(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"))
