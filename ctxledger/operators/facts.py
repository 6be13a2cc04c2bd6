"""Fact sheets: the exact identifiers of a text that must survive as text."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxledger.functions.text import u16len

#: The token patterns, in order (ASCII classes).
PATTERNS = (
    r"\b[A-Z][A-Z0-9_]{2,}=[^\s)\"'<>]+",
    r"\b[A-Za-z][A-Za-z0-9_]{2,}=[A-Za-z0-9_.:/+-]{1,64}",
    r"\bhttps?://[^\s)\"'<>]+",
    r"\b[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+\b",
    r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    r"\b[A-Z]{2}\d{2}[A-Z0-9]{8,30}\b",
    r"(?:[$€£¥]|(?:USD|EUR|GBP|CAD|AUD|CHF|JPY))\d(?:[\d,_]*\d)?(?:\.\d{2})?\b",
    r"(?:[\w@~+-]+)?(?:/[\w.@+-]+)+\.[A-Za-z]\w{0,8}\b",
    r"/[\w.@+-]+(?:/[\w.@+-]+)+/?",
    r"\b[0-9a-f]{7,40}\b",
    r"\bv?\d+\.\d+(?:\.\d+)?(?:[-+][\w.]+)?\b",
    r"(?<![\w-])--?[A-Za-z][\w-]+",
    r"\b\d[\d,_]{3,}\b",
    r"\b\d+\.\d+\b",
    r"\b[A-Z][A-Z0-9]{2,}(?:_[A-Z0-9]+)+\b",
    r"\b(?:[a-z]+|[A-Z][a-z0-9]+)(?:[A-Z][a-z0-9]*)+\b",
    r"\b[A-Z][A-Z0-9]+(?:-[A-Z0-9]+)+\b",
)
#: Tiers by whole-token form. Tier 0 keeps first, tier 2 last.
EXACT = (
    r"^[A-Z][A-Z0-9_]{2,}=\S+$", r"^(?=.*[0-9])[0-9a-f]{7,40}$", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+$",
    r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{8,30}$", r"^(?:[$€£¥]|(?:USD|EUR|GBP|CAD|AUD|CHF|JPY))[0-9](?:[0-9,_]*[0-9])?(?:\.[0-9]{2})?$",
    r"^[A-Z][A-Z0-9]{2,}(?:_[A-Z0-9]+)+$", r"^(?=.*[0-9])[A-Z][A-Z0-9]+(?:-[A-Z0-9]+)+$", r"^--?[A-Za-z][A-Za-z0-9_-]+$", r"^[0-9][0-9,_]*$", r"^[0-9]+\.[0-9]+$",
)
CAMEL = r"^(?:[a-z]+|[A-Z][a-z0-9]+)(?:[A-Z][a-z0-9]*)+$"
#: Chunk and token lengths, distinct tokens scanned, page of a very long text and from when, sheet size, tier-2 entries.
CHUNK, TOKEN, SCANNED, PAGE, LONG, SHEET, LINKS = (3, 512), (3, 120), 2048, 28080, 262_144, 96, 8

_GAP = re.compile("[\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")
_MAYBE = re.compile(r"[0-9=/@_$€£¥-]|[a-z0-9][A-Z]")


def _units(s: str) -> int:
    return len(s) if s.isascii() else len(s.encode("utf-16-be")) // 2


def spans(text: str, patterns) -> list[tuple[int, str]]:
    """Distinct (offset, token) of a text, up to the chunk that brings the distinct tokens to SCANNED."""
    out, tokens, at = [], set(), 0
    for gap in [*_GAP.finditer(text), None]:
        end = gap.start() if gap else len(text)
        chunk, base = text[at:end], at
        at = gap.end() if gap else end
        if not CHUNK[0] <= _units(chunk) <= CHUNK[1] or not _MAYBE.search(chunk):
            continue
        found = set()
        for i, pattern in patterns:
            for m in pattern.finditer(chunk):
                token = m[0].strip().rstrip(".,;:!?")
                if i == 9 and not any(c.isdigit() for c in m[0]) or i == 16 and not any(c.isdigit() for c in m[0][:120]):
                    continue
                if TOKEN[0] <= _units(token) <= TOKEN[1]:
                    found.add((base + m.start(), token))
        out += sorted(found)
        tokens.update(t for _, t in found)
        if len(tokens) >= SCANNED:
            break
    return out


def _pages(text: str, long: int = LONG, page: int = PAGE) -> list[str]:
    """A text over ``long`` units in pages of ``page`` units; half of a character cut in two counts as unreadable."""
    if (n := _units(text)) <= long:
        return [text]
    if n == len(text):
        return [text[i : i + page] for i in range(0, n, page)]
    raw = text.encode("utf-16-be", "surrogatepass")
    return [raw[i : i + 2 * page].decode("utf-16-be", "replace") for i in range(0, 2 * n, 2 * page)]


def _scan(which):
    def run(batches):
        patterns = [(i, re.compile(PATTERNS[i], re.ASCII)) for i in which]
        for b in batches:
            ids, pages, offsets, tokens = [], [], [], []
            for doc, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                text = text.as_py() or ""
                lo = 0
                for page, part in enumerate(_pages(text, LONG, PAGE)):
                    for offset, token in spans(part, patterns):
                        ids.append(doc.as_py())
                        pages.append(page)
                        offsets.append(lo + offset)
                        tokens.append(token)
                    lo += len(part)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pages, pa.int32()), pa.array(offsets, pa.int64()), pa.array(tokens, pa.string())], names=["doc_id", "page", "offset", "token"])

    return run


def fact_spans(docs: DataFrame, which=range(len(PATTERNS))) -> DataFrame:
    """(doc_id, page, offset, token) spans; texts over LONG units are cut in pages of PAGE units."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan(tuple(which)), "doc_id long, page int, offset long, token string")


def fact_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "token").agg(F.count("*").alias("count"))


#: What a token's signature tells apart: letters of either case, digits, and what else tokens hold.
_SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789=/@_-.:"


def signature(token: Column) -> Column:
    """Bits of the characters that a token holds: one that holds another has all its bits."""
    low = F.lower(token)
    return sum((F.when(F.contains(low, F.lit(c)), 1 << i).otherwise(0).cast("long") for i, c in enumerate(_SIGNS)), F.lit(0).cast("long"))


def collapse_substrings(counts: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Drops a token that a longer token of its group contains.

    A page has SCANNED tokens and the chunk that brings them at most, so with pages among
    the ``keys`` the list is bounded; comparing within it keeps one exchange and makes no pairs.
    Lengths and signatures are compared first, so that few pairs of tokens are looked into.
    """
    lists = counts.groupBy(*keys).agg(F.collect_list(F.struct("token", "count", F.length("token").alias("n"), signature(F.col("token")).alias("bits"))).alias("facts"))
    inside = lambda t, u: (u["n"] > t["n"]) & (u["bits"].bitwiseAND(t["bits"]) == t["bits"]) & F.contains(u["token"], t["token"])
    kept = F.filter("facts", lambda t: ~F.exists("facts", lambda u: inside(t, u)))
    return lists.select(*keys, F.explode(kept).alias("f")).select(*keys, "f.token", "f.count")


def priority_tier(token: Column) -> Column:
    out = F.when(token.rlike("|".join(EXACT)), 0).when(token.rlike(CAMEL) & (u16len(token) >= 8), 0)
    return out.when(token.rlike(r"^https?://"), 2).otherwise(1)


def rank_facts(counts: DataFrame, most: int = SHEET, links: int = LINKS, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The sheet's entries per group: by tier, longest first, then bytes; at most ``links`` of tier 2, which take no slot beyond."""
    order = [F.col("tier"), F.desc(u16len(F.col("token"))), F.col("token")]
    ranked = counts.withColumn("tier", priority_tier(F.col("token")))
    ranked = ranked.withColumn("_t", F.row_number().over(Window.partitionBy(*keys, "tier").orderBy(*order))).where((F.col("tier") < 2) | (F.col("_t") <= links)).drop("_t")
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)


def fact_entries(found: DataFrame, most: int = SHEET) -> DataFrame:
    """(doc_id, token, count, tier, rank, dropped) of the spans ``found``.

    Each page has entries of its own: counted, collapsed, ranked. The pages' counts add
    up and are ranked once more without collapsing; dropped is how many of a
    document's page entries its sheet leaves out. A text of one page keeps its entries.
    """
    page = ("doc_id", "page")
    counts = found.groupBy(*page, "token").agg(F.count("*").alias("count"))
    entries = rank_facts(collapse_substrings(counts, page), most, keys=page).select("doc_id", "token", "count")
    whole = entries.groupBy("doc_id", "token").agg(F.sum("count").alias("count"))
    ranked = rank_facts(whole.withColumn("_all", F.count("*").over(Window.partitionBy("doc_id"))), most)
    return ranked.withColumn("dropped", F.col("_all") - F.count("*").over(Window.partitionBy("doc_id"))).drop("_all")


#: How a sheet opens, in full and compact form, without and with repeated entries.
OPENERS = {
    (False, False): "[Exact identifiers from the rendered context above (paths, ids, versions, numbers) — quote these verbatim instead of transcribing them from the image: ",
    (False, True): "[Exact identifiers from the rendered context above (paths, ids, versions, numbers) — quote these verbatim instead of transcribing them from the image; ×N marks a token that occurs N times within the imaged content: ",
    (True, False): "[Exact rendered identifiers—quote verbatim: ",
    (True, True): "[Exact rendered identifiers—quote verbatim; ×N=count: ",
}


def fact_sheet(ranked: DataFrame, compact: bool = False) -> DataFrame:
    """One line per document: entries in rank order, repeated ones with their count, under the opener that fits."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("rank", "token", "count"))), lambda f: F.when(f["count"] >= 2, F.concat(f["token"], F.lit(" ×"), f["count"].cast("string"))).otherwise(f["token"]))
    opener = F.when(F.max("count") >= 2, OPENERS[compact, True]).otherwise(OPENERS[compact, False])
    return ranked.groupBy("doc_id").agg(F.concat(opener, F.array_join(parts, " · "), F.lit("]")).alias("sheet"))
