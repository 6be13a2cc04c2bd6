"""Folds and whole plans against naive versions, one row at a time."""

import random

from pyspark.sql import functions as F

from ctxledger.functions import tokens
from ctxledger.operators import paging, planning, sessions


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_duplicates(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), i, rng.randint(0, 900), rng.choice([None, None, 5, 20, -3])) for i in range(600)]
    df = spark.createDataFrame(rows, "digest string, seq long, s long, took long").withColumn("ts", F.timestamp_seconds("s")).withColumn("ended", F.timestamp_seconds(F.col("s") + F.col("took")))
    for held in (False, True):
        expect = {}
        for mine in by_key(rows).values():
            until = None
            for _, seq, s, took in sorted(mine, key=lambda r: (r[2], r[1])):
                expect[seq] = until is None or s >= until
                if expect[seq]:
                    until = s + 60 if not held or took is None else min(s + 60, s + max(0, took))
        got = sessions.duplicates_in_flight(df if held else df.drop("ended"), 60).collect()
        assert {r["seq"]: r["accepted"] for r in got} == expect and got[0].asDict().keys() == {"digest", "seq", "us", "accepted"}
    assert sessions.duplicates_in_flight(df.limit(0)).count() == 0


def test_admission(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, 3, None]), i, rng.randint(0, 6), rng.randint(0, 50)) for i in range(400)]
    expect = {}
    for mine in by_key(rows).values():
        left, room = 40, 300
        for _, i, p, b in sorted(mine, key=lambda r: r[1]):
            expect[i] = p <= left and b <= room
            if expect[i]:
                left, room = left - p, room - b
    got = paging.admit_by_budget(spark.createDataFrame(rows, "request_id long, idx long, pages long, bytes long"), 40, 300).collect()
    assert {r["idx"]: r["admitted"] for r in got} == expect


def test_sections(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 5), i, rng.randint(0, 40), rng.choice([0, 0, 1]), rng.random() < 0.1) for i in range(500)]
    expect = {}
    for mine in by_key(rows).values():
        sections, now = [], []
        for _, i, n, calls, pinned in mine:
            if pinned:
                sections += [now, [i]] if sum(x[1] for x in now) else [[*now, (i, n)]]
                now = []
                continue
            now.append((i, n))
            if sum(x[1] for x in now) >= 100 and not calls:
                sections.append(now)
                now = []
        for s, part in enumerate([*sections, now]):
            for x in part:
                expect[x[0] if isinstance(x, tuple) else x] = s
    got = tokens.token_sections(spark.createDataFrame(rows, "conv_id long, idx long, tokens long, open_calls long, pinned boolean"), 100).collect()
    assert {r["idx"]: r["section"] for r in got} == expect


def test_prefix_fit(spark):
    rng = random.Random(4)
    rows = []
    for request in range(20):
        for run in range(rng.randint(1, 5)):
            upto = 0
            for _ in range(rng.randint(1, 6)):
                upto += rng.randint(0, 4)
                rows.append((request, run, len(rows), upto))
    expect = {}
    for mine in by_key(rows).values():
        left = 12
        for run in sorted({r[1] for r in mine}):
            part = [r for r in mine if r[1] == run]
            for r in part:
                expect[r[2]] = r[3] <= left
            left -= max((r[3] for r in part if r[3] <= left), default=0)
    got = tokens.prefix_fit(spark.createDataFrame(rows, "request_id long, run long, idx long, pages long"), 12).collect()
    assert {r["idx"]: r["taken"] for r in got} == expect


def test_compaction_plan(spark):
    """Reasons and savings, worked out by hand for one profile of each kind of floor."""
    texts = {1: ("claude-opus-5", "word " * 30_000), 2: ("claude-opus-5", "short"), 3: ("gpt-5", "word " * 40), 4: ("gemini-3.6-flash", "word " * 30_000), 5: ("claude-opus-5", None), 6: ("claude-opus-5", "   \n"), 7: ("gpt-5", "word " * 9_000), 8: ("mistral", "x" * 9000)}
    rows = spark.createDataFrame([(i, m, t) for i, (m, t) in texts.items()], "request_id long, model string, text string")
    got = {r["request_id"]: r for r in planning.compaction_plan(rows, ("claude", "gpt-5")).collect()}
    assert got[4]["reason"] == got[8]["reason"] == "unsupported_model"
    assert got[2]["reason"] == got[6]["reason"] == "below_min_chars" and got[3]["reason"] == "below_min_tokens" and got[5]["reason"] == "no_static_context"
    n = len(("word " * 30_000).rstrip())
    lines = -(-n // 312)
    per = min((728 - 8) // 8, 28080 // 312)
    pages = -(-lines // per)
    last = lines - (pages - 1) * per
    width, full, tail = 312 * 5 + 8, per * 8 + 8, last * 8 + 8
    patches = (pages - 1) * -(-width // 28) * -(-full // 28) + -(-width // 28) * -(-tail // 28)
    image = -(-patches * 11 // 10)
    assert (got[1]["reason"], got[1]["chars"], got[1]["image_tokens"], got[1]["text_tokens"]) == ("applied", n, image, n / 2) and got[1]["saved_tokens"] == n / 2 - image
    m = len(("word " * 9_000).rstrip())
    assert got[7]["text_tokens"] == m / 2 and (got[7]["reason"] == "applied") == (got[7]["image_tokens"] < m / 2) and got[7]["saved_tokens"] == (m / 2 - got[7]["image_tokens"] if got[7]["reason"] == "applied" else 0)


def test_state_expires(spark, tmp_path):
    """A digest's lease leaves the store when the watermark is past its keep; without one it stays."""
    from ctxledger.streaming import streams

    for keep, expect in ((7200, True), (0, False)):
        path, day = tmp_path / f"in{keep}", 86_400
        source = None
        for digest, seq, at in (("d", 1, day), ("other", 2, 2 * day), ("d", 3, 2 * day + 1), ("d", 4, 2 * day + 2)):  # "other" moves the watermark
            spark.createDataFrame([(digest, seq, at)], "digest string, seq long, s long").coalesce(1).write.mode("append").parquet(str(path))
            if source is None:
                source = spark.readStream.schema("digest string, seq long, s long").parquet(str(path)).withColumn("ts", F.timestamp_seconds("s"))
                query = streams.exact_duplicate_guard(source, 7200 if keep else 10 * day, keep).writeStream.outputMode("append").format("memory").queryName(f"keep{keep}").option("checkpointLocation", str(path) + "-ckpt").start()
            query.processAllAvailable()
        query.stop()
        assert {r["seq"]: r["accepted"] for r in spark.table(f"keep{keep}").collect()} == {1: True, 2: True, 3: expect, 4: False}


def test_whole_plans_share_the_images(spark, tmp_path):
    """Static text first, then history, then results in order while images are left; written and read again as they are."""
    from ctxledger.sources import io

    big = "word " * 30_000
    requests = spark.createDataFrame([(1, "claude-opus-5", big), (2, "mistral", big), (3, "claude-opus-5", None)], "request_id long, model string, text string")
    turns = spark.createDataFrame([(r, i, "user", "say " * 40, 0, [], []) for r in (1, 2, 3) for i in range(12)], "request_id long, idx long, role string, text string, uses long, opens array<string>, closes array<string>")
    results = spark.createDataFrame([(r, i, t, e) for r in (1, 2, 3) for i, (t, e) in enumerate([(big, False), (big, True), (big[:9000], False), ("short", False), (big[:70_000], False)])], "request_id long, idx long, text string, is_error boolean")
    history = dict(budget=80, page_chars=400, base=4, keep_tail=2, min_prefix=4, snap=0)
    plans, chunks, told = planning.compaction_plans(requests, turns, results, history, wire_images=17, least=6000, bases=("claude",), result_per_token=3.0)
    got = {r["request_id"]: r for r in plans.collect()}
    own = {(r["request_id"], r["idx"]): (r["reason"], r["pages"]) for r in told.collect()}
    one = got[1]
    assert one["reason"] == "applied" and one["static_pages"] == -(-(-(-len(big.rstrip()) // 312)) // 90) and one["history_reason"] == "collapsed" and one["history_pages"] > 0
    left = 17 - one["static_pages"] - one["history_pages"]
    expect = {}
    for i in (0, 2, 4):
        pages = own[1, i][1]
        expect[i] = "paged" if pages <= left else "image_budget"
        left -= pages if pages <= left else 0
    assert {i: own[1, i][0] for i in expect} == expect and set(expect.values()) == {"paged", "image_budget"}
    assert own[1, 1][0] == "is_error" and own[1, 3][0] == "below_threshold"
    assert one["pages"] == one["static_pages"] + one["history_pages"] + one["result_pages"] and one["passthrough"]["is_error"] == 1
    assert got[2]["pages"] == 0 and got[2]["passthrough"] == {"unsupported_model": 5} and got[3]["reason"] == "no_static_context" and got[3]["static_pages"] == 0
    io.write_plans(plans.withColumn("protocol", F.lit("messages")), str(tmp_path / "plans"))
    io.write_plans(chunks, str(tmp_path / "chunks"), "json")
    again = spark.read.parquet(str(tmp_path / "plans"))
    assert sorted(map(str, again.select(*plans.columns).collect())) == sorted(map(str, got.values())) and (tmp_path / "plans" / "protocol=messages").is_dir()
    assert spark.read.json(str(tmp_path / "chunks")).count() == chunks.count() > 0
