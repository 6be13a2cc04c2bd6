"""Streams give what the batch operators give, on replayed files."""

import random

from pyspark.sql import functions as F

from ctxledger.operators import sessions, usage
from ctxledger.plans import activity
from ctxledger.sources.io import stream_events
from ctxledger.streaming import streams

SMALL = "/root/testdata/sf0.001"
KEEP = 1000 * 86_400  # longer than the replayed log, so that no state goes


def replay(spark, df, path, name, build, mode="append"):
    """Write df in time order as three files, stream them one by one, return the memory sink's rows."""
    n = df.count()
    rank = F.ntile(3).over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("ts", "seq"))
    parts = df.withColumn("_p", rank)
    for p in (1, 2, 3):
        parts.where(F.col("_p") == p).drop("_p").coalesce(1).write.mode("append").parquet(str(path))
    source = stream_events(spark, str(path), df.schema.simpleString()[7:-1].replace(":", " "), files=1)
    query = build(source).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(path) + "-ckpt").start()
    query.processAllAvailable()
    query.stop()
    assert n
    return spark.table(name)


def _events(spark):
    return activity.session_events(spark, SMALL).withColumn("ts", F.col("ts").cast("timestamp"))


def test_session_state(spark, tmp_path):
    e = _events(spark).select("session", "ts", "seq", "kind", "cache_read", "cache_create")
    got = replay(spark, e, tmp_path / "a", "cold", lambda s: streams.session_state_stream(s, KEEP))
    expect = sessions.session_cold(e).select("session", "seq", "cold")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expect.collect()))


def test_tag_churn(spark, tmp_path):
    t = _events(spark).select("session", "ts", "seq", F.col("event_type").alias("tag"), F.floor(F.col("value") / 20).cast("string").alias("content"))
    got = replay(spark, t, tmp_path / "b", "churn", lambda s: streams.tag_churn_stream(s, KEEP))
    expect = sessions.tag_churn(t).select("session", "tag", "seq", "changed")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expect.collect()))


def test_duplicates(spark, tmp_path):
    e = _events(spark).select(F.concat_ws(":", "session", "event_type").alias("digest"), "ts", "seq")
    got = replay(spark, e, tmp_path / "c", "dups", lambda s: streams.exact_duplicate_guard(s, 3600, KEEP))
    expect = sessions.duplicates_in_flight(e, 3600).select("digest", "seq", "accepted")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expect.collect()))


def test_ledger_windows(spark, tmp_path):
    o = activity.outcomes(spark, SMALL).withColumns({"ts": F.col("ts").cast("timestamp"), "seq": F.col("request_id")})
    got = replay(spark, o, tmp_path / "d", "ledger", lambda s: streams.ledger_stream(s.drop("seq")), "complete")
    expect = usage.ledger(o).groupBy(F.window("ts", "10 minutes").alias("window"), "model").agg(F.count("*"), F.sum("sent"), F.sum("saved"))
    assert sorted(map(str, got.collect())) == sorted(str(r).replace("count(1)", "requests").replace("sum(sent)", "sent").replace("sum(saved)", "saved") for r in expect.collect())


def test_idle_sessions_and_approximate_duplicates(spark, tmp_path):
    e = _events(spark).select("session", "ts", "seq")
    got = replay(spark, e, tmp_path / "e", "idle", streams.idle_sessions)
    whole = sessions.idle_sessions(e).count()
    assert 0 < got.count() <= whole  # windows that the watermark has not passed are still open
    d = e.withColumn("digest", F.lit("one"))
    assert 0 < replay(spark, d, tmp_path / "f", "first", streams.duplicate_guard).count() < d.count()


def _fragments(rng, body, ended):
    """A body cut anywhere into pieces; the last one tells of a clean end."""
    cuts = sorted(rng.sample(range(len(body) + 1), min(len(body), rng.randint(0, 4))))
    parts = [body[a:b] for a, b in zip([0, *cuts], [*cuts, len(body)], strict=True)]
    return [(i, p, ended and i == len(parts) - 1) for i, p in enumerate(parts)]


def test_usage_from_fragments(spark, tmp_path):
    """Bodies cut anywhere, over several batches, give what the batch merge gives; one without an end gives nothing."""
    rng = random.Random(3)
    start = 'data: {"type":"message_start","message":{"usage":{"input_tokens":%d,"output_tokens":1,"cache_read_input_tokens":%d}}}'
    delta = 'data: {"usage":{"output_tokens":%d,"cache_creation_input_tokens":"no"}}'
    bodies = {}
    for i in range(60):
        nl = rng.choice(["\n", "\r\n"])
        lines = ["event: x", start % (i, i * 2), "", "data: [DONE]", *(delta % (i * 10 + k) for k in range(rng.randint(0, 3))), "data: {broken", ""]
        bodies[f"r{i}"] = rng.choice([nl.join(lines), nl.join(lines).rstrip(), '{\n "usage": {"input_tokens": %d, "output_tokens": 2.5}}' % i, "", "not json"])
    bodies["r60"], bodies["r61"] = start % (1, 2), delta % 7
    rows = [(r, 10**6 + 3600 * (int(r[1:]) % 5) + 60 * i, 100 * int(r[1:]) + i, chunk, end) for r, body in bodies.items() for i, chunk, end in _fragments(rng, body, int(r[1:]) % 7 != 6)]
    df = spark.createDataFrame(rows, "response_id string, s long, seq long, chunk string, ended boolean").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = replay(spark, df, tmp_path / "u", "usage", lambda s: streams.usage_stream(s, KEEP)).collect()
    whole = spark.createDataFrame([(r, b) for r, b in bodies.items() if int(r[1:]) % 7 != 6], "response_id string, body string")
    expect = usage.merge_usage(usage.usage_events(whole)).collect()
    assert len(expect) > 45 and sorted(map(str, got)) == sorted(map(str, expect))


def test_leases_end_with_their_response(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), i, 10**6 + rng.randint(0, 4000), rng.choice([None, 0, 5, 20, 500])) for i in range(500)]
    every = spark.createDataFrame(rows, "digest string, seq long, s long, took long").withColumn("ts", F.timestamp_seconds("s")).withColumn("ended", F.timestamp_seconds(F.col("s") + F.col("took")))
    expect = sessions.duplicates_in_flight(every, 60).select("digest", "seq", "accepted")
    both = every.select("digest", "seq", "ts", F.lit("request").alias("kind")).unionByName(every.where("ended is not null").select("digest", "seq", F.col("ended").alias("ts"), F.lit("end").alias("kind")))

    def build(s):
        return streams.exact_duplicate_guard(s.where("kind = 'request'"), 60, KEEP, s.where("kind = 'end'"))

    # files in time order; equal times stay in one file, as their order within a batch is the rule's
    path = tmp_path / "l"
    for lo, hi in ((0, 10**6 + 1300), (10**6 + 1300, 10**6 + 2600), (10**6 + 2600, 10**7)):
        both.where((F.unix_seconds("ts") >= lo) & (F.unix_seconds("ts") < hi)).coalesce(1).write.mode("append").parquet(str(path))
    source = stream_events(spark, str(path), "digest string, seq long, ts timestamp, kind string", files=1)
    query = build(source).writeStream.format("memory").queryName("leases").option("checkpointLocation", str(path) + "-ckpt").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("leases")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expect.collect()))
    assert expect.where("accepted").count() > sessions.duplicates_in_flight(every.drop("ended"), 60).where("accepted").count()


def test_outcomes_once_after_a_restart(spark, tmp_path):
    """Requests joined with responses as streams, written by batch, stopped and started again: each request once, as in the batch join."""
    base = 1_700_000_000
    asked = [(f"q{i}", base + 30 * i, "/v1/messages") for i in range(40)]
    answered = [(f"q{i}", base + 30 * i + 5 + i % 3, 200 + i % 2) for i in range(40) if i % 4]
    requests = spark.createDataFrame(asked, "request_id string, s long, path string").withColumn("ts", F.timestamp_seconds("s"))
    responses = spark.createDataFrame(answered, "request_id string, s long, status int").withColumn("ts", F.timestamp_seconds("s"))
    seen = []

    def run(lo, hi):
        for df, name in ((requests, "q"), (responses, "a")):
            df.where((F.col("s") >= lo) & (F.col("s") < hi)).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        left = stream_events(spark, str(tmp_path / "q"), "request_id string, path string, ts timestamp", files=1)
        right = stream_events(spark, str(tmp_path / "a"), "request_id string, status int, ts timestamp", files=1)
        joined = streams.outcome_stream(left, right, "5 minutes", "1 minute")
        query = streams.write_batches(joined, str(tmp_path / "out"), str(tmp_path / "ckpt"), on_result=lambda rows, number: seen.append(number))
        query.processAllAvailable()
        query.stop()

    run(0, base + 600)
    run(base + 600, base + 10_000)
    late = spark.createDataFrame([("later", base + 100_000, "/x")], "request_id string, s long, path string").withColumn("ts", F.timestamp_seconds("s"))
    requests = requests.unionByName(late)
    responses = responses.unionByName(spark.createDataFrame([("no one", base + 100_000, 200)], "request_id string, s long, status int").withColumn("ts", F.timestamp_seconds("s")))
    run(base + 10_000, base + 200_000)  # moves both watermarks past all that waits
    got = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out")).select("request_id", "status").where("request_id <> 'later'")
    expect = usage.request_outcomes(requests.where("request_id <> 'later'").select("request_id"), responses.select("request_id", "status"))
    assert sorted(map(str, got.collect())) == sorted(map(str, expect.collect())) and got.count() == 40
    # a batch that is written again replaces its rows
    n = spark.read.parquet(str(tmp_path / "out")).count()
    first = spark.read.parquet(str(tmp_path / "out" / f"batch={min(seen)}"))
    assert len(set(seen)) == len(seen) and n == 40 and first.columns


def test_totals_after_each_batch(spark, tmp_path):
    o = activity.outcomes(spark, SMALL).withColumns({"ts": F.col("ts").cast("timestamp"), "seq": F.col("request_id")}).cache()
    found = {}
    for p in range(3):
        o.where(F.col("seq") % 3 == p).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    source = stream_events(spark, str(tmp_path / "s"), o.schema.simpleString()[7:-1].replace(":", " "), files=1)
    query = streams.summary_stream(source.drop("seq")).writeStream.outputMode("complete").foreachBatch(lambda rows, n: found.update({n: tuple(rows.collect()[0])})).option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    for n in range(3):
        assert found[n] == tuple(usage.run_summary(usage.ledger(o.where(F.col("seq") % 3 <= n).drop("seq"))).collect()[0])
