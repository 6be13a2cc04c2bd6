"""Per-session cache state, tag churn and cache-prefix attribution, as windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField

from ctxledger.functions.folds import fold
from ctxledger.functions.text import sha8

#: Seconds after which an unobserved cache counts as cold.
IDLE = 3630


def _before(*keys):
    return Window.partitionBy("session").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)


def session_cold(events: DataFrame) -> DataFrame:
    """Each request with cold: whether its session's prompt cache is presumed gone.

    events: session, ts, seq, kind (request, outcome, rejection), cache_read,
    cache_create. Cold means a rejection since the previous request, or, unless the
    newest outcome was alive, that the newest outcome was dead after one was alive,
    or that the newest earlier request is over IDLE seconds back. Outcomes before
    the session's first request or rejection are ignored.
    """
    past = _before("ts", "seq")
    e = events.withColumn("known_session", F.coalesce(F.max(F.col("kind").isin("request", "rejection")).over(past), F.lit(False)))
    alive = (F.col("cache_read") > 0) | (F.col("cache_create") > 0)
    seen = (F.col("kind") == "outcome") & F.col("known_session") & F.col("cache_read").isNotNull()
    e = e.withColumns({
        "alive": F.last(F.when(seen, alive), ignorenulls=True).over(past),
        "ever": F.coalesce(F.max(F.when(seen, alive)).over(past), F.lit(False)),
        "last_request": F.max(F.when(F.col("kind") == "request", F.col("ts"))).over(past),
        "requests": F.sum((F.col("kind") == "request").cast("int")).over(past),
    })
    # requests so far numbers the spells between requests: a rejection in the current spell means dead
    spell = Window.partitionBy("session", "spell")
    e = e.withColumn("spell", F.coalesce("requests", F.lit(0)))
    e = e.withColumn("dead", F.coalesce(F.max(F.col("kind") == "rejection").over(spell), F.lit(False)))
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("last_request").cast("timestamp"))
    idle = F.coalesce(gap > IDLE * 1_000_000, F.lit(False))
    gone = F.coalesce(~F.col("alive") & F.col("ever"), F.lit(False))
    cold = F.col("dead") | (~F.coalesce("alive", F.lit(False)) & (gone | idle))
    return e.where("kind = 'request'").withColumn("cold", cold)


def freeze_floor(events: DataFrame, step: str = "step") -> DataFrame:
    """``events`` plus floor: the largest step of the session so far, this event's included."""
    upto = Window.partitionBy("session").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("floor", F.max(step).over(upto))


def tag_churn(tags: DataFrame) -> DataFrame:
    """``tags`` (session, tag, ts, seq, content) plus changed: content differs from the tag's previous one in its session."""
    order = Window.partitionBy("session", "tag").orderBy("ts", "seq")
    now = tags.withColumn("digest", sha8(F.col("content")))
    return now.withColumn("changed", F.coalesce(F.lag("digest").over(order) != F.col("digest"), F.lit(False)))


def prefix_attribution(requests: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """Digest of each prefix part, of all parts together, and the first part that changed since the session's previous request."""
    order = Window.partitionBy("session").orderBy("ts", "seq")
    out = requests.withColumns({f"{p}_sha8": sha8(F.coalesce(F.col(p), F.lit(""))) for p in parts})
    out = out.withColumn("prefix_sha8", sha8(F.concat_ws("\x00", *(F.coalesce(F.col(p), F.lit("")) for p in parts))))
    first = F.lag("prefix_sha8").over(order).isNull()
    culprit = F.when(first, "first")
    for p in parts:
        culprit = culprit.when(F.lag(f"{p}_sha8").over(order) != F.col(f"{p}_sha8"), p)
    return out.withColumn("changed", culprit.otherwise("none"))


def idle_sessions(events: DataFrame, gap_seconds: int = IDLE) -> DataFrame:
    """Session windows: events of a session closer than the gap."""
    w = F.session_window(F.col("ts").cast("timestamp"), f"{gap_seconds} seconds")
    out = events.groupBy("session", w.alias("w")).agg(F.count("*").alias("events"))
    return out.select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def state_at_request(requests: DataFrame, outcomes: DataFrame, columns: list[str]) -> DataFrame:
    """As-of join: each request with the newest outcome of its session strictly before it, in one window."""
    both = requests.withColumn("_r", F.lit(1)).unionByName(outcomes.withColumn("_r", F.lit(0)), allowMissingColumns=True)
    past = Window.partitionBy("session").orderBy("ts", F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("_r") == 0, F.struct(*columns)), ignorenulls=True).over(past)
    return both.withColumn("state", last).where("_r = 1").drop("_r", *columns)


def duplicates_in_flight(requests: DataFrame, hold_seconds: int = 60) -> DataFrame:
    """``requests`` (digest, ts, seq, and if there ended) plus accepted: false while an accepted equal request is in flight.

    An accepted request holds its digest for ``hold_seconds``, or until its response
    ended (``ended``, a timestamp), if that comes first. The lease runs from the
    accepted request, so the rule is a fold over each digest's requests.
    """
    hold = hold_seconds * 1_000_000

    def rule():
        until = None

        def step(us, ended):
            nonlocal until
            if until is not None and us < until:
                return False
            until = us + hold if ended is None else min(us + hold, max(us, ended))
            return True

        return step

    ended = F.unix_micros(F.col("ended").cast("timestamp")) if "ended" in requests.columns else F.lit(None).cast("long")
    rows = requests.select("digest", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), ended.alias("ended_us"))
    return fold(rows, "digest", ["us", "seq"], rule, ["us", "ended_us"], StructField("accepted", BooleanType())).drop("ended_us")
