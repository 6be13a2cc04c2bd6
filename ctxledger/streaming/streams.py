"""Streaming forms: outcomes, usage, session state, duplicates, tag churn, ledger windows and totals, idle sessions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ctxledger.operators import usage
from ctxledger.operators.sessions import IDLE


def outcome_stream(requests: DataFrame, responses: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests (request_id, ts, ...) with their responses (request_id, ts, ...; their ts comes as response_ts), one to one; append mode.

    Both sides carry a watermark, so state is dropped: a request waits for a response that
    begins ``within`` its own time and comes ``late`` at most, and then goes out alone.
    """
    left = requests.withWatermark("ts", late).alias("q")
    right = responses.withColumnsRenamed({"ts": "response_ts", "request_id": "_request"}).withWatermark("response_ts", late).alias("a")
    on = F.expr(f"q.request_id = a._request AND a.response_ts >= q.ts AND a.response_ts <= q.ts + INTERVAL {within}")
    return left.join(right, on, "left_outer").drop("_request")


def write_batches(stream: DataFrame, path: str, checkpoint: str, on_result: Callable[[DataFrame, int], DataFrame | None] | None = None, fmt: str = "parquet", mode: str = "append", **trigger) -> StreamingQuery:
    """Start writing ``stream`` under ``path``, each micro-batch into a folder of its own number.

    A batch that runs again after a failure replaces its folder, so each row stays once.
    ``on_result`` (rows, batch number) may hand back other rows to write, or none for the same.
    """

    def write(rows: DataFrame, number: int) -> None:
        changed = on_result(rows, number) if on_result else None
        (rows if changed is None else changed).write.mode("overwrite").format(fmt).save(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()


def usage_events(responses: DataFrame) -> DataFrame:
    """Usage fields event by event of whole responses; stateless."""
    return usage.usage_events(responses)


def summary_stream(outcomes: DataFrame) -> DataFrame:
    """Running totals of as_text and sent and their change in percent; complete mode."""
    return usage.run_summary(usage.ledger(outcomes))


def ledger_stream(outcomes: DataFrame, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Ledger sums by window and model, with a watermark."""
    rows = usage.ledger(outcomes).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window).alias("window"), "model").agg(F.count("*").alias("requests"), F.sum("sent").alias("sent"), F.sum("saved").alias("saved"))


def idle_sessions(events: DataFrame, gap_seconds: int = IDLE, late: str = "10 minutes") -> DataFrame:
    """Session windows that close after a gap."""
    rows = events.withWatermark("ts", late)
    return rows.groupBy("session", F.session_window("ts", f"{gap_seconds} seconds").alias("w")).agg(F.count("*").alias("events"))


def duplicate_guard(requests: DataFrame, hold: str = "60 seconds") -> DataFrame:
    """Requests whose digest was not seen within the watermark: the built-in approximation of the lease rule."""
    return requests.withWatermark("ts", hold).dropDuplicatesWithinWatermark(["digest"])


#: Seconds of event time that a key's state outlives its last event, and how late events may come.
KEEP, LATE = 86_400, "1 hour"


class _Kept(StatefulProcessor):
    """A processor whose state goes when the watermark is ``keep`` seconds past the key's last event (0: never)."""

    keep = KEEP

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def stays(self, us) -> None:
        """Moves the key's timer to ``keep`` seconds after its last event."""
        if self.keep:
            due = int(max(us)) // 1000 + self.keep * 1000
            old = list(self.handle.listTimers())
            if not old or max(old) < due:
                for t in old:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def _keyed(rows: DataFrame, keys: list[str], processor: type, schema: str, keep: int, **fields) -> DataFrame:
    """``processor`` over the groups of a stream with an event time ``ts``."""
    made = type(processor.__name__, (processor,), {"keep": keep, **fields})()
    rows = rows.withColumn("us", F.unix_micros("ts"))
    return rows.groupBy(*keys).transformWithStateInPandas(made, schema, "Append", "EventTime" if keep else "None")


def _timed(events: DataFrame, keep: int) -> DataFrame:
    return events.withWatermark("ts", LATE) if keep else events


class _Usage(_Kept):
    """Usage of a response from fragments of its body; goes out at a clean end, and not without one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("usage", "rest string, sse boolean, ended boolean, " + ", ".join(f"{u} long" for u in usage.USAGE))

    @staticmethod
    def read(event: str, found: list) -> None:
        """Fields of one event: of its message, then its own; what is no whole number hides nothing."""
        try:
            body = json.loads(event)
        except ValueError:
            return
        if not isinstance(body, dict):
            return
        message = body.get("message")
        for holder in (message.get("usage") if isinstance(message, dict) else None, body.get("usage")):
            if isinstance(holder, dict):
                for i, name in enumerate(usage.USAGE):
                    value = holder.get(name)
                    if isinstance(value, int) and not isinstance(value, bool):
                        found[i] = value

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rest, sse, ended, *found = self.state.get() if self.state.exists() else ("", False, False, *[None] * len(usage.USAGE))
        pdf, out = pd.concat(rows).sort_values("seq"), []
        for r in pdf.itertuples():
            if ended:
                break
            rest += r.chunk if isinstance(r.chunk, str) else ""
            last = pd.notna(r.ended) and bool(r.ended)
            whole = rest.split("\n")
            events = [m[1] for m in map(_DATA.match, whole if last else whole[:-1]) if m and m[1]]
            for event in events:
                self.read(event, found)
            sse = sse or bool(events)
            if sse:
                rest = whole[-1]
            if last:
                if not sse:
                    self.read(rest, found)
                ended, rest = True, ""
                out.append((key[0], *found))
        self.state.update((rest, sse, ended, *found))
        self.stays(pdf.us)
        yield pd.DataFrame(out, columns=["response_id", *usage.USAGE]).astype({u: "Int64" for u in usage.USAGE})


_DATA = re.compile(r"data:\s*(.*?)\r?$")


def usage_stream(fragments: DataFrame, keep: int = KEEP) -> DataFrame:
    """(response_id, usage fields) of each response that ends; needs the RocksDB state store.

    fragments: response_id, ts, seq, chunk (a piece of the body, cut anywhere), ended (true
    with the last piece of a response that ended well). The last known value of each field
    counts, a field never seen is null. Within a micro-batch pieces go by seq; a piece that comes after
    the end changes nothing. A response without an end is forgotten ``keep`` seconds
    after its last piece and gives no row. Until its first event line a body is held whole, since it may be JSON.
    """
    rows = _timed(fragments, keep).select("response_id", F.col("seq").cast("long"), "ts", "chunk", "ended")
    return _keyed(rows, ["response_id"], _Usage, f"response_id {dict(fragments.dtypes)['response_id']}, " + ", ".join(f"{u} long" for u in usage.USAGE), keep)


class _Lease(_Kept):
    """Exact lease: a request is a duplicate while the accepted one is younger than the hold and its response has not ended."""

    hold_us = 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("lease", "holder long, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(rows).sort_values(["us", "seq"])
        holder, until = self.state.get() if self.state.exists() else (None, None)
        out = []
        for us, now in pdf.groupby("us", sort=True):
            ends = set(now.seq[now.ends].tolist())
            if holder in ends and until is not None:
                until = min(until, us)
            for seq in now.seq[~now.ends].tolist():
                fresh = until is None or us >= until
                if fresh:
                    holder, until = seq, us if seq in ends else us + self.hold_us
                out.append((key[0], seq, fresh))
        if until is not None:
            self.state.update((int(holder), int(until)))
        self.stays(pdf.us)
        yield pd.DataFrame(out, columns=["digest", "seq", "accepted"])


def exact_duplicate_guard(requests: DataFrame, hold_seconds: int = 60, keep: int = KEEP, ends: DataFrame | None = None) -> DataFrame:
    """(digest, seq, accepted) by the lease rule; needs the RocksDB state store. A digest is forgotten ``keep`` seconds after its last event.

    ``ends`` (digest, seq, ts: when the response of the request of that seq ended) frees a digest
    before its hold is over. Events go by their time within a micro-batch.
    """
    rows = requests.select("digest", F.col("seq").cast("long"), "ts", F.lit(False).alias("ends"))
    if ends is not None:
        rows = rows.unionByName(ends.select("digest", F.col("seq").cast("long"), "ts", F.lit(True).alias("ends")))
    return _keyed(_timed(rows, keep), ["digest"], _Lease, "digest string, seq long, accepted boolean", max(keep, hold_seconds) if keep else 0, hold_us=hold_seconds * 1_000_000)


class SessionState(_Kept):
    """Cache state of a session; gives cold for each request. last_seen never moves back, dead is used up by a request."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("state", "seen long, dead boolean, observed boolean, alive boolean, ever boolean, known boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, dead, observed, alive, ever, known = self.state.get() if self.state.exists() else (-1, False, False, False, False, False)
        out = []
        pdf = pd.concat(rows).sort_values(["us", "seq"])
        for r in pdf.itertuples():
            if r.kind == "request":
                idle = seen >= 0 and r.us - seen > IDLE * 1_000_000
                out.append((key[0], r.seq, bool(dead or not (observed and alive) and (observed and ever or idle))))
                seen, dead, known = max(seen, r.us), False, True
            elif r.kind == "rejection":
                dead = known = True
            elif known and pd.notna(r.cache_read):
                observed, alive = True, bool(r.cache_read > 0 or r.cache_create > 0)
                ever = ever or alive
        self.state.update((int(seen), bool(dead), bool(observed), bool(alive), bool(ever), bool(known)))
        self.stays(pdf.us)
        yield pd.DataFrame(out, columns=["session", "seq", "cold"])


def session_state_stream(events: DataFrame, keep: int = KEEP) -> DataFrame:
    """(session, seq, cold) of each request; needs the RocksDB state store. A session is new again ``keep`` seconds after its last event."""
    rows = _timed(events, keep).select(F.col("session").cast("long"), F.col("seq").cast("long"), "ts", "kind", "cache_read", "cache_create")
    return _keyed(rows, ["session"], SessionState, "session long, seq long, cold boolean", keep)


class _Churn(_Kept):
    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("last", "digest string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(rows).sort_values(["us", "seq"])
        last, out = (self.state.get()[0] if self.state.exists() else None), []
        for digest in pdf.digest:
            out.append(last is not None and digest != last)
            last = digest
        self.state.update((last,))
        self.stays(pdf.us)
        yield pd.DataFrame({"session": key[0], "tag": key[1], "seq": pdf.seq.to_numpy(), "changed": out})


def tag_churn_stream(tags: DataFrame, keep: int = KEEP) -> DataFrame:
    """(session, tag, seq, changed): content differs from the tag's previous one; needs the RocksDB state store. A tag is new again ``keep`` seconds after its last event."""
    rows = _timed(tags, keep).select(F.col("session").cast("long"), "tag", F.col("seq").cast("long"), "ts", F.substring(F.sha2(F.col("content").cast("binary"), 256), 1, 8).alias("digest"))
    return _keyed(rows, ["session", "tag"], _Churn, "session long, tag string, seq long, changed boolean", keep)
