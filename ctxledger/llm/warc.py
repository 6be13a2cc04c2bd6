"""WARC archives of captures, and an external merge of their index.

Writing: each task streams its records, one gzip member each, into archives of
bounded size in a shared folder; a manifest written by Spark names the archives of
the task attempts that succeeded. Reading: Spark's binary file reader hands
archives to tasks, which parse every record and write each archive's captures, sorted
by (URL key, time, record), as a run: a Parquet file of small row groups.

Merging is external. FAN_IN runs at most are merged at once, by as many tasks as their
rows ask for: keys sampled from the runs cut them into ranges, and each task
streams its range of every run through a k-way loser tree, holding one row group a
run. While more than FAN_IN runs are left, the merged ranges are written as pieces of
longer runs and merged again; the last pass returns its rows, whose partitions in
order hold one globally ordered capture history. Nothing is sorted again or shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxledger.llm._work import materialize, shared_dir, table

#: Uncompressed bytes after which an archive is closed.
ARCHIVE = 32 << 20
#: Runs that a task merges at once, rows of a run's row group, rows of a range, and keys that a run's file shows the planner.
FAN_IN, GROUP, RANGE, KEYS = 64, 2000, 1_000_000, 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, then the rest, lower-cased; '' for no url."""
    m = re.match(r"(?s)[^:]*://([^/?#]*)(.*)", url or "")
    if not m:
        return (url or "").lower()
    host = m[1].rpartition("@")[2].partition(":")[0].lower()
    return ",".join(reversed(host.split("."))) + ")" + (m[2].partition("#")[0].lower() or "/")


def _header(text) -> str:
    return str(text).replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url, payload: bytes, digest: str, date: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:capture:{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:capture:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _store(folder: str):
    """(file system, path) of a shared folder, for tasks that read and write files there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _write(folder: str):
    def run(batches):
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        out, name, held, records, made = None, "", 0, 0, []
        for b in batches:
            for page_id, url, html, date, refers_to in zip(*(b.column(c) for c in ("page_id", "url", "html", "date", "refers_to")), strict=True):
                if out is None:
                    name = f"captures-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):04d}.warc.gz"
                    out, held, records = store.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                data = record(page_id.as_py(), url.as_py(), payload, digest, date.as_py(), refers_to.as_py())
                pack = zlib.compressobj(3, zlib.DEFLATED, 31)
                out.write(pack.compress(data) + pack.flush())
                held += len(data)
                records += 1
                if held >= ARCHIVE:
                    out.close()
                    made.append((name, records))
                    out = None
        if out is not None:
            out.close()
            made.append((name, records))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["archive", "records"])

    return run


def write_captures(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html, date string); returns the manifest (archive, records).

    Of rows with equal payloads of ``least`` bytes or more, that with the smallest
    page_id is a response and the others revisit it.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), F.col("date").cast("string"))
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = rows.withColumn("sha", F.unhex(F.sha1(payload)))
    again = rows.where(F.length(payload) >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(again, "sha", "left").withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))
    made = rows.select("page_id", "url", "html", "date", "refers_to").mapInArrow(_write(folder), "archive string, records long")
    return materialize(made, "manifest")


FIELDS = "page_id long, url string, url_key string, captured_at string, record_type string, payload_bytes long, payload_digest string, refers_to long, verified boolean, archive string, offset long, length long"
_NAMES = [x.split()[0] for x in FIELDS.split(", ")]
_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
SCHEMA = pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in FIELDS.split(", ")])


def members(content: bytes):
    """(offset, length, bytes) of each gzip member; a plain file is one member."""
    if content[:2] != b"\x1f\x8b":
        yield 0, len(content), content
        return
    at = 0
    view = memoryview(content)
    while at < len(content):
        unpack = zlib.decompressobj(31)
        parts, pos = [], at
        while not unpack.eof and pos < len(content):
            parts.append(unpack.decompress(view[pos : pos + (1 << 16)]))
            pos += 1 << 16
        end = min(pos, len(content)) - len(unpack.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def parse(data: bytes):
    """(headers, block) of the records in a member."""
    at = 0
    while data.startswith(b"WARC/", at):
        end = data.index(b"\r\n\r\n", at)
        headers = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        size = int(headers.get("content-length", 0))
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 8 + size


def _number(urn: str | None):
    m = re.search(r":(-?\d+)>$", urn or "")
    return int(m[1]) if m else None


def _capture(headers, block, archive, offset, length):
    head, _, payload = block.partition(b"\r\n\r\n")
    kind = headers.get("warc-type")
    m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)
    said = headers.get("warc-payload-digest", "").partition(":")[2]
    url = headers.get("warc-target-uri")
    if kind == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        size = len(payload)
    else:
        digest, size = said, int(m[1]) if m else 0
    return (_number(headers.get("warc-record-id")), url, url_key(url), headers.get("warc-date"), kind, size, digest, _number(headers.get("warc-refers-to")), digest == said, archive, offset, length)


def _captures(batches):
    """Each archive's captures as (name, rows)."""
    for b in batches:
        for path, content in zip(b.column("path"), b.column("content"), strict=True):
            name = path.as_py().rpartition("/")[2]
            yield name, [_capture(h, block, name, at, n) for at, n, data in members(content.as_py()) for h, block in parse(data) if h.get("warc-type") in ("response", "revisit")]


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


def _parsed(batches):
    for _, rows in _captures(batches):
        if rows:
            yield _batch(rows)


def _order(row):
    """URL key, time, record; nulls first."""
    return (row[2] or "", row[3] or "", row[0] is not None, row[0] or 0, row[9], row[10])


class LoserTree:
    """Merges k sorted iterators: each step replays one path of k's losers, log2(k) comparisons."""

    def __init__(self, runs, key):
        self.runs = [iter(r) for r in runs]
        self.key = key
        k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * max(1, k)
        for i in range(k):
            self._replay(i, building=True)

    def _wins(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; an ended run loses, ties go to the earlier run."""
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _replay(self, winner: int, building: bool = False) -> None:
        node = (winner + len(self.runs)) // 2
        while node > 0:
            other = self.losers[node]
            if other == -1 and building:
                self.losers[node] = winner
                return
            if other != -1 and self._wins(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.runs:
            best = self.losers[0]
            head = self.heads[best]
            if head is None:
                return
            yield head
            self.heads[best] = next(self.runs[best], None)
            self.keys[best] = None if self.heads[best] is None else self.key(self.heads[best])
            self._replay(best)


#: A file of a run: the run's number, the file's place in it, path, rows, and KEYS of its sort keys as JSON, from the first to the last.
PIECES = "run long, place int, path string, rows long, keys string"


class _File:
    """A piece of a run while it is written: row groups of GROUP rows, and a sample of its keys."""

    def __init__(self, store, path: str):
        import pyarrow.parquet as pq

        self.path, self.rows, self.held, self.keys, self.last = path, 0, [], [], None
        self.out = pq.ParquetWriter(path, SCHEMA, filesystem=store)

    def add(self, row) -> None:
        self.held.append(row)
        self.rows += 1
        if len(self.held) == GROUP:
            self._hand()

    def _hand(self) -> None:
        self.keys += [_order(self.held[i]) for i in sorted({0, len(self.held) // 2})]
        if len(self.keys) > 4 * KEYS:
            self.keys = self.keys[::2]
        self.last = _order(self.held[-1])
        self.out.write_batch(_batch(self.held))
        self.held = []

    def close(self, run: int, place: int) -> tuple:
        if self.held:
            self._hand()
        self.out.close()
        step = max(1, len(self.keys) // KEYS)
        return run, place, self.path, self.rows, json.dumps([*self.keys[::step], self.last])


def _pieces(made: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in PIECES.split(", ")])


def _write_runs(folder: str):
    def run(batches):
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        for name, rows in _captures(batches):
            rows.sort(key=_order)
            if rows:
                file = _File(store, f"{base}/run-{uuid.uuid4().hex}.parquet")
                for row in rows:
                    file.add(row)
                yield _pieces([file.close(int(hashlib.md5(name.encode()).hexdigest()[:15], 16), 0)])

    return run


def _slice(store, files: list, lo, hi):
    """The rows of a run from key ``lo`` on and before ``hi`` (None: no bound), one row group at a time."""
    import pyarrow.parquet as pq

    for path, first, last in files:
        if (lo is not None and last < lo) or (hi is not None and first >= hi):
            continue
        with store.open_input_file(path) as source:
            file = pq.ParquetFile(source)
            at = SCHEMA.get_field_index("url_key")
            for g in range(file.num_row_groups):
                known = file.metadata.row_group(g).column(at).statistics
                if known is not None and known.has_min_max and lo is not None and known.max < lo[0]:
                    continue
                for row in zip(*(c.to_pylist() for c in file.read_row_group(g).columns), strict=True):
                    key = _order(row)
                    if hi is not None and key >= hi:
                        return
                    if lo is None or key >= lo:
                        yield row


def _merged(plan, folder: str, task: int):
    """(group, range, rows) of a task of a pass: its range of the group's runs, merged by a loser tree."""
    group, place = plan["tasks"][task]
    runs, cuts = plan["groups"][group]
    store, _ = _store(folder)
    lo, hi = cuts[place - 1] if place else None, cuts[place] if place < len(cuts) else None
    return group, place, LoserTree([_slice(store, files, lo, hi) for files in runs], _order)


def _merge_rows(model, folder: str):
    def run(batches):
        for b in batches:
            for task in b.column("id").to_pylist():
                held = []
                for row in _merged(model.value, folder, task)[2]:
                    held.append(row)
                    if len(held) == GROUP:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    return run


def _merge_files(model, folder: str):
    def run(batches):
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        for b in batches:
            for task in b.column("id").to_pylist():
                group, place, rows = _merged(model.value, folder, task)
                file = None
                for row in rows:
                    file = file or _File(store, f"{base}/run-{uuid.uuid4().hex}.parquet")
                    file.add(row)
                yield _pieces([file.close(group, place)] if file else [])

    return run


def _planned(pieces: list, least: int) -> dict:
    """A pass over runs: groups of FAN_IN runs, the keys that cut each group into ranges (``least`` or more if its rows allow), and a task for each range of each group."""
    runs: dict[int, list] = {}
    for r in sorted(pieces, key=lambda r: (r["run"], r["place"])):
        keys = [tuple(k) for k in json.loads(r["keys"])]
        runs.setdefault(r["run"], []).append((r["path"], keys[0], keys[-1], r["rows"], keys))
    names = sorted(runs, key=lambda r: runs[r][0][1])
    groups, tasks = [], []
    for g in range(0, len(names), FAN_IN):
        mine = [runs[n] for n in names[g : g + FAN_IN]]
        rows = sum(f[3] for files in mine for f in files)
        keys = sorted(k for files in mine for f in files for k in f[4])
        ranges = max(1, min(max(-(-rows // RANGE), min(least, rows // GROUP)), len(keys) // 2))
        cuts = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)})
        tasks += [(len(groups), i) for i in range(len(cuts) + 1)]
        groups.append(([[f[:3] for f in files] for files in mine], cuts))
    return {"groups": groups, "tasks": tasks}


def read_captures(spark, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """One row per response or revisit record under ``folder``.

    With a manifest only the archives it names are read. Columns: ``FIELDS``;
    payload_bytes and payload_digest are those of the full payload (a revisit's are
    as its header states), verified says whether a response's payload has the
    digest its header states.
    """
    return _archives(spark, folder, manifest).mapInArrow(_parsed, FIELDS)


def _archives(spark, folder: str, manifest: DataFrame | None) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", "content")
    if manifest is None:
        return files
    return files.join(manifest.select(F.col("archive").alias("name")).distinct(), F.substring_index("path", "/", -1) == F.col("name"), "left_semi")


def index_runs(spark, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """Write each archive's captures under ``folder`` as a sorted run; returns the runs' files (``PIECES``)."""
    return materialize(_archives(spark, folder, manifest).mapInArrow(_write_runs(shared_dir(spark, "runs")), PIECES), "pieces")


def merge_index(runs: DataFrame) -> DataFrame:
    """The captures of all ``runs`` (``PIECES``) in global order of URL key, time and record (partitions in order).

    A URL key with very many captures is cut between tasks, since time and record are
    part of the range key; records that tie keep the order of archive and offset. The
    driver sees a row a file, with a few of its keys, never captures.
    """
    spark = runs.sparkSession
    while True:
        plan = _planned(runs.collect(), spark.sparkContext.defaultParallelism)
        if not plan["tasks"]:
            return spark.createDataFrame([], FIELDS)
        work = spark.range(0, len(plan["tasks"]), 1, len(plan["tasks"]))
        folder = shared_dir(spark, "runs")
        model = spark.sparkContext.broadcast(plan)
        if len(plan["groups"]) == 1:
            return work.mapInArrow(_merge_rows(model, folder), FIELDS)
        runs = materialize(work.mapInArrow(_merge_files(model, folder), PIECES), "pieces")


def archive_pages(pages: DataFrame, least: int = 0, date: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives, read them back, merge their index.

    One row per row of pages, columns ``FIELDS``. A null html is an empty payload; a
    null url has no target; a null page_id stays null and, where copies exist, refers
    to the smallest id. Rows with the smallest page_id repeated are all responses.
    ``date`` names a column of WARC dates; without it, and where it is null, a record is
    dated from its page_id, one second apart. Other columns are ignored, whatever
    their names; an empty table gives no rows.
    """
    spark = pages.sparkSession
    second = F.coalesce(F.pmod(F.col("page_id").cast("long"), F.lit(3_000_000_000)), F.lit(0))
    dated = F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    dated = dated if date is None else F.coalesce(F.col(date).cast("string"), dated)
    folder = shared_dir(spark, "warc")
    manifest = write_captures(pages.select("page_id", "url", "html", dated.alias("date")), folder, least)
    if not manifest.limit(1).count():
        return spark.createDataFrame([], FIELDS)
    return merge_index(index_runs(spark, folder, manifest))


def op1_loser_tree_warc(spark, sf_dir):
    out = archive_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (
  SELECT hex, min(page_id) AS first_id FROM p GROUP BY hex
), d AS (
  SELECT hex, first_id,
         list_aggregate(list_transform(range(40), lambda i: right('000' || bin(strpos('0123456789abcdef', substr(hex, i + 1, 1)) - 1), 4)), 'string_agg', '') AS bits
  FROM f
), b AS (
  SELECT hex, first_id,
         list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + (16 * (substr(bits, 5 * i + 1, 1))::INT + 8 * (substr(bits, 5 * i + 2, 1))::INT + 4 * (substr(bits, 5 * i + 3, 1))::INT
                + 2 * (substr(bits, 5 * i + 4, 1))::INT + (substr(bits, 5 * i + 5, 1))::INT)::INT, 1)), 'string_agg', '') AS digest
  FROM d
)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN b USING (hex)
"""
