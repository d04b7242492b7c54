"""Web archives: WARC files, their capture index, and its external merge into one global order.

Which pages are revisits is settled first, from digests alone; payloads move at most once, to meet
that list.  Each task streams its pages, in the order they come, into archives (one gzip member for
each record).  Reading goes through each archive from front to back, checks every payload's
digest, and spills sorted runs of index entries (URL key, timestamp, archive, offset ...) of
bounded size, with a sample of each run's keys.  The sample gives the bounds of final key ranges of
about RANGE_ENTRIES entries each.  The runs are then merged in passes: FAN_IN runs become a longer
run, until no more than FAN_IN are left, which give the result.  Every pass works in key ranges, side
by side: FAN_IN final ranges times fewer in each earlier pass, so that a task of any pass merges
about as many entries as another, with a loser tree over one piece of each of at most FAN_IN runs.
A longer run is such pieces, one a range, each with an index of its own.  Runs are numbered by
their random names, so runs of like keys don't meet in one group.  An entry's key ends with its
place, so that one URL with a third of all captures still spreads over ranges.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..naming import exactly
from .loser_tree import LoserTree
from .storage import open_input, persisted, scratch, write_file

LEAST_SHARED = 1000
ARCHIVE_BYTES = 256 << 20
RUN_ENTRIES = 50_000
FAN_IN = 64
BLOCK_ENTRIES = 512
RANGE_ENTRIES = 50_000
#: Sampled keys for each range, and most of them that one task sorts.
SAMPLES = 16
SORTED_AT_ONCE = 1 << 20
MOST_TASKS = 20_000
EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
_MANIFEST = "path string, n_records long"


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels from the last to the first, then path and query, lower-cased."""
    if not url:
        return ""
    try:
        u = urlsplit(url if "//" in url else f"//{url}")
        host, port = (u.hostname or ""), u.port
    except ValueError:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")
    return key.lower()


def timestamp_of(page_id: int | None, seconds: int | None = None) -> str:
    """Capture time from seconds since 1970; a page without gets a second of its own, counted from 2020 by its id."""
    at = EPOCH + timedelta(seconds=(page_id or 0) % 2_000_000_000) if seconds is None else datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=seconds)
    return at.strftime("%Y-%m-%dT%H:%M:%SZ")


def _digest(payload):
    payload = F.coalesce(payload.cast("string"), F.lit("")).cast("binary")
    return F.when(F.octet_length(payload) >= LEAST_SHARED, F.sha2(payload, 256))


def _seconds(time_col: str | None):
    return F.unix_seconds(exactly(time_col).cast("timestamp")) if time_col else F.lit(None).cast("long")


def resolve_revisits(pages: DataFrame, id_col: str, payload_col: str, time_col: str | None = None) -> DataFrame:
    """Revisits: id, digest, and the id of the page whose equal payload is kept (response) with its capture time (response_at).

    Only digests, ids and times move.  Of rows with equal payloads the largest id is the response (rows that
    repeat that id are all responses).  Payloads under 1000 bytes are never shared; a null id never refers.
    """
    digests = pages.select(exactly(id_col).cast("long").alias("id"), _digest(exactly(payload_col)).alias("digest"), _seconds(time_col).alias("at")).filter("digest is not null and id is not null")
    shared = digests.groupBy("digest").agg(F.max(F.struct(F.col("id").alias("response"), F.col("at").alias("response_at"))).alias("kept"), F.count("*").alias("n")).filter("n > 1").select("digest", "kept.*")
    return digests.join(shared, "digest").filter("id < response").select("id", "digest", "response", "response_at").distinct()


class ArchiveWriter:
    """Appends records, each a gzip member of its own."""

    def __init__(self, out):
        self.out, self.at, self.n = out, 0, 0

    def add(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, at: int | None = None, refers_at: int | None = None) -> None:
        digest = b32encode(hashlib.sha1(payload).digest()).decode()
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
        block = http if refers_to is not None else http + payload
        name = json.dumps(page_id)
        head = [
            "WARC/1.1",
            f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {_record_id(page_id, digest)}",
            f"WARC-Date: {timestamp_of(page_id, at)}",
            *([f"WARC-Target-URI: {_header(url)}"] if url else []),
            f"WARC-Payload-Digest: sha1:{digest}",
            f"WARC-Page-ID: {name}",
            f"WARC-Payload-Length: {len(payload)}",
        ]
        if refers_to is not None:
            head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}", f"WARC-Refers-To-Date: {timestamp_of(refers_to, refers_at)}", "WARC-Truncated: length"]
        head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
        data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
        member = gzip.compress(data, compresslevel=4, mtime=0)
        self.out.write(member)
        self.at += len(member)
        self.n += 1


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def _header(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


class _Members:
    """The gzip members of a stream, one by one."""

    def __init__(self, source):
        self.source, self.held, self.at = source, b"", 0

    def __iter__(self) -> Iterator[tuple[int, int, bytes]]:
        while True:
            out, used, d = [], 0, zlib.decompressobj(31)
            while not d.eof:
                data = self.held or self.source.read(1 << 20)
                self.held = b""
                if not data:
                    if used:
                        raise ValueError("an archive ends inside of a record")
                    return
                out.append(d.decompress(data))
                used += len(data)
            self.held = d.unused_data
            used -= len(self.held)
            yield self.at, used, b"".join(out)
            self.at += used


def read_archive(source) -> Iterator[dict]:
    """Records of an archive: headers, offset, stored bytes, and the payload of responses (checked against its digest)."""
    for at, size, data in _Members(source):
        end = data.index(b"\r\n\r\n")
        lines = data[:end].decode().split("\r\n")
        head = {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:])}
        block = data[end + 4 : end + 4 + int(head["content-length"])]
        payload = block[block.index(b"\r\n\r\n") + 4 :] if head["warc-type"] == "response" else None
        digest = b32decode(head["warc-payload-digest"].removeprefix("sha1:"))
        if payload is not None and (hashlib.sha1(payload).digest() != digest or len(payload) != int(head["warc-payload-length"])):
            raise ValueError(f"record at {at}: payload differs from its digest")
        yield {"head": head, "at": at, "size": size, "payload": payload, "digest": digest.hex()}


def write_archives(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None) -> DataFrame:
    """Writes archives below the shared folder; returns their manifest (path, n_records).

    A null or empty page has an empty payload; a null URL has no target; a null id is written as
    null.  time_col is the capture time; without it, or where it is null, timestamp_of gives one.
    Repeated rows are records of their own.  Very long payloads are written whole, one in memory at a
    time; ids are cast to long, and what can't be fails.  Other columns aren't read.
    """
    root = scratch(pages.sparkSession, "warc")
    revisits = resolve_revisits(pages, id_col, payload_col, time_col)
    rows = pages.select(exactly(id_col).cast("long").alias("id"), exactly(url_col).cast("string").alias("url"), F.coalesce(exactly(payload_col).cast("string"), F.lit("")).alias("payload"), _seconds(time_col).alias("at"))
    rows = rows.withColumn("digest", _digest(F.col("payload"))).join(revisits, ["id", "digest"], "left").select("id", "url", "payload", F.col("response").alias("refers_to"), "at", "response_at")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = (r for b in batches for r in zip(b["id"].to_pylist(), b["url"].to_pylist(), b["payload"], *(b[c].to_pylist() for c in ("refers_to", "at", "response_at")), strict=True))
        row = next(waiting, None)
        while row is not None:
            path, count = f"{root}/{uuid.uuid4().hex}.warc.gz", 0

            def fill(out) -> None:
                nonlocal row, count
                w = ArchiveWriter(out)
                while row is not None and w.at < ARCHIVE_BYTES:
                    w.add(row[0], row[1], row[2].as_buffer().to_pybytes(), *row[3:])
                    row = next(waiting, None)
                count = w.n

            write_file(path, fill)
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([count], pa.int64())})

    return persisted(rows.mapInArrow(write, _MANIFEST), "warc-manifest")


# An entry: (URL key, timestamp, archive, offset, rest); rest is a tuple of what else is known.
def _entry(path: str, r: dict) -> tuple:
    head = r["head"]
    refers = head.get("warc-refers-to-page-id")
    return (url_key(head.get("warc-target-uri")), head["warc-date"], path, r["at"], (json.loads(head["warc-page-id"]), r["size"], int(head["warc-payload-length"]), r["digest"], head["warc-type"], None if refers is None else int(refers)))


def _write_run(path: str, entries: Iterator[tuple]) -> int:
    """A run, or a piece of one: compressed blocks of JSON lines, an index of each block's first key and place, and the index's length.  Returns the entry count."""
    n, index = 0, []

    def fill(out) -> None:
        nonlocal n
        at, block = 0, []

        def flush() -> None:
            nonlocal at, block
            data = zlib.compress("\n".join(json.dumps(e, ensure_ascii=False) for e in block).encode(), 1)
            out.write(data)
            index.append((block[0][:4], at, len(data)))
            at, block = at + len(data), []

        for e in entries:
            block.append(e)
            n += 1
            if len(block) == BLOCK_ENTRIES:
                flush()
        if block:
            flush()
        tail = zlib.compress(json.dumps(index).encode())
        out.write(tail + len(tail).to_bytes(8, "little"))

    write_file(path, fill)
    return n


def read_run(path: str, low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple]:
    """Entries of a run with low <= key < high."""
    with open_input(path) as f:
        end = f.seek(0, 2)
        f.seek(end - 8)
        size = int.from_bytes(f.read(8), "little")
        f.seek(end - 8 - size)
        index = [(tuple(k), at, n) for k, at, n in json.loads(zlib.decompress(f.read(size)))]
        for i, (first, at, n) in enumerate(index):
            if high is not None and first >= high:
                return
            if low is not None and i + 1 < len(index) and index[i + 1][0] < low:
                continue
            f.seek(at)
            for line in zlib.decompress(f.read(n)).decode().split("\n"):
                e = json.loads(line)
                key = tuple(e[:4])
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield (*key, tuple(e[4]))


_KEY = "struct<key: string, at: string, archive: string, offset: long>"
_KEY_TYPE = pa.struct([("key", pa.string()), ("at", pa.string()), ("archive", pa.string()), ("offset", pa.int64())])


def index_archives(manifest: DataFrame) -> DataFrame:
    """Reads all archives; writes sorted runs of index entries and returns their list: run, n, sample (of the keys, one in RANGE_ENTRIES / SAMPLES)."""
    root, step = scratch(manifest.sparkSession, "runs"), max(1, RANGE_ENTRIES // SAMPLES)
    most = RUN_ENTRIES

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b["path"].to_pylist()):
            with open_input(path) as f:
                held = []
                for r in read_archive(f):
                    held.append(_entry(path, r))
                    if len(held) == most:
                        yield spill(held)
                        held = []
                if held:
                    yield spill(held)

    def spill(held: list[tuple]) -> pa.RecordBatch:
        name = uuid.uuid4()
        run = f"{root}/{name.hex}.run"
        held.sort()
        keys = [dict(zip(("key", "at", "archive", "offset"), e[:4], strict=True)) for e in held[name.int % step :: step]]  # begins anywhere, so short runs count as they should
        return pa.RecordBatch.from_pydict({"run": [run], "n": pa.array([_write_run(run, iter(held))], pa.int64()), "sample": pa.array([keys], pa.list_(_KEY_TYPE))})

    tasks = max(1, min(manifest.count(), MOST_TASKS))
    return persisted(manifest.select("path").repartition(tasks).mapInArrow(index, f"run string, n long, sample array<{_KEY}>"), "runs")


def _range_bounds(runs: DataFrame) -> DataFrame:
    """First keys of all final ranges but the first: no (from 1 on), bound."""
    keys = runs.select(F.explode("sample").alias("bound"))
    tasks = -(-keys.count() // SORTED_AT_ONCE)
    dealt = keys.repartitionByRange(tasks, "bound") if tasks > 1 else keys.coalesce(1)
    place = F.row_number().over(Window.partitionBy("p").orderBy("bound"))
    every = dealt.withColumn("p", F.spark_partition_id()).withColumn("place", place).filter(F.col("place") % SAMPLES == 0).select("bound")
    # one row for each final range: RANGE_ENTRIES times fewer than captures
    return persisted(every.distinct().withColumn("no", F.row_number().over(Window.orderBy("bound"))), "bounds")


_CAPTURE = pa.schema(
    [("part", pa.int32()), ("url_key", pa.string()), ("timestamp", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("stored_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def _merges(pieces: DataFrame, bounds: DataFrame, ranges: int, step: int, wider: int) -> DataFrame:
    """A row for each merge of a pass, whose ranges are step final ones: g, j, low, high, paths (a piece of each of at most FAN_IN runs).

    pieces: no, j (range of the pass before, which was wider times as wide), path.
    """
    n = -(-ranges // step)
    last = F.least((F.col("j") + 1) * wider, F.lit(n)) - 1
    tasks = pieces.select("path", F.floor(F.col("no") / FAN_IN).alias("g"), F.explode(F.sequence(F.col("j") * wider, last)).alias("j"))
    low = bounds.select((F.col("no") / step).cast("long").alias("j"), F.col("bound").alias("low"), (F.col("no") % step).alias("r")).filter("r = 0").drop("r")
    high = low.select((F.col("j") - 1).alias("j"), F.col("low").alias("high"))
    grouped = tasks.groupBy("g", "j").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return grouped.join(low, "j", "left").join(high, "j", "left").select("g", "j", "low", "high", "paths")


def _opened(row: dict) -> LoserTree:
    low, high = (None if row[k] is None else tuple(row[k][c] for c in ("key", "at", "archive", "offset")) for k in ("low", "high"))
    return LoserTree([read_run(p, low, high) for p in row["paths"]])


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in order of URL key, timestamp and place: by part, then as they come in it.  Nothing goes to the driver but counts."""
    bounds = _range_bounds(runs)
    ranges, k = bounds.count() + 1, runs.count()
    passes, left = 0, k
    while left > FAN_IN:
        passes, left = passes + 1, -(-left // FAN_IN)
    pieces = runs.select((F.row_number().over(Window.orderBy("run")) - 1).cast("long").alias("no"), F.lit(0).cast("long").alias("j"), F.col("run").alias("path"))
    wider = -(-ranges // FAN_IN**passes)  # the first pass finds whole runs
    for p in range(passes, 0, -1):
        root, k = scratch(runs.sparkSession, "runs"), -(-k // FAN_IN)

        def write(batches: Iterator[pa.RecordBatch], root: str = root) -> Iterator[pa.RecordBatch]:
            for row in (r for b in batches for r in b.to_pylist()):
                path = f"{root}/{uuid.uuid4().hex}.run"
                n = _write_run(path, iter(_opened(row)))
                yield pa.RecordBatch.from_pydict({"no": pa.array([row["g"]], pa.int64()), "j": pa.array([row["j"]], pa.int64()), "path": [path], "n": pa.array([n], pa.int64())})

        step = FAN_IN**p
        merges = _merges(pieces, bounds, ranges, step, wider)
        written = persisted(merges.repartition(min(MOST_TASKS, k * -(-ranges // step)), "g", "j").mapInArrow(write, "no long, j long, path string, n long"), "runs")
        pieces, wider = written.filter("n > 0").drop("n"), FAN_IN

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            held = []
            for e in _opened(row):
                held.append((row["j"], *e[:4], *e[4]))
                if len(held) == 8192:
                    yield _captures(held)
                    held = []
            if held:
                yield _captures(held)

    dealt = _merges(pieces, bounds, ranges, 1, wider).repartition(min(MOST_TASKS, ranges), "j")
    return dealt.mapInArrow(merge, "part int, url_key string, timestamp string, archive string, offset long, page_id long, stored_bytes long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _captures(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _CAPTURE, strict=True)], schema=_CAPTURE)


def capture_history(pages: DataFrame, **columns: str) -> DataFrame:
    """Writes pages as archives, reads these back and merges their index; one row for each page.  No pages: no rows."""
    return merge_runs(index_archives(write_archives(pages, **columns)))
