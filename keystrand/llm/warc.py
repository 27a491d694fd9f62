"""WARC archives and their index, merged from sorted capture runs.

Tasks write archives of gzip members, one per record, to the shared folder; a manifest written
by Spark names those of the attempts that were committed.  Each archive, read back, gives a
locally sorted run of captures; ranges of URL key and timestamp are dealt over tasks, and in each
a loser tree merges its parts of all runs, so that the histories are globally ordered.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime, timedelta
from typing import Any
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

# The alphabet of base32 and the profile of revisits (WARC 1.1).
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
ARCHIVE_BYTES = 64 << 20
#: Captures that a task of the merge gets, about; it holds their columns and a window of each run.
RANGE_ROWS = 250_000
WINDOW = 256


def payload_digest(payload: Column) -> Column:
    """Base32 SHA-1 of a string's UTF-8 bytes: 40 bits at a time through base 32 digits."""
    raw = F.sha1(payload.cast("binary"))
    parts = [F.translate(F.lpad(F.conv(F.substring(raw, 1 + 10 * k, 10), 16, 32), 8, "0"), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32) for k in range(4)]
    return F.concat(*parts)


def url_key(url: str) -> str:
    """The URL with its host reversed (com,example,www)/path?query), without scheme and fragment."""
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "").lower()
        port = f":{u.port}" if u.port and (u.scheme, u.port) not in (("http", 80), ("https", 443)) else ""
    except ValueError:
        return url.strip().lower()
    return ",".join(reversed(host.split("."))) + port + ")" + (u.path or "/").lower() + (f"?{u.query.lower()}" if u.query else "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC record.  Where ``first`` names another page, a revisit of it, without the payload."""
    date = (_EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")
    name = lambda i: f"<urn:page:{'' if i is None else i}:{digest}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = first is not None and first != page_id
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}",
            f"WARC-Target-URI: {' '.join((url or f'urn:page:{page_id}').split())}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {name(first)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one record; ValueError where it is malformed."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length differs from its Content-Length")
    return fields, rest[:n]


def capture(raw: bytes) -> tuple[Any, ...]:
    """(url key, date, page_id, record_type, payload_bytes, payload_digest, refers_to) of a record.

    Payloads are checked against their digest."""
    fields, block = parse(raw)
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged payload of {fields['warc-record-id']}")
    page = lambda v: int(v.split(":")[2]) if v and v.split(":")[2] else None
    return url_key(fields["warc-target-uri"]), fields["warc-date"], page(fields["warc-record-id"]), kind, size, digest, page(fields.get("warc-refers-to", ""))


def members(stream: Any) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a stream, one at a time."""
    at, data = 0, stream.read(1 << 20)
    while data:
        unzip, out, used = zlib.decompressobj(31), [], 0
        while not unzip.eof:
            if not data:
                raise ValueError("the archive ends within a record")
            out.append(unzip.decompress(data))
            used += len(data) - len(unzip.unused_data)
            data = unzip.unused_data or (b"" if unzip.eof else stream.read(1 << 20))
        yield at, b"".join(out)
        at += used
        data = data or stream.read(1 << 20)


class Run(Sequence):
    """Captures a to b of a table as sort keys, made for one window at a time."""

    def __init__(self, table: pa.Table, a: int, b: int) -> None:
        self.table, self.a, self.n = table, a, b - a
        self.start, self.window = 0, []

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> tuple:
        if not self.start <= i < self.start + len(self.window):
            self.start = i
            part = self.table.slice(self.a + i, min(WINDOW, self.n - i))
            page = part.column("page_id").to_pylist()
            self.window = list(zip(part.column("url_key").to_pylist(), part.column("captured").to_pylist(), [p is None for p in page], [p or 0 for p in page], part.column("archive").to_pylist(), part.column("at").to_pylist()))
        return self.window[i - self.start]


class LoserTree:
    """Merges k sorted sequences: each step replays one path of log2(k) matches."""

    def __init__(self, runs: Sequence[Sequence[Any]]) -> None:
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._replay(i, start=True)

    def _key(self, i: int) -> Any:
        return self.runs[i][self.at[i]] if self.at[i] < len(self.runs[i]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._key(a), self._key(b)
        return x is not None and (y is None or (x, a) < (y, b))

    def _replay(self, winner: int, start: bool = False) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0 and start:
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, position) in merged order."""
        while self.k and self._key(self.losers[0]) is not None:
            i = self.losers[0]
            yield i, self.at[i]
            self.at[i] += 1
            self._replay(i)


def write(pages: DataFrame, least: int = 0, most_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each page; returns the manifest (archive, records) of committed files.

    Of payloads of at least ``least`` bytes that are equal, the smallest page_id's is a response,
    the others revisit it."""
    target = scratch.new_path(pages.sparkSession, "warc")
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", payload_digest(F.col("payload")))
    long_ = rows.where(F.octet_length("payload") >= least)
    firsts = long_.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = rows.join(firsts, "digest", "left").select("page_id", "url", "payload", "digest", F.when(F.octet_length("payload") >= least, F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, folder = fs.FileSystem.from_uri(target)
        store.create_dir(folder, recursive=True)
        name, out, size, n = "", None, 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for page_id, url, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, size, n = store.open_output_stream(f"{folder}/{name}", compression=None), 0, 0
                raw = gzip.compress(record(page_id, url, payload.encode(), digest, first), 5, mtime=0)
                out.write(raw)
                size, n = size + len(raw), n + 1
                if size >= most_bytes:
                    out.close()
                    done.append((name, n))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([f"{target}/{x[0]}" for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["archive", "records"])

    return scratch.table(scratch.map_arrow(rows, run, "archive string, records long"), "manifest")


_INDEX = "archive string, at long, url_key string, captured string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def index_runs(manifest: DataFrame) -> DataFrame:
    """The captures of each archive, sorted by URL key, date and page_id: one run per archive."""
    names = [x.split()[0] for x in _INDEX.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.string() for x in _INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for archive, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, path = fs.FileSystem.from_uri(archive)
                with store.open_input_stream(path, compression=None) as stream:
                    rows = [(archive, at, *capture(raw)) for at, raw in members(stream)]
                if len(rows) != records:
                    raise ValueError(f"{archive} has {len(rows)} records; {records} were written")
                rows.sort(key=lambda r: (r[2], r[3], r[4] is None, r[4] or 0, r[1]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    files = max(1, manifest.count())
    return scratch.table(scratch.map_arrow(manifest.repartition(files, "archive"), run, _INDEX), "captures")


def merge(runs: DataFrame) -> DataFrame:
    """All captures in global order of URL key, date, page_id (null last), archive and place.

    Ranges of that key, of about RANGE_ROWS captures each, are dealt over tasks, so one URL may
    span several.  A task gets its part of each run and merges these by the loser tree, reading
    each through a window."""
    key = ["url_key", "captured", F.col("page_id").asc_nulls_last(), "archive", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held).combine_chunks() if held else None
        if table is None or not table.num_rows:
            return
        archive = table.column("archive").combine_chunks().dictionary_encode()
        codes = (archive.chunk(0) if isinstance(archive, pa.ChunkedArray) else archive).indices.to_numpy()
        edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
        order: list[int] = []
        for r, i in LoserTree([Run(table, a, b) for a, b in zip(edges, edges[1:])]):
            order.append(edges[r] + i)
            if len(order) == 10_000:
                yield from table.take(pa.array(order, pa.int64())).combine_chunks().to_batches()
                order = []
        if order:
            yield from table.take(pa.array(order, pa.int64())).combine_chunks().to_batches()

    n = max(1, -(-runs.count() // RANGE_ROWS), int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return scratch.map_arrow(runs.repartitionByRange(n, *key).sortWithinPartitions("archive", *key[:3], "at"), run, runs.schema)


def captures(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives, reads them back and merges their index: the capture histories."""
    return merge(index_runs(write(pages)))


def records(pages: DataFrame) -> DataFrame:
    """Query op10: one row per row of ``pages``, from the archives.

    page_id, payload_bytes, payload_digest, record_type, refers_to.  A null html is an empty
    payload, a null url is written as urn:page:ID; rows that repeat a page_id with an equal
    payload are all responses if it is the smallest; a null page_id is never the smallest; an
    empty table gives no archives and no rows.
    """
    return captures(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, COALESCE(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS hx FROM p),
r AS (SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}', 1 + CAST(
      (CAST('0x' || substr(hx, CAST(1 + 10 * (i // 8) AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY hx) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM r
"""
