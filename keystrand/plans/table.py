"""A persistent versioned table: sorted Parquet runs under a manifest.

Executors write and read all data; the driver handles the manifest alone.  Every read works on one
manifest version and the sequence numbers up to that version's last.
"""

from __future__ import annotations

import threading
import time
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrand.errors import BadKey, Expired, Stalled
from keystrand.functions.bounds import UNBOUNDED, Bound, in_range, included
from keystrand.operators import compaction, versions
from keystrand.schema import DELETE, LOG, MAX_KEY_BYTES, MAX_SEQ, PUT, entry_bytes
from keystrand.sources.manifest import FileMeta, Manifest, Version
from keystrand.sources.staging import local_table, stage

#: Expected distinct keys of a file, for its bloom filter.
BLOOM_KEYS = 1_000_000
#: A file that no version holds is taken for abandoned after so many seconds.
ORPHAN_SECONDS = 24 * 3600.0
#: So many probed keys reach the scans as a list, where statistics and bloom filters skip row groups.
LISTED_PROBES = 10
_RUN = T.StructType([T.StructField("key", T.StringType()), T.StructField("rel", T.LongType()), T.StructField("op", T.ByteType()), T.StructField("value", T.BinaryType())])

_BASES = pa.schema([("_run", pa.string()), ("_base", pa.int64())])


class Gauge:
    """How many of something are under way in this process."""

    def __init__(self) -> None:
        self.value, self._lock = 0, threading.Lock()

    @contextmanager
    def one(self) -> Iterator[None]:
        with self._lock:
            self.value += 1
        try:
            yield
        finally:
            with self._lock:
                self.value -= 1


class KVTable:
    """put, get, delete and scan over batches; open a table by its folder."""

    def __init__(self, spark: SparkSession, root: str, level_zero_files: int = compaction.LEVEL_ZERO_FILES, output_bytes: int = compaction.OUTPUT_BYTES, max_pending: int | None = None, stall_seconds: float = 5.0) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.manifest = Manifest(spark, self.root)
        self.level_zero_files, self.output_bytes = level_zero_files, output_bytes
        #: Writers wait while so many runs of level 0 aren't compacted (None: never), at most so long.
        self.max_pending, self.stall_seconds = max_pending, stall_seconds
        self.writing, self.merging = Gauge(), Gauge()

    # -- writes ---------------------------------------------------------------

    def put_batch(self, rows: DataFrame, batch_id: str | None = None) -> Version:
        """Upserts rows (key, value).  Of rows with one key the last in the frame's order wins."""
        return self.write_batch(rows.select("key", F.lit(PUT).cast("byte").alias("op"), F.coalesce(F.col("value").cast("binary"), F.unhex(F.lit(""))).alias("value")), batch_id)

    def delete_batch(self, keys: DataFrame, batch_id: str | None = None) -> Version:
        """Deletes keys; those that are absent too."""
        return self.write_batch(keys.select("key", F.lit(DELETE).cast("byte").alias("op"), F.lit(None).cast("binary").alias("value")), batch_id)

    def write_batch(self, rows: DataFrame, batch_id: str | None = None) -> Version:
        """Appends mutations (key, op, value) as one run of level 0, visible all at once.

        A batch whose id the manifest has is skipped, so a replayed batch is harmless."""
        if batch_id is not None and (known := self.manifest.load()).has_batch(batch_id):
            return known
        self.wait_if_stalled()
        with self.writing.one():
            return self._write_batch(rows, batch_id)

    def pending(self) -> int:
        """Runs of level 0, which wait for a compaction."""
        return len({f.path.split("/")[1] for f in self.manifest.load().at_level(0)})

    def is_falling_behind(self) -> bool:
        return self.max_pending is not None and self.pending() >= self.max_pending

    def wait_if_stalled(self) -> None:
        """Returns once compaction has caught up; Stalled if that takes longer than ``stall_seconds``."""
        end = time.monotonic() + self.stall_seconds
        while self.is_falling_behind():
            if time.monotonic() >= end:
                raise Stalled(f"{self.pending()} runs wait for a compaction")
            time.sleep(0.05)

    def _write_batch(self, rows: DataFrame, batch_id: str | None) -> Version:
        local = F.monotonically_increasing_id()
        staged = stage(rows.select("key", "op", "value").withColumn("_part", F.shiftright(local, 33)).withColumn("_at", local.bitwiseAND(F.lit((1 << 33) - 1))))
        bad = staged.where(F.col("key").isNull() | (F.octet_length("key") > MAX_KEY_BYTES)).limit(1).collect()
        if bad:
            raise BadKey("a key is null or longer than 65,535 bytes")
        run = versions.with_offsets(staged).select("key", F.col("n").alias("rel"), "op", "value")
        files = self._write(run, 0)
        count = sum(f.n_rows for f in files)

        def publish(old: Version) -> Version:
            if batch_id is not None and old.has_batch(batch_id):
                return old
            if old.last_seq + count > MAX_SEQ:
                raise OverflowError("sequence numbers are used up")
            own = tuple(replace(f, base_seq=old.last_seq, max_seq=old.last_seq + f.max_seq) for f in files)
            batches = old.batches if batch_id is None else old.with_batch(batch_id)
            return replace(old, files=old.files + own, last_seq=old.last_seq + count, writes=old.writes + count, flushes=old.flushes + bool(files), batches=batches)

        return self.manifest.commit(publish)

    def put(self, key: str, value: bytes) -> Version:
        return self.put_batch(self.spark.createDataFrame([(key, bytearray(value))], "key string, value binary"))

    def delete(self, key: str) -> Version:
        return self.delete_batch(self.spark.createDataFrame([(key,)], "key string"))

    def read_modify_write(self, keys: DataFrame, change: Callable[[Column], Column]) -> Version:
        """Puts ``change`` of each key's current value (null if absent).  Read, then write: not atomic."""
        return self.put_batch(versions.multi_get(self.log(), keys).select("key", change(F.col("value")).alias("value")))

    def _write(self, run: DataFrame, level: int, parts: int | None = None) -> tuple[FileMeta, ...]:
        """Writes (key, rel, op, value) sorted by key, newest first, in files of disjoint ranges."""
        name = uuid.uuid4().hex
        path = f"{self.root}/runs/{name}"
        order = ["key", F.col("rel").desc()]
        dealt = run.repartitionByRange(parts, *order) if parts else run.repartitionByRange(*order)
        dealt.sortWithinPartitions(*order).write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(BLOOM_KEYS)).option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)
        sizes = {k.rsplit("/", 1)[-1]: v for k, v in self.manifest.store.files(f"runs/{name}").items()}
        made = self.spark.read.schema(_RUN).parquet(path).select("key", "rel", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))
        rows = made.groupBy("file").agg(F.min("key"), F.max("key"), F.max("rel"), F.count(F.lit(1))).collect()
        return tuple(FileMeta(f"{name}/{r[0]}", level, f"runs/{name}/{r[0]}", r[1], r[2], 0, r[3], r[4], sizes[r[0]]) for r in sorted(rows, key=lambda r: r[1].encode()))

    # -- reads ----------------------------------------------------------------

    def _read(self, files: Iterable[FileMeta]) -> DataFrame:
        """The log rows of some files in one scan; those of a run count from the run's base."""
        files = list(files)
        if not files:
            return self.spark.createDataFrame([], LOG)
        rows = self.spark.read.schema(_RUN).parquet(*[f"{self.root}/{f.path}" for f in files])
        if len(bases := {f.base_seq for f in files}) == 1:
            return rows.select("key", (F.col("rel") + bases.pop()).alias("seq"), "op", "value")
        table = local_table(self.spark, _BASES, sorted({(f.path.split("/")[1], f.base_seq) for f in files if f.base_seq}))
        placed = rows.withColumn("_run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)).join(table, "_run", "left")
        return placed.select("key", (F.col("rel") + F.coalesce("_base", F.lit(0))).alias("seq"), "op", "value")

    def log(self, start: Bound = UNBOUNDED, end: Bound = UNBOUNDED, version: int | None = None, as_of: int | None = None) -> DataFrame:
        """All versions in a key range at a manifest version, up to a sequence number.

        Files outside the range aren't opened; the range reaches the scans of the others.  Expired
        where a compaction has dropped versions that ``as_of`` needs; an earlier manifest version
        still has them until it is vacuumed."""
        at = self.manifest.load(version)
        return self._at(at, at.in_range(start, end), as_of).where(in_range(F.col("key"), start, end))

    def _at(self, at: Version, files: Iterable[FileMeta], as_of: int | None) -> DataFrame:
        if as_of is not None and as_of < at.merged_seq:
            raise Expired(f"versions up to {at.merged_seq} have been merged; {as_of} can't be read")
        return versions.as_of(self._read(files), at.last_seq if as_of is None else min(as_of, at.last_seq))

    def files_for(self, keys: DataFrame, version: int | None = None) -> list[FileMeta]:
        """The files whose key range holds any of ``keys`` (key).

        The ranges' ends cut the keys into slots; tasks find the slots of their keys and the driver
        gets the distinct ones, at most two for each end."""
        files = self.manifest.load(version).files
        cuts = sorted({k.encode() for f in files for k in (f.smallest_key, f.largest_key)})

        def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ends = np.array(cuts, object)
            for batch in batches:
                found = np.array(batch.column(0).cast(pa.binary()).to_pylist(), object)
                left, right = np.searchsorted(ends, found, "left"), np.searchsorted(ends, found, "right")
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(left + right).astype(np.int64))], ["slot"])

        probed = sorted(r[0] for r in keys.select("key").where("key is not null").mapInArrow(slots, "slot long").distinct().collect()) if files else []
        slot = {c: 2 * i + 1 for i, c in enumerate(cuts)}
        first = lambda f: bisect_left(probed, slot[f.smallest_key.encode()])
        return [f for f in files if first(f) < len(probed) and probed[first(f)] <= slot[f.largest_key.encode()]]

    def get(self, key: str, **snapshot: int | None) -> bytes | None:
        """The value of a key, None if it is absent or deleted; an empty value is b\"\"."""
        rows = versions.get(self.log(included(key), included(key), **snapshot), key).collect()
        return bytes(rows[0]["value"]) if rows else None

    def multi_get(self, keys: DataFrame, **snapshot: int | None) -> DataFrame:
        """(key, hit, value) for each row of ``keys``.  Files whose range holds none of them aren't
        opened, and a short list of keys reaches the scans of the others."""
        probes = stage(keys.select("key"))
        at = self.manifest.load(snapshot.get("version"))
        rows = self._at(at, self.files_for(probes, at.number), snapshot.get("as_of"))
        listed = probes.where("key is not null").distinct().limit(LISTED_PROBES + 1).collect()
        if len(listed) <= LISTED_PROBES:
            rows = rows.where(F.col("key").isin([r[0] for r in listed]))
        return versions.multi_get(rows, probes)

    def scan(self, start: Bound = UNBOUNDED, end: Bound = UNBOUNDED, limit: int | None = 1000, **snapshot: int | None) -> DataFrame:
        """Live rows of a range in key order.  A limit is met from the first files by key where it
        can be: the range is widened, file by file, until enough live keys are found."""
        if limit is None:
            return versions.scan(self.log(start, end, **snapshot), start, end, None)
        at = self.manifest.load(snapshot.get("version"))
        edges = sorted({f.largest_key for f in at.in_range(start, end)}, key=str.encode)
        k = 1
        while k < len(edges) and limit > 0:
            cut = included(edges[k - 1])
            if end.key is not None and cut.key.encode() >= end.key.encode():
                break
            rows = versions.scan(self.log(start, cut, **snapshot), start, cut, limit)
            if sum(f.n_rows for f in at.in_range(start, cut)) >= limit and rows.count() >= limit:
                return rows
            k *= 4
        return versions.scan(self.log(start, end, **snapshot), start, end, limit)

    def history(self, key: str) -> DataFrame:
        return versions.history(self.log(included(key), included(key)), key)

    def state(self) -> tuple[int, int, int, int, int, int]:
        """Files of level 0, batches being written and compactions in flight in this process, and, of
        all, flushes, compactions and writes."""
        at = self.manifest.load()
        return len(at.at_level(0)), self.writing.value, self.merging.value, at.flushes, at.compactions, at.writes

    def stats(self) -> DataFrame:
        """One row of :meth:`state`."""
        return self.spark.createDataFrame([self.state()], "l0_files int, immutable_q int, in_flight_compactions long, total_flushes long, total_compactions long, total_writes long")

    # -- maintenance ----------------------------------------------------------

    def compact(self, force: bool = False) -> Version:
        """Moves levels that are too large down until none is; with ``force`` level 0 at least."""
        at = self.manifest.load()
        level = compaction.level_to_compact(at, self.level_zero_files)
        if level is None and force and at.at_level(0):
            level = 0
        while level is not None and (todo := compaction.plan(at, level)):
            with self.merging.one():
                at = self._merge(todo)
            level = compaction.level_to_compact(at, self.level_zero_files)
        return at

    def _merge(self, todo: compaction.Plan) -> Version:
        log = versions.compacted(self._read(todo.inputs), todo.drop_tombstones)
        kept = stage(log.select("key", F.col("seq").alias("rel"), "op", "value"))
        size = kept.agg(F.coalesce(F.sum(entry_bytes()), F.lit(0))).first()[0]
        made = self._write(kept, todo.level, max(1, -(-size // self.output_bytes))) if size else ()
        gone = {f.file_id for f in todo.inputs}
        merged = max(f.max_seq for f in todo.inputs)

        def publish(old: Version) -> Version:
            if not gone <= {f.file_id for f in old.files}:
                raise RuntimeError("another compaction has taken these files")
            return replace(old, files=tuple(f for f in old.files if f.file_id not in gone) + made, compactions=old.compactions + 1, merged_seq=max(old.merged_seq, merged))

        return self.manifest.commit(publish)

    def vacuum(self, retain: int = 1, in_flight: float = ORPHAN_SECONDS) -> list[str]:
        """Deletes older versions than the last ``retain``, and the files that only they hold.

        Files that no version holds may be a writer's that hasn't published yet; they go once they
        haven't changed for ``in_flight`` seconds."""
        numbers = self.manifest.numbers()
        kept, gone = numbers[-retain:], numbers[:-retain]
        if gone:
            self.manifest.checkpoint(self.manifest.load(kept[0]))
        past = {f.path for v in self.manifest.walk(gone) for f in v.files}
        found = self.manifest.store.modified("runs")
        live = {f.path for v in self.manifest.walk([*kept, *(n for n in self.manifest.numbers() if n not in numbers)]) for f in v.files}
        old = time.time() - in_flight
        removed = [p for p, t in found.items() if not p.rsplit("/", 1)[-1].startswith(("_", ".")) and p not in live and (p in past or t < old)]
        self.manifest.forget(gone)
        for p in removed:
            self.manifest.store.delete(p)
        return removed
