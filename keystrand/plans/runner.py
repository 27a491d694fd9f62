"""Running a workload against a table, and sampling the table's state meanwhile."""

from __future__ import annotations

import threading
import time

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrand.functions import samplers
from keystrand.functions.bounds import UNBOUNDED
from keystrand.operators import versions
from keystrand.plans import workload
from keystrand.plans.table import KVTable
from keystrand.sources.staging import local_table, stage

_SNAPSHOT = pa.schema([("second_index", pa.int32()), ("l0_files", pa.int32()), ("immutable_q", pa.int32()), ("in_flight_compactions", pa.int64()), ("total_flushes", pa.int64()), ("total_compactions", pa.int64())])
_TIMES = pa.schema([("block", pa.int64()), ("part", pa.string()), ("latency_ns", pa.int64()), ("t_ns", pa.int64())])


class StateSampler:
    """Takes a table's state once an interval in a thread of the driver, from entry to exit."""

    def __init__(self, table: KVTable, interval: float = 1.0) -> None:
        self.table, self.interval = table, interval
        self._rows: list[tuple] = []
        self._stop = threading.Event()

    def __enter__(self) -> StateSampler:
        self._began = time.monotonic()
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._stop.set()
        self._thread.join()

    def _run(self) -> None:
        while True:
            self._rows.append((int(time.monotonic() - self._began), *self.table.state()[:-1]))
            if self._stop.wait(self.interval):
                return

    def snapshots(self) -> DataFrame:
        """The samples so far, with the second each was taken in: the state of ``report.time_series``."""
        return local_table(self.table.spark, _SNAPSHOT, list(self._rows))


def scan_sizes(live: DataFrame, scans: DataFrame) -> DataFrame:
    """(step, rows): how many of the ``live`` keys each scan (step, key, scan_length) returns.

    Keys and starts are sorted together by range; the live keys before a start, counted within its
    partition and over those before, say how many are left from there.  No scan meets the keys it
    returns, so long scans cost no more than short ones."""
    ends = live.select("key", F.lit(1).alias("live"), F.lit(None).cast("long").alias("step"), F.lit(None).cast("long").alias("scan_length"))
    starts = scans.select("key", F.lit(0).alias("live"), "step", F.col("scan_length").cast("long").alias("scan_length"))
    order = ["key", "live", "step"]
    local = F.monotonically_increasing_id()
    dealt = ends.unionByName(starts).repartitionByRange(*order).sortWithinPartitions(*order)
    staged = stage(dealt.withColumn("_part", F.shiftright(local, 33)).withColumn("_at", local))
    offsets, total = [], 0
    for part, n in sorted((r[0], r[1]) for r in staged.groupBy("_part").agg(F.sum("live")).collect()):
        offsets.append((part, total))
        total += n
    table = local_table(live.sparkSession, versions._OFFSETS, offsets)
    before = F.sum("live").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    placed = staged.join(table, "_part").withColumn("_before", F.col("_offset") + before)
    return placed.where("live = 0").select("step", F.least(F.col("scan_length"), F.lit(total) - F.col("_before")).alias("rows"))


def run(table: KVTable, spec: workload.Workload, n: int, seed: int = 42, block: int = 65_536, compact: bool = True) -> DataFrame:
    """Runs n operations of a workload on a table, ``block`` of them at a time, and returns
    (step, kind, key, hit, rows, latency_ns, t_ns) for each.

    Of a block, reads and scans come first, in one job each, then all its writes as one batch in
    order of step; so an operation sees the writes of the blocks before its own.  Updates, inserts
    and read-modify-writes put a new value of the workload's size.  ``hit`` tells of reads and
    read-modify-writes whether the key was there, ``rows`` what a scan returned; else null.  An
    operation's latency is that of its part of the block (a read-modify-write's that of reading and
    writing), t_ns when it ended, counted from the start of the run."""
    spark, began = table.spark, time.monotonic_ns()
    ops = stage(workload.operations(spark, spec, n, seed).withColumn("block", F.floor(F.col("step") / block).cast("long")))
    hits, sizes, times = [], [], []
    for b in range(-(-n // block)):
        own, version = ops.where(F.col("block") == b), table.manifest.load().number

        def timed(part: str, since: int, b: int = b) -> None:
            now = time.monotonic_ns()
            times.append((b, part, now - since, now - began))

        at = time.monotonic_ns()
        reads = own.where(F.col("kind").isin("read", "rmw"))
        found = table.multi_get(reads.select("key").distinct(), version=version).select("key", "hit")
        hits.append(stage(reads.join(found, "key").select("step", "hit")))
        timed("read", at)
        if "scan" in spec.op_mix:
            at = time.monotonic_ns()
            sizes.append(stage(scan_sizes(table.scan(UNBOUNDED, UNBOUNDED, None, version=version), own.where("kind = 'scan'"))))
            timed("scan", at)
        at = time.monotonic_ns()
        writes = own.where(F.col("kind").isin("update", "insert", "rmw"))
        rows = writes.repartitionByRange("step").sortWithinPartitions("step").select("key", samplers.value_bytes(F.col("step") + spec.keys, spec.value_size, seed).alias("value"))
        table.put_batch(rows)
        timed("write", at)
        if compact:
            table.compact()
    told = versions.merge_runs(hits)
    out = ops.join(told, "step", "left")
    out = out.join(versions.merge_runs(sizes), "step", "left") if sizes else out.withColumn("rows", F.lit(None).cast("long"))
    part = F.when(F.col("kind").isin("read", "scan"), F.col("kind")).otherwise("write")
    clock = local_table(spark, _TIMES, times)
    first = clock.where("part = 'read'").select("block", F.col("latency_ns").alias("_read"))
    timed_ops = out.withColumn("part", part).join(clock, ["block", "part"]).join(first, "block")
    latency = F.col("latency_ns") + F.when(F.col("kind") == "rmw", F.col("_read")).otherwise(0)
    return timed_ops.select("step", "kind", "key", "hit", "rows", latency.alias("latency_ns"), "t_ns")
