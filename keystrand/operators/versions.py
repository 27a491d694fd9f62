"""Reading a mutation log: the newest version of each key decides, and only then do deletes hide.

Every function takes and returns DataFrames of the log's columns and knows nothing of storage.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrand.functions.bounds import UNBOUNDED, Bound, in_range
from keystrand.schema import PUT, entry_bytes
from keystrand.sources.staging import local_table, stage

_OFFSETS = pa.schema([("_part", pa.int64()), ("_offset", pa.int64())])


def newest_per_key(log: DataFrame) -> DataFrame:
    """The version with the highest sequence number of each key, deletes included.

    Ranked by row_number, so each task sends at most one row of a key to the shuffle, however hot
    the key is; a replayed (key, seq) collapses."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("seq").desc()))
    return log.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def live_view(log: DataFrame) -> DataFrame:
    """Current state: newest versions, then only puts (never the other way round)."""
    return newest_per_key(log).where(F.col("op") == PUT)


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The log as it was when ``seq`` was the last sequence number."""
    return log.where(F.col("seq") <= seq)


def history(log: DataFrame, key: str) -> DataFrame:
    """All versions of a key, newest first."""
    return log.where(F.col("key") == key).orderBy(F.col("seq").desc())


def get(log: DataFrame, key: str) -> DataFrame:
    """(key, value), or no row if the key is absent or deleted.  One row per task, no shuffle by key."""
    return log.where(F.col("key") == key).orderBy(F.col("seq").desc()).limit(1).where(F.col("op") == PUT).select("key", "value")


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, hit, value) for each row of ``keys`` (key): a left join that keeps misses.

    The log is cut to the probed keys before it is ranked; which side is sent to all tasks, if
    any, is left to adaptive planning, as both may be large."""
    wanted = keys.select("key").distinct()
    found = live_view(log.join(wanted, "key", "left_semi")).select("key", "value")
    return keys.select("key").join(found.withColumn("_hit", F.lit(True)), "key", "left").select("key", F.coalesce("_hit", F.lit(False)).alias("hit"), "value")


def scan(log: DataFrame, start: Bound = UNBOUNDED, end: Bound = UNBOUNDED, limit: int | None = 1000) -> DataFrame:
    """Live (key, value) rows of a key range in ascending order, at most ``limit`` (None: all)."""
    rows = live_view(log.where(in_range(F.col("key"), start, end))).select("key", "value").orderBy("key")
    return rows if limit is None else rows.limit(limit)


def tombstones(log: DataFrame) -> DataFrame:
    """Keys whose newest version is a delete, with its sequence number."""
    return newest_per_key(log).where(F.col("op") != PUT).select("key", "seq")


def version_counts(log: DataFrame) -> DataFrame:
    """(key, versions, shadowed, live) per key."""
    live = F.max_by("op", "seq") == PUT
    return log.groupBy("key").agg(F.count(F.lit(1)).alias("versions"), (F.count(F.lit(1)) - 1).alias("shadowed"), live.alias("live"))


def merge_runs(runs: Iterable[DataFrame]) -> DataFrame:
    """All versions of several runs; duplicates stay for the ranking to collapse."""
    return reduce(DataFrame.unionByName, runs)


def ordered(log: DataFrame) -> DataFrame:
    """Internal key order: key ascending, newest version first."""
    return log.orderBy("key", F.col("seq").desc())


def compacted(log: DataFrame, drop_tombstones: bool) -> DataFrame:
    """What a compaction of these runs keeps.  Tombstones may go only if no deeper level holds data."""
    return live_view(log) if drop_tombstones else newest_per_key(log)


def read_modify_write(log: DataFrame, keys: DataFrame, change, base_seq: int) -> DataFrame:
    """New versions for probed keys: ``change`` of the current value (null if absent).

    Sequence numbers follow ``base_seq`` in key order.  Reading and writing aren't one
    transaction; a later writer wins."""
    current = multi_get(log, keys)
    ranked = numbered(current.select("key", change(F.col("value")).alias("value")), ["key"])
    return ranked.select("key", (F.col("n") + base_seq).alias("seq"), F.lit(PUT).cast("byte").alias("op"), "value")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds n = 1, 2, ... in the order of some columns.

    Rows are dealt by range, sorted and staged; each partition's count gives the next one's
    offset, so no task sees all rows."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id()
    staged = stage(dealt.withColumn("_part", F.shiftright(local, 33)).withColumn("_at", local.bitwiseAND(F.lit((1 << 33) - 1))))
    return with_offsets(staged).drop("_part", "_at")


def with_offsets(staged: DataFrame) -> DataFrame:
    """n = offset of the partition (_part) + place there (_at) + 1, for staged rows."""
    counts = sorted((r[0], r[1]) for r in staged.groupBy("_part").count().collect())
    offsets, total = [], 0
    for part, count in counts:
        offsets.append((part, total))
        total += count
    table = local_table(staged.sparkSession, _OFFSETS, offsets)
    return staged.join(table, "_part", "left").withColumn("n", F.col("_offset") + F.col("_at") + 1).drop("_offset")


def buffered_bytes(log: DataFrame) -> DataFrame:
    """One row: the bytes these versions take in a write buffer."""
    return log.agg(F.coalesce(F.sum(entry_bytes()), F.lit(0)).cast("long").alias("n_bytes"))


def range_versions(log: DataFrame, start: Bound = UNBOUNDED, end: Bound = UNBOUNDED) -> DataFrame:
    """All versions of the keys in a range, in internal order."""
    return ordered(log.where(in_range(F.col("key"), start, end)))


def differences(state: DataFrame, other: DataFrame) -> DataFrame:
    """(key, value, side) rows that only one of two states has; none if they are equal."""
    left, right = state.select("key", "value"), other.select("key", "value")
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def values_written(log: DataFrame) -> DataFrame:
    """Distinct (key, value) pairs that were ever put: what a read may return."""
    return log.where(F.col("op") == PUT).select("key", "value").distinct()
