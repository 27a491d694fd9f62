"""Relations over files and levels: summaries, overlap, compaction choices, greedy splits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrand.functions.bounds import overlaps
from keystrand.schema import LEVELS, entry_bytes


def summaries(log: DataFrame, file: Column) -> DataFrame:
    """Smallest and largest key, highest sequence number, rows and bytes of each file."""
    return log.groupBy(file.alias("file_id")).agg(F.min("key").alias("smallest_key"), F.max("key").alias("largest_key"), F.max("seq").alias("max_seq"), F.count(F.lit(1)).alias("n_rows"), F.sum(entry_bytes()).cast("long").alias("n_bytes"))


def overlapping(files: DataFrame, ranges: DataFrame, names: tuple[str, str] = ("low", "high")) -> DataFrame:
    """Files with the query ranges that they overlap.

    An interval join: the relation of ranges is planned as the small side only if Spark measures
    it so; :func:`overlapping_bucketed` is the way for two large ones."""
    return files.join(ranges, overlaps(F.col("smallest_key"), F.col("largest_key"), F.col(names[0]), F.col(names[1])))


def overlapping_bucketed(files: DataFrame, ranges: DataFrame, cuts: list[str], names: tuple[str, str] = ("low", "high")) -> DataFrame:
    """The same for two large relations: both are dealt to the buckets between cut points that
    they touch, joined on the bucket, and each pair is kept in the first bucket they share."""
    table = F.array(*[F.lit(c) for c in sorted(cuts)])

    def bucket(key: Column) -> Column:
        return F.when(key.isNull(), None).otherwise(F.size(F.filter(table, lambda c: c <= key)))

    first = lambda k: F.coalesce(bucket(k), F.lit(0))
    last = lambda k: F.coalesce(bucket(k), F.lit(len(cuts)))
    a = files.withColumn("_a", first(F.col("smallest_key"))).withColumn("_bucket", F.explode(F.sequence(F.col("_a"), last(F.col("largest_key")))))
    b = ranges.withColumn("_b", first(F.col(names[0]))).where(F.col(names[0]).isNull() | F.col(names[1]).isNull() | (F.col(names[0]) <= F.col(names[1]))).withColumn("_bucket", F.explode(F.sequence(F.col("_b"), last(F.col(names[1])))))
    met = a.join(b, "_bucket").where((F.col("_bucket") == F.greatest("_a", "_b")) & overlaps(F.col("smallest_key"), F.col("largest_key"), F.col(names[0]), F.col(names[1])))
    return met.drop("_a", "_b", "_bucket")


def level_stats(files: DataFrame) -> DataFrame:
    """Files, bytes and key span of each level that has files."""
    return files.groupBy("level").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_bytes").alias("n_bytes"), F.min("smallest_key").alias("smallest_key"), F.max("largest_key").alias("largest_key"), F.max("max_seq").alias("max_seq"))


def next_seq(*relations: DataFrame) -> DataFrame:
    """One more than the highest sequence number in files and logs (1 if there are none)."""
    highest = [r.agg(F.max("max_seq" if "max_seq" in r.columns else "seq").alias("m")) for r in relations]
    out = highest[0]
    for h in highest[1:]:
        out = out.unionAll(h)
    return out.agg((F.coalesce(F.max("m"), F.lit(0)) + 1).cast("long").alias("next_seq"))


def bottommost(files: DataFrame) -> DataFrame:
    """For each target level, whether all deeper ones are empty, so that tombstones may be dropped."""
    spark = files.sparkSession
    deepest = files.agg(F.coalesce(F.max("level"), F.lit(-1)).alias("deepest"))
    targets = spark.range(1, LEVELS).select(F.col("id").cast("int").alias("level"))
    return targets.crossJoin(deepest).select("level", (F.col("deepest") <= F.col("level")).alias("bottommost"))  # one row


def split_by_bytes(log: DataFrame, target: int, slices: int = 64) -> DataFrame:
    """An output file number per row in key order, a new file about every ``target`` bytes.

    The running size is a window within hashed-free key ranges: partial sums per range give each
    range its offset, so no task orders the whole log."""
    from keystrand.operators.versions import _OFFSETS, local_table, stage

    key = ["key", F.col("seq").desc()]
    local = F.monotonically_increasing_id()
    staged = stage(log.repartitionByRange(slices, *key).sortWithinPartitions(*key).withColumn("_part", F.shiftright(local, 33)).withColumn("_at", local).withColumn("_bytes", entry_bytes()))
    sums = sorted((r[0], r[1]) for r in staged.groupBy("_part").agg(F.sum("_bytes")).collect())
    offsets, total = [], 0
    for part, size in sums:
        offsets.append((part, total))
        total += size
    table = local_table(log.sparkSession, _OFFSETS, offsets)
    before = F.coalesce(F.sum("_bytes").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = staged.join(table, "_part").withColumn("file_no", F.floor((F.col("_offset") + before) / target).cast("long"))
    return placed.drop("_part", "_at", "_bytes", "_offset")


def freeze_points(sizes: DataFrame, limit: int, group: list[str] | None = None, slices: int | None = None) -> DataFrame:
    """Where a buffer that takes rows (seq, bytes) in order is frozen: its size has reached the
    limit after a row, and starts again at zero.  Sizes aren't negative or null.

    With ``group``, a fold over the rows of each group, for bounded groups (a batch, a shard of the
    log).  Without, rows are dealt by range of seq, each range tells what size it ends with for any
    size it may begin with, and the driver carries the size from range to range; no task sees all
    rows.  ``slices``: the number of ranges; Spark's own if None."""
    if not group:
        return _freeze_points_by_range(sizes, limit, slices)
    rows = sizes.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("seq", "bytes"))).alias("rows"))
    zero = F.expr("named_struct('size', cast(0 as long), 'out', cast(array() as array<struct<seq:bigint,size:bigint>>))")

    def step(acc: Column, r: Column) -> Column:
        size = acc["size"] + r["bytes"]
        full = size >= limit
        return F.struct(F.when(full, F.lit(0).cast("long")).otherwise(size).alias("size"), F.when(full, F.concat(acc["out"], F.array(F.struct(r["seq"].cast("long").alias("seq"), size.cast("long").alias("size"))))).otherwise(acc["out"]).alias("out"))

    out = rows.select(*group, F.explode(F.aggregate("rows", zero, step, lambda acc: acc["out"])).alias("f"))
    return out.select(*group, F.col("f.seq").alias("seq"), F.col("f.size").alias("size"))


def _freeze_points_by_range(sizes: DataFrame, limit: int, slices: int | None) -> DataFrame:
    from keystrand.operators.versions import stage

    rows = sizes.select(F.col("seq").cast("long").alias("seq"), F.col("bytes").cast("long").alias("bytes"))
    dealt = rows.repartitionByRange(slices, "seq") if slices else rows.repartitionByRange("seq")
    staged = stage(dealt.withColumn("_part", F.spark_partition_id()))

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        total, after = _range_ends(pdf.sort_values(["seq", "bytes"])["bytes"].to_numpy(), limit)
        return pd.DataFrame({"_part": [pdf["_part"].iloc[0]], "total": [total], "reached": [[a for a, _ in after]], "size": [[b for _, b in after]]})

    told = staged.groupBy("_part").applyInPandas(ends, "_part int, total long, reached array<long>, size array<long>").collect()
    begins, size = [], 0
    for r in sorted(told, key=lambda r: r["_part"]):
        begins.append((r["_part"], size))
        k = int(np.searchsorted(r["reached"], limit - size))
        size = r["size"][k] if k < len(r["reached"]) else size + r["total"]
    table = sizes.sparkSession.createDataFrame(begins, "_part int, _begin long")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq", "bytes"])
        at, full = _frozen(pdf["bytes"].to_numpy(), limit, int(pdf["_begin"].iloc[0]))
        return pd.DataFrame({"seq": pdf["seq"].to_numpy()[at], "size": full})

    return staged.join(table, "_part").groupBy("_part").applyInPandas(fold, "seq long, size long")


def _frozen(sizes: np.ndarray, limit: int, begin: int) -> tuple[list[int], list[int]]:
    """Rows after which a buffer that has ``begin`` bytes is frozen, and its sizes there."""
    sums = np.cumsum(sizes)
    at, full, base, k = [], [], -begin, 0
    while (k := max(int(np.searchsorted(sums, base + limit)), k)) < len(sums):
        at.append(k), full.append(int(sums[k]) - base)
        base, k = int(sums[k]), k + 1
    return at, full


def _range_ends(sizes: np.ndarray, limit: int) -> tuple[int, list[tuple[int, int]]]:
    """The sum of sizes, and (bytes, end) pairs in order: a buffer that lacks up to so many bytes
    (and more than the pair before) to the limit ends with that size.  One that lacks more than
    the last pair says is never frozen.

    Buffers frozen after the same row go on alike, so there is a pair for each row that may be the
    first one, fewer where neighbours end alike."""
    n, sums = len(sizes), np.cumsum(sizes)
    onward = np.maximum(np.searchsorted(sums, sums + limit), np.arange(1, n + 1))
    last = np.where(onward < n, onward, np.arange(n))  # of the rows that a buffer frozen after a row is frozen at, by doubling
    while (last[last] != last).any():
        last = last[last]
    first = int(np.searchsorted(sums, limit)) + 1  # a buffer lacks the limit at most
    pairs: list[tuple[int, int]] = []
    for reached, end in zip(sums[:first].tolist(), (sums[-1] - sums[last[:first]]).tolist()):
        if pairs and pairs[-1][0] == reached:
            continue  # a row without bytes: the buffer was frozen before it
        if pairs and pairs[-1][1] == end:
            pairs.pop()
        pairs.append((reached, end))
    return int(sums[-1]), pairs
