"""Reports of a run: counts, latency percentiles, time series with the engine's state, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = (("p50_ns", 0.5), ("p95_ns", 0.95), ("p99_ns", 0.99), ("p999_ns", 0.999), ("p9999_ns", 0.9999))


def _quantile(column: Column, q: float, exact: bool) -> Column:
    if exact:
        return F.expr(f"percentile_disc({q}) within group (order by latency_ns)").cast("long")
    return F.percentile_approx(column, q, 100_000).cast("long")


def percentiles(latencies: DataFrame, by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """n, the percentiles, max and mean of latency_ns.

    Exact ones keep counts of distinct values; with ``exact`` off, mergeable sketches of bounded
    size (relative rank error 1e-5) take their place."""
    v = F.col("latency_ns")
    return latencies.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *[_quantile(v, q, exact).alias(n) for n, q in PERCENTILES], F.max(v).cast("long").alias("max_ns"), F.avg(v).alias("mean_ns"))


def corrected(latencies: DataFrame, interval_ns: int | Column) -> DataFrame:
    """Latencies with those that a stalled closed loop has left out: for each over the interval,
    also one interval less, and so on down to one interval at least."""
    ivl = F.lit(interval_ns) if isinstance(interval_ns, int) else interval_ns
    v = F.col("latency_ns")
    samples = F.when((ivl > 0) & (v > ivl), F.sequence(v, ivl, -ivl)).otherwise(F.array(v))
    return latencies.withColumn("latency_ns", F.explode(samples))


def op_counts(ops: DataFrame) -> DataFrame:
    """(kind, n, pct): each kind's count and its share of all in per cent."""
    counts = ops.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row per kind


def miss_rate(reads: DataFrame) -> DataFrame:
    """One row: reads, hits and the share of misses (0 without reads)."""
    n, hits = F.count(F.lit(1)), F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0))
    return reads.agg(n.alias("reads"), hits.alias("hits"), F.when(n == 0, 0.0).otherwise(1 - hits / n).alias("miss_rate"))


def throughput(ops: DataFrame, seconds: float) -> DataFrame:
    return ops.agg((F.count(F.lit(1)) / F.lit(seconds)).alias("ops_per_sec"))


def per_second(latencies: DataFrame, t: str = "t_ns") -> DataFrame:
    """(t_sec, ops, p50_ns, p99_ns, p999_ns, max_ns) for each second with operations; scans count too."""
    v = F.col("latency_ns")
    return latencies.groupBy(F.floor(F.col(t) / 1_000_000_000).cast("long").alias("t_sec")).agg(F.count(F.lit(1)).alias("ops"), *[_quantile(v, q, True).alias(n) for n, q in PERCENTILES if n in ("p50_ns", "p99_ns", "p999_ns")], F.max(v).alias("max_ns"))


def as_of_join(left: DataFrame, right: DataFrame, at: str, columns: list[str], by: list[str] | None = None, default: int | None = 0) -> DataFrame:
    """``left`` with the values of the newest row of ``right`` that isn't later (``at`` in both).

    Both sides are unioned and the last value is carried forward in one sort per key.  Without
    ``by`` the carried window would be one task, so time is cut into slices: each slice starts from
    the last row of the slices before it."""
    keys = by or []
    mark = left.select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(f"r_{c}") for c in columns], F.lit(1).alias("_side"))
    other = right.select(*[F.col(c) if c in (*keys, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], *[F.col(c).alias(f"r_{c}") for c in columns], F.lit(0).alias("_side"))
    both = mark.unionByName(other).withColumn("_row", F.when(F.col("_side") == 0, F.struct(*[f"r_{c}" for c in columns])))
    order = [F.col(at), F.col("_side")]
    if keys:
        seen = F.last("_row", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        rows = both.withColumn("_last", seen)
    else:
        from keystrand.sources.staging import stage

        dealt = stage(both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
        ends = sorted(((r[0], r[1]) for r in dealt.where("_side = 0").groupBy("_part").agg(F.max_by("_row", F.col(at))).collect()), key=lambda r: r[0])
        parts = sorted(r[0] for r in dealt.select("_part").distinct().collect())
        carried, last, k = [], None, 0
        for p in parts:
            while k < len(ends) and ends[k][0] < p:
                last, k = ends[k][1], k + 1
            carried.append((p, last))
        table = left.sparkSession.createDataFrame(carried, dealt.select("_part", F.col("_row").alias("_before")).schema)
        seen = F.last("_row", ignorenulls=True).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        rows = dealt.join(table, "_part").withColumn("_last", F.coalesce(seen, F.col("_before")))
    value = lambda c: F.col("_last")[f"r_{c}"] if default is None else F.coalesce(F.col("_last")[f"r_{c}"], F.lit(default))
    return rows.where("_side = 1").select(*left.columns, *[value(c).alias(c) for c in columns])


STATE = ["l0_files", "immutable_q", "in_flight_compactions", "total_flushes", "total_compactions"]


def time_series(latencies: DataFrame, snapshots: DataFrame, seconds: int) -> DataFrame:
    """A row for each second of a run, with zeros where nothing ran, and the newest engine state."""
    spark = latencies.sparkSession
    every = spark.range(seconds).select(F.col("id").alias("t_sec"))
    rows = every.join(per_second(latencies), "t_sec", "left").na.fill(0)
    state = snapshots.select(F.col("second_index").cast("long").alias("t_sec"), *STATE)
    return as_of_join(rows, state, "t_sec", STATE).select("t_sec", "ops", "p50_ns", "p99_ns", "p999_ns", "max_ns", *STATE)


def write_csv(series: DataFrame, path: str) -> None:
    """One CSV file with a header, in order of time; a row per second of a run is small."""
    series.coalesce(1).sortWithinPartitions("t_sec").write.mode("overwrite").csv(path, header=True)


def summary(latencies: DataFrame, seconds: float) -> str:
    """The text report: throughput, then counts, shares and percentiles of each kind."""
    counts = {r["kind"]: r for r in op_counts(latencies).collect()}
    rows = percentiles(latencies, ["kind"]).orderBy("kind").collect()
    total = sum(r["n"] for r in counts.values())
    lines = [f"operations {total}  seconds {seconds:.2f}  ops/sec {total / seconds if seconds else 0:.0f}"]
    for r in rows:
        lines.append(f"{r['kind']:<7} n {r['n']} ({counts[r['kind']]['pct']:.1f} %)  " + "  ".join(f"{n[:-3]} {r[n] / 1000:.1f} us" for n, _ in PERCENTILES) + f"  max {r['max_ns'] / 1000:.1f} us  mean {r['mean_ns'] / 1000:.1f} us")
    return "\n".join(lines)
