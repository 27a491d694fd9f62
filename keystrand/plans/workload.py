"""Synthetic key-value workloads: specifications, presets and generated operations."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrand.functions import samplers
from keystrand.functions.keys import encode_key
from keystrand.sources.staging import local_table

KINDS = ("read", "update", "insert", "rmw", "scan")
DISTRIBUTIONS = ("uniform", "zipfian", "latest")


@dataclass(frozen=True)
class Workload:
    """Keys, values, distribution and operation mix of a run."""

    name: str = "custom"
    description: str = ""
    keys: int = 10_000
    value_size: int = 100
    key_distribution: str = "uniform"
    zipfian_theta: float = 0.99
    op_mix: dict[str, float] = field(default_factory=lambda: {"read": 1.0})
    max_scan_length: int = 100

    def validate(self) -> Workload:
        """ValueError unless shares are known, not negative and sum to 1, within 1e-6."""
        if self.key_distribution.lower() not in DISTRIBUTIONS:
            raise ValueError(f"unknown key distribution: {self.key_distribution}")
        for kind, share in self.op_mix.items():
            if kind not in KINDS:
                raise ValueError(f"unknown operation: {kind}")
            if share < 0:
                raise ValueError(f"share of {kind} is negative: {share}")
        if abs(sum(self.op_mix.values()) - 1) > 1e-6:
            raise ValueError(f"shares sum to {sum(self.op_mix.values())}, not 1")
        if self.keys < 1 or self.value_size < 0 or self.max_scan_length < 1:
            raise ValueError("keys, value_size or max_scan_length is out of range")
        return self


def _preset(letter: str, distribution: str = "zipfian", **mix: float) -> Workload:
    return Workload(f"YCSB-{letter}", "", 1_000_000, 1024, distribution, 0.99, mix)


#: The six standard mixes.
PRESETS = {
    "ycsb-a": _preset("A", read=0.5, update=0.5),
    "ycsb-b": _preset("B", read=0.95, update=0.05),
    "ycsb-c": _preset("C", read=1.0),
    "ycsb-d": _preset("D", "latest", read=0.95, insert=0.05),
    "ycsb-e": _preset("E", scan=0.95, insert=0.05),
    "ycsb-f": _preset("F", read=0.5, rmw=0.5),
}


def load(source: str | None = None, **overrides) -> Workload:
    """A preset by name, or a TOML text; then overrides that aren't None; validated."""
    if source is None:
        spec = Workload()
    elif source in PRESETS:
        spec = PRESETS[source]
    else:
        raw = tomllib.loads(source)
        unknown = set(raw) - set(Workload.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        spec = Workload(**raw)
    return replace(spec, **{k: v for k, v in overrides.items() if v is not None}).validate()


def initial_rows(spark: SparkSession, spec: Workload, seed: int = 42) -> DataFrame:
    """(key, value) rows to load before a run."""
    rows = spark.range(spec.keys)
    return rows.select(encode_key(F.col("id")).alias("key"), samplers.value_bytes(F.col("id"), spec.value_size, seed).alias("value"))


def operations(spark: SparkSession, spec: Workload, n: int, seed: int = 42) -> DataFrame:
    """(step, kind, key, scan_length) of a run of n operations.

    Inserts take the next key numbers in order of step; latest-biased reads count back from the
    keys there are at their step.  Both need the number of inserts before a step, which comes from
    counts per block of steps and a running count within the block."""
    u = lambda salt: samplers.unit(F.col("step"), seed, salt)
    steps = spark.range(n).select(F.col("id").alias("step"), F.shiftright("id", 16).alias("block"))
    kinds = steps.withColumn("kind", samplers.pick(u(1), spec.op_mix))
    is_insert = (F.col("kind") == "insert").cast("long")
    per_block = kinds.groupBy("block").agg(F.sum(is_insert).alias("inserts"))
    sums = sorted((r[0], r[1]) for r in per_block.collect())
    offsets, total = [], 0
    for b, k in sums:
        offsets.append((b, total))
        total += k
    placed = kinds.join(local_table(spark, pa.schema([("block", pa.int64()), ("offset", pa.int64())]), offsets), "block")
    before = F.coalesce(F.sum(is_insert).over(Window.partitionBy("block").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    there = (F.lit(spec.keys) + F.col("offset") + before).alias("there")
    rows = placed.select("step", "kind", there)
    kind = spec.key_distribution.lower()
    if kind == "uniform":
        index = samplers.uniform_key(u(2), F.col("there"))
    else:
        rank = samplers.zipf_rank(u(2), spec.keys, spec.zipfian_theta)
        index = samplers.latest_key(rank, F.col("there")) if kind == "latest" else F.least(rank, F.col("there")) - 1
    number = F.when(F.col("kind") == "insert", F.col("there")).otherwise(index)
    return rows.select("step", "kind", encode_key(number).alias("key"), F.when(F.col("kind") == "scan", samplers.scan_length(u(3), spec.max_scan_length)).alias("scan_length"))


def scheduled(ops: DataFrame, per_second: int) -> DataFrame:
    """Adds intended_ns, when a closed loop of that rate would start each step; latencies count
    from there, so that a stalled operation delays the ones after it."""
    return ops.withColumn("intended_ns", F.expr(f"cast(step as long) * 1000000000 div {int(per_second)}"))
