"""Shared scratch space: intermediate tables that every executor and the driver can read.

The folder comes from ``spark.checkpoint.dir``; only where the session has none (tests,
notebooks) is a local one set.  Tables written here cut the lineage and outlive executors;
they are removed when the driver's JVM ends.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, set to a fresh one where it is unset and Spark runs in
    this process alone; on a cluster ValueError."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="keystrand-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/keystrand/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what is at a path of the shared folder that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: computed once, short lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filter_bits(keys: DataFrame, hashed: Column, bits: int) -> np.ndarray:
    """A filter of 2^bits bits, whatever the input, with that of each key's hash set."""
    at = F.pmod(hashed, F.lit(1 << bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    words = keys.select(F.shiftright(at, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy()] = words["bit"].to_numpy()
    return out


def in_filter(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each (signed 64-bit) hash may be one of the filter's keys."""
    at = hashes & np.int64(len(held) * 64 - 1)
    return ((held[at >> 6] >> (at & 63)) & 1).astype(bool)


#: Rows and bytes that go to a Python worker at once; texts may be long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow in batches of bounded size; when a task ends, its worker gives memory back.

    The session's bounds are lowered to :data:`BATCH` where they are higher, and stay so: Spark
    reads them when the plan runs, which may be after this function has returned."""
    spark = df.sparkSession
    for name, most in BATCH.items():
        if not 0 < int(str(spark.conf.get(name)).rstrip("b")) <= most:
            spark.conf.set(name, str(most))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(bounded, schema)


def give_back() -> None:
    """Returns this process's free memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
