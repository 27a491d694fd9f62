"""Tables staged in the folder that all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one is set only where it has none and Spark
    runs in this process alone; on a cluster ValueError."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="keystrand-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def local_table(spark: SparkSession, schema: pa.Schema, rows: list[tuple]) -> DataFrame:
    """Rows of the driver as a relation whose size Spark knows, so that a join broadcasts it where it
    is below Spark's own threshold and never for being assumed small."""
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))


def stage(df: DataFrame) -> DataFrame:
    """Writes a DataFrame once and reads it back; the folder goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/keystrand-stage/{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
