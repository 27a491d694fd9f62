"""The relations: mutation log, files and manifest edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELETE, PUT = 0, 1
MAX_KEY_BYTES = 65_535
MAX_SEQ = 2**63 - 1
LEVELS = 7

LOG = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("seq", T.LongType(), False), T.StructField("op", T.ByteType(), False), T.StructField("value", T.BinaryType(), True)])
FILES = T.StructType([
    T.StructField("file_id", T.StringType(), False), T.StructField("level", T.IntegerType(), False), T.StructField("path", T.StringType(), False),
    T.StructField("smallest_key", T.StringType()), T.StructField("largest_key", T.StringType()), T.StructField("base_seq", T.LongType(), False),
    T.StructField("max_seq", T.LongType()), T.StructField("n_rows", T.LongType()), T.StructField("n_bytes", T.LongType()),
])
EDITS = T.StructType([
    T.StructField("version", T.LongType(), False), T.StructField("action", T.StringType(), False), T.StructField("file_id", T.LongType(), False),
    T.StructField("level", T.IntegerType()), T.StructField("smallest_key", T.StringType()), T.StructField("largest_key", T.StringType()), T.StructField("max_seq", T.LongType()),
])


def checked(log: DataFrame) -> DataFrame:
    """The log with its contract enforced when rows are read: keys present and short enough, known
    record tags, values exactly on puts, sequence numbers from 1 to 2^63 - 1."""
    bad = (
        F.when(F.col("key").isNull(), "null key")
        .when(F.octet_length("key") > MAX_KEY_BYTES, "key too long")
        .when(~F.coalesce(F.col("op").isin(DELETE, PUT), F.lit(False)), "unknown record tag")
        .when((F.col("op") == PUT) != F.col("value").isNotNull(), "value and record tag disagree")
        .when(F.coalesce(F.col("seq"), F.lit(0)) < 1, "sequence number out of range")
    )
    return log.withColumn("key", F.when(bad.isNull(), F.col("key")).otherwise(F.raise_error(F.concat(F.lit("corrupt log row: "), bad))))


def entry_bytes() -> Column:
    """Bytes that a version takes in the buffer: key, value and eight for the sequence number."""
    return F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + F.lit(8)
