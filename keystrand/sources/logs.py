"""Write-ahead log files: checksummed records in numbered generations.

A log file is JSON lines with positions.  Replay keeps the records before the first that is damaged
or missing; generations are replayed in numeric order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrand.functions.keys import checksum
from keystrand.operators.versions import numbered
from keystrand.schema import DELETE, PUT
from keystrand.sources.store import Store

RECORD = T.StructType([T.StructField("pos", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("op", T.ByteType()), T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType()), T.StructField("crc", T.LongType())])


def framed(log: DataFrame, position: str = "seq") -> DataFrame:
    """Log rows as records with a position and a checksum."""
    return log.select(F.col(position).cast("long").alias("pos"), "seq", "op", "key", "value", checksum(F.col("key"), F.col("seq"), F.col("op"), F.col("value")).alias("crc"))


def valid_prefix(records: DataFrame, group: str | None = None) -> DataFrame:
    """Records before the first bad one (of each ``group``): missing parts, a tag other than put
    or delete, or a checksum that differs.  The bad position is an aggregate, not a scan in order."""
    good = F.col("crc").isNotNull() & F.col("op").isin(DELETE, PUT) & (F.col("crc") == checksum(F.col("key"), F.col("seq"), F.col("op"), F.col("value")))
    bad = records.where(~F.coalesce(good, F.lit(False)))
    keys = [group] if group else []
    first = bad.groupBy(*keys).agg(F.min("pos").alias("_bad"))
    joined = records.join(first, group, "left") if group else records.crossJoin(first)  # one row
    return joined.where(F.col("_bad").isNull() | (F.col("pos") < F.col("_bad"))).drop("_bad")


def whole_prefix(records: DataFrame) -> DataFrame:
    """Records before the first position (from 1) that is missing, as a torn record's is, in whatever
    order the records are read.  The driver gets a row for each 65,536 positions."""
    own = F.shiftright(F.col("pos") - 1, 16)
    rank = F.row_number().over(Window.partitionBy("_block").orderBy("pos"))
    ranked = records.select("pos").distinct().withColumn("_block", own).withColumn("_rank", rank)
    sound = (F.col("pos") - 1).bitwiseAND(F.lit(65_535)) == F.col("_rank") - 1
    end = 0
    for block, n in sorted((r[0], r[1]) for r in ranked.groupBy("_block").agg(F.count(F.when(sound, 1))).collect()):
        if block << 16 != end:
            break
        end += n
        if n < 1 << 16:
            break
    return records.where(F.col("pos").between(1, end))


class LogDir:
    """The log files of a store, by generation."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, Store(spark, root)

    def generations(self) -> list[int]:
        """Numbers of the logs there, ascending as numbers."""
        return sorted(int(n[:-4]) for n in self.store.names("wal") if n.endswith(".wal") and n[:-4].isdigit())

    def highest(self) -> int:
        return max(self.generations(), default=0)

    def _path(self, generation: int) -> str:
        return self.store.path(f"wal/{generation:020d}.wal")

    def append(self, log: DataFrame) -> int:
        """Writes a new generation in order of seq, positions counted from 1; returns its number."""
        number = self.highest() + 1
        framed(numbered(log, ["seq"]), "n").write.json(self._path(number))
        return number

    def replay(self, generation: int) -> DataFrame:
        """The valid prefix of one log.  A record that was cut short can't be read, so its position
        is missing; it and all after it are left out."""
        records = self.spark.read.schema(RECORD).option("mode", "PERMISSIVE").json(self._path(generation))
        return whole_prefix(valid_prefix(records.where("pos is not null")))

    def replay_all(self) -> DataFrame | None:
        """All logs, with their generation, oldest first; None where there are none."""
        parts = [self.replay(g).withColumn("generation", F.lit(g).cast("long")) for g in self.generations()]
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def delete_through(self, generation: int) -> list[int]:
        """Removes logs up to a generation, once their versions are in published files."""
        gone = [g for g in self.generations() if g <= generation]
        for g in gone:
            self.store.delete(f"wal/{g:020d}.wal")
        return gone
