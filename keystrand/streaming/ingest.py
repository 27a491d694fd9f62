"""Streaming ingest into a table, and the newest version per key kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from keystrand.plans.table import KVTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest(mutations: DataFrame, table: KVTable, checkpoint: str, name: str = "ingest", compact: bool = True, **trigger) -> StreamingQuery:
    """Writes each micro-batch of (key, op, value) as one run; ids make replays harmless.

    Columns beyond these that order the rows of a batch (``seq``) are respected if present.
    Intake is bounded by the source's own limits (maxFilesPerTrigger and the like); a table with
    ``max_pending`` holds batches back while compaction is behind, and the query fails with Stalled
    where that takes too long, to go on from the same batch when it is started again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.repartitionByRange("seq").sortWithinPartitions("seq") if "seq" in batch.columns else batch
        table.write_batch(rows, f"{name}/{batch_id}")
        if compact:
            table.compact()

    return mutations.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()


class Newest(StatefulProcessor):
    """Keeps the version with the highest sequence number of a key, in whatever order they come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", "seq long, op byte, value binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.state.get() if self.state.exists() else None
        best = (held[0], held[1], held[2]) if held is not None else None
        for pdf in rows:
            at = pdf["seq"].idxmax()
            if best is None or int(pdf.at[at, "seq"]) > best[0]:
                value = pdf.at[at, "value"]
                best = (int(pdf.at[at, "seq"]), int(pdf.at[at, "op"]), None if value is None else bytes(value))
        if best is not None and (held is None or best[0] > held[0]):
            self.state.update(best)
            yield pd.DataFrame({"key": [key[0]], "seq": [best[0]], "op": pd.array([best[1]], dtype="int8"), "value": [best[2]]})

    def close(self) -> None:
        pass


def newest_stream(mutations: DataFrame) -> DataFrame:
    """A stream of (key, seq, op, value): a row each time a key's newest version changes.

    Needs the RocksDB state store (:data:`ROCKSDB`)."""
    return mutations.select("key", "seq", "op", "value").groupBy("key").transformWithStateInPandas(statefulProcessor=Newest(), outputStructType="key string, seq long, op byte, value binary", outputMode="Update", timeMode="None")


def tumbling_counts(events: DataFrame, at: str, seconds: int = 1, late: str = "10 seconds") -> DataFrame:
    """Rows per tumbling window of event time; batch and streaming plans are the same."""
    return events.withWatermark(at, late).groupBy(F.window(at, f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")
