"""Streams: record ingest, idempotent appends, counters and windows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import parse_records, split_records


#: State on the executors' disks.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ingest_records(spark: SparkSession, folder: str, out: str, refused: str, checkpoint: str, source: str | None = None, files: int | None = None) -> None:
    """Take all new JSONL files of a folder: accepted records are appended once for each run_id, refused lines aside.

    The run_ids seen are keyed state that doesn't expire; ``files`` paces a micro-batch.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files) if files else spark.readStream
    good, bad = split_records(parse_records(reader.text(folder), source))
    before = spark.conf.get(ROCKSDB[0], None)
    try:
        spark.conf.set(*ROCKSDB)
        for rows, path, name in ((good.dropDuplicates(["run_id"]), out, "accepted"), (bad, refused, "refused")):
            # a batch that is tried again writes over its own rows
            save = lambda batch, epoch, path=path: batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
            rows.writeStream.foreachBatch(save).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(ROCKSDB[0]) if before is None else spark.conf.set(ROCKSDB[0], before)


def merge_stream(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], Any]) -> None:
    """Run a merge for each micro-batch of what is there."""
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events of each type by event-time window; later than ``late`` they are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: events no further apart than the gap."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def distinct_events(events: DataFrame, key: str = "event_id", late: str = "7 days") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_to_table(stream: DataFrame, spark: SparkSession, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into Parquet, and read the result."""
    if mode == "append":
        stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").format("parquet").option("path", f"{folder}/table").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/table")

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/epoch={epoch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/table")
