"""Incremental indexing with Structured Streaming.

An extension: the published service has no streams. Captions arrive as files, each micro-batch appends its postings and
document lengths, and the batch operators read the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.entries import entries
from ..operators.postings import postings, token_lengths


def index_stream(spark: SparkSession, path: str) -> DataFrame:
    """Asset index lines as a stream."""
    return spark.readStream.schema(schemas.INDEX).json(path)


def maintain(stream: DataFrame, root: str, checkpoint: str, *, once: bool = True):
    """Append postings and lengths of new entries under ``root``; a batch number is a partition, so a retry overwrites it."""

    def write(batch: DataFrame, number: int) -> None:
        if "record_id" not in batch.columns:
            batch = batch.withColumn("record_id", F.monotonically_increasing_id())
        entry = entries(batch)
        for name, rows in (("postings", postings(entry)), ("lengths", token_lengths(entry))):
            rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths in force: of an object that came in several batches those of the last one."""
    lengths, found = (spark.read.parquet(f"{root}/{name}") for name in ("lengths", "postings"))
    last = lengths.groupBy("object_id").agg(F.max("batch").alias("batch"))
    return found.join(last, ["object_id", "batch"], "left_semi").drop("batch"), lengths.join(last, ["object_id", "batch"], "left_semi").drop("batch")


def windowed_counts(events: DataFrame, *, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Event counts and sums by type in event-time windows, late rows admitted up to the watermark."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    return held.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
