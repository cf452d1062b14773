"""Operators that read the same over a table and over a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """event_type, start, end, n per event-time window; on a stream, events later than ``late`` are dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    counts = rows.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("event_type", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once_per_key(rows: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; a stream forgets keys after ``late``, so its state is bounded."""
    if rows.isStreaming:
        return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), "ts").alias("r")).select("r.*")


def upsert_latest(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps, per batch, the latest row of each key as one idempotent folder of a table.

    A batch that is run again after a failure overwrites its own folder, so nothing is counted twice; readers take the
    latest row of each key over all folders.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        latest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        latest.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write
