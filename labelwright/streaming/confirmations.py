"""Pause and resume: what waits for a confirmation meets it, or goes on without one when its time is over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confirmed(paused: DataFrame, confirmations: DataFrame, wait: str = "2 days", late: str = "1 hour") -> DataFrame:
    """Each paused row with each confirmation of its key within ``wait``, or once without any.

    paused: key, paused_at and more; confirmations: key, confirmed_at, choice. Adds confirmed_at, choice and state
    (confirmed, unconfirmed). On tables this is a join. On streams both sides are kept until the watermark shows that no
    partner can come: a confirmation before the pause, after ``wait``, or later than ``late`` behind the newest
    row of its stream is not taken, and the row without one comes out when the watermark has passed its wait.
    """
    left = paused.withColumn("paused_at", F.col("paused_at").cast("timestamp"))
    right = confirmations.select(F.col("key").alias("c_key"), F.col("confirmed_at").cast("timestamp").alias("confirmed_at"), "choice")
    if left.isStreaming:
        left = left.withWatermark("paused_at", late)
    if right.isStreaming:
        right = right.withWatermark("confirmed_at", late)
    until = F.col("paused_at") + F.expr(f"INTERVAL {wait}")
    met = left.join(right, (F.col("key") == F.col("c_key")) & (F.col("confirmed_at") >= F.col("paused_at")) & (F.col("confirmed_at") <= until), "left_outer")
    return met.drop("c_key").withColumn("state", F.when(F.col("confirmed_at").isNull(), "unconfirmed").otherwise("confirmed"))
