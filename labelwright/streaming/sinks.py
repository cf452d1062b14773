"""Sinks that a stream may run into twice: tables of the latest row per key, and work done once per key.

A micro-batch writes a folder of its own number and overwrites it when it is run again after a failure, so nothing is
counted twice. Readers take the latest row of each key over a base and the folders after it; compaction folds folders
into a new base and then points to it, so a reader or a failure in between sees the old one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import exists
from .windows import upsert_latest

Batch = Callable[[DataFrame, int], None]


def _folders(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the complete folders kind=n below path."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(fs_path)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=") and exists(spark, f"{path}/{n}/_SUCCESS"))


def _bases(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """The last epoch that the current base holds, and where the base lies."""
    ends = _folders(spark, path, "pointer")
    if not ends:
        return None
    return ends[-1], spark.read.text(f"{path}/pointer={ends[-1]}").first()[0]


def latest(spark: SparkSession, path: str, key: str, order: str, schema: str) -> DataFrame:
    """The table that upsert_latest() keeps below path: per key the row of the greatest order. Nothing written: no rows."""
    base = _bases(spark, path)
    parts = [f"{path}/epoch={n}" for n in _folders(spark, path, "epoch") if base is None or n > base[0]] + ([base[1]] if base else [])
    if not parts:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*parts)
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def compact(spark: SparkSession, path: str, key: str, order: str, schema: str) -> None:
    """Folds all complete epochs into a new base. Old folders stay until the caller removes them: readers may still use them."""
    epochs = _folders(spark, path, "epoch")
    if not epochs or (base := _bases(spark, path)) and base[0] >= epochs[-1]:
        return
    place = f"{path}/base-{uuid.uuid4().hex}"
    latest(spark, path, key, order, schema).write.parquet(place)
    spark.createDataFrame([(place,)], "place string").coalesce(1).write.mode("overwrite").text(f"{path}/pointer={epochs[-1]}")


def done_keys(spark: SparkSession, path: str, key: str, kind: str, before: int | None = None) -> DataFrame:
    """Keys that batches (before the given one) have finished."""
    epochs = [n for n in _folders(spark, path, "epoch") if before is None or n < before]
    if not epochs:
        return spark.createDataFrame([], f"{key} {kind}")
    return spark.read.parquet(*(f"{path}/epoch={n}" for n in epochs)).select(key).distinct()


def once_each(path: str, key: str, work: Callable[[DataFrame], DataFrame]) -> Batch:
    """A foreachBatch sink that works on each key once, whenever it comes again: its results are a folder of the batch.

    work: rows with new keys -> results with the key. A batch that is run again looks at the batches before it alone, so it
    ends in the same folder. Keys are told by what is stored, so a new checkpoint goes on where the table ends as long as
    its batches are numbered on; give a table of its own to each query.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark, kind = batch.sparkSession, batch.schema[key].dataType.simpleString()
        new = batch.join(done_keys(spark, path, key, kind, epoch), key, "left_anti")
        work(new).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


__all__ = ["compact", "done_keys", "latest", "once_each", "upsert_latest"]
