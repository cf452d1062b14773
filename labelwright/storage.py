"""The folder that driver and executors share, and tables written there once to be read several times."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; without the setting, in local mode alone, a folder of the application's own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="labelwright-")
    return _own[app]


def new_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else has; it is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/labelwright/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet and read again: what reads them several times computes them once, and lineage is cut."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, name: str, most: int = 100_000, size: Column | None = None) -> DataFrame:
    """The rows written once, and marked for a broadcast if they (or the sum of size) are at most so many; more meet the other side by shuffle."""
    rows = written(df, name)
    n = rows.select(F.sum(size)).first()[0] if size is not None else rows.count()
    return F.broadcast(rows) if (n or 0) <= most else rows


@atexit.register
def _remove() -> None:
    for path, spark in _written.items():
        with contextlib.suppress(Exception):
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
