"""Spark-side helpers of the training-data operators: shared storage, splits, bounded samples."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of a word; same as textkernel's words.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, in local mode alone, one of our own.

    A cluster without the setting is an error: a machine-local folder would leave each executor with its own part.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="labelwright-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_tables: dict[str, SparkSession] = {}
#: Catalogue names of the tables that have one.
_names: dict[str, str] = {}


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a table on the file system it lies on; without a JVM to ask, it stays."""
    with contextlib.suppress(Exception):
        if path in _names:
            spark.sql(f"DROP TABLE IF EXISTS {_names.pop(path)}")
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _remove_tables() -> None:
    for path, spark in _tables.items():
        _remove(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read again.

    This cuts the lineage: lost executors cost only the tasks that read the table, and later passes read columns
    instead of computing them anew. The table goes when it is discarded or the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/labelwright/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def written_by(df: DataFrame, name: str, column: str) -> DataFrame:
    """As written(), in buckets of the column: joins and groups on it read the table where it lies, without shuffling it."""
    spark = df.sparkSession
    table = f"labelwright_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/labelwright/{table}"
    df.write.format("parquet").option("path", path).bucketBy(shuffled(spark), column).saveAsTable(table)
    _tables[path], _names[path] = spark, table
    out = spark.table(table)
    out.written_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table of a frame that written() gave and that nothing reads any more."""
    path = df.written_path
    _remove(_tables.pop(path), path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def hashed_share(rows: DataFrame, bound: int, salt: int, *columns: str) -> DataFrame:
    """All rows if they are at most bound, else those whose hash of the columns lies below bound / number of rows: about bound of them."""
    n = rows.count()
    return rows if n <= bound else rows.where(below(bound / n, salt, *columns))


def below(share: float, salt: int, *columns: str) -> Column:
    """Whether the hash of the columns lies in the first share of its range."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(salt)), 11) < int(share * (1 << 53))


def shuffled(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keep_rows(docs: DataFrame, mask: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """Rows of docs, all columns unchanged, where mask(batch) is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(mask(batch))

    return docs.mapInArrow(run, docs.schema)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return df.mapInArrow(run, schema)
