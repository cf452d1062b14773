"""Scans and sinks: JSON with a default, categories, signals, images, stage folders, reports and append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.normalise import clean_html, dotted_parent


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on whatever file system Spark reads it from."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON document with a fixed schema; a missing path reads as an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True)


def _field(values: Column, name: str) -> Column:
    return F.get(F.filter(values, lambda v: v["valueIdentifier"] == name), F.lit(0))["value"]


def categories(raw: DataFrame) -> DataFrame:
    """childrenValues (identifier and value pairs) -> code, name (else the code), description, parent_code."""
    v = F.col("childrenValues")
    code = _field(v, "refDataFoodCategoryLevel")
    return raw.select(
        code.alias("code"), F.coalesce(_field(v, "refDataFoodCategoryEN"), code).alias("name"),
        clean_html(_field(v, "refDataFoodCategoryDesc")).alias("description"), dotted_parent(code).alias("parent_code"),
    ).where("code is not null")


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of image files, for a label extractor to read in mapInPandas."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def write_stage(rows: DataFrame, path: str, stage: str, fmt: str = "parquet") -> None:
    """One folder per stage; writing a stage again replaces it and leaves the others as they are, byte for byte."""
    write_stages(rows.withColumn("stage", F.lit(stage)), path, fmt)


def write_stages(rows: DataFrame, path: str, fmt: str = "parquet", by: tuple[str, ...] = ("stage",)) -> None:
    """Rows of several stages (and, with ``by``, labels) at once: folders that have rows are replaced whole, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").format(fmt).partitionBy(*by).save(path)


def to_report(rows: DataFrame, key: str) -> DataFrame:
    """One JSON document per key; columns that are null are left out of it."""
    others = [c for c in rows.columns if c != key]
    return rows.select(key, F.to_json(F.struct(*others)).alias("report"))


def append_log(log: DataFrame, entry: DataFrame) -> DataFrame:
    """The log with new rows; columns that one side lacks are null."""
    return log.unionByName(entry, allowMissingColumns=True)


def missing_keys(wanted: DataFrame, cache: DataFrame, *columns: str) -> DataFrame:
    """wanted rows whose content hash the cache (key) does not hold."""
    key = F.sha2(F.concat_ws("|", *columns).cast("binary"), 256)
    return wanted.withColumn("key", key).join(cache.select("key").distinct(), "key", "left_anti")
