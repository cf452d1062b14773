"""Sharding by vector bin packing.

Groups of equal texts are packed into shards so that bytes, tokens and rows are balanced together: every item is a
vector of its shares of a shard's capacity, and goes to the shard where the dot product with the residual capacity is
highest, largest items first.

Scale: groups are summed by a 64-bit hash of the text (map-side first, so a group with a third of all rows is no hot
key). Groups above 1/``cells`` of the total in some dimension are items of their own: at most 3 x ``cells`` of them,
whatever the input. All smaller groups share ``cells`` hash cells, an item each. The packing therefore sees at most
4 x ``cells`` + pieces items, on the driver, and the assignment is joined back by cell. A group larger than a shard's
whole capacity cannot stay together; its rows are dealt in turn, task by task, to pieces of a quarter of the capacity,
repeated rows of one doc_id too.
Slots are numbered per (shard, sub-bucket) and put together from the sub-bucket counts, so no task sorts a whole shard;
rows of a large group are spread over sub-buckets by their number as well.

A null text has 0 bytes besides the row's overhead and a null checksum; null texts are one group, apart from empty
ones. Repeated rows get slots of their own; those of a group that outgrows a shard lie in several. Ties in the packing go to the first
shard, ties in the slot order are rows alike. Texts of any length are measured without building their words. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import WORD, written

ROW_OVERHEAD = 8


def pack(vectors: np.ndarray, shards: int, weights: tuple[float, ...]) -> np.ndarray:
    """Shard of each item. vectors: share of one shard's capacity by dimension."""
    residual = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), dtype=np.int64)
    scaled = vectors * np.asarray(weights)
    for i in np.argsort(-scaled.sum(axis=1), kind="stable"):
        s = int(np.argmax(residual @ scaled[i]))
        out[i] = s
        residual[s] -= vectors[i]
    return out


def measured(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.col("text").cast("binary")
    return docs.select(
        *more,
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
        F.xxhash64(F.col("text").isNull(), F.col("text")).alias("group"),
        F.monotonically_increasing_id().alias("number"),
    )


@dataclass(frozen=True)
class Setting:
    cells: int = 4096
    sub_buckets: int = 256
    #: Of bytes, tokens and rows in the dot product.
    weights: tuple[float, float, float] = (2.0, 1.0, 1.0)


def shard(docs: DataFrame, shards: int = 24, setting: Setting = Setting()) -> DataFrame:
    """doc_id, size, text_crc32, tokens, group, shard, slot for every row of docs (doc_id, text)."""
    rows = written(measured(docs), "sharding")
    placed = _place(rows, rows, shards, setting)
    return placed.select("doc_id", "size", "text_crc32", "tokens", "group", "shard", "slot")


def place(docs: DataFrame, shards: int = 24, setting: Setting = Setting()) -> DataFrame:
    """The rows of docs with size, text_crc32, shard and slot; columns of docs with these names are kept as docs_size and so on."""
    added = ["size", "text_crc32", "shard", "slot"]
    taken, names = {*docs.columns, *added}, []
    for c in docs.columns:
        name = c
        while name in added or (name != c and name in taken):
            name = f"docs_{name}"
        taken.add(name)
        names.append(name)
    row = F.struct(*(F.col(f"`{c}`").alias(name) for c, name in zip(docs.columns, names))).alias("row")
    stats = written(measured(docs), "sharding")
    placed = _place(stats, measured(docs, row), shards, setting)
    return placed.select("row.*", *added)


def _dealt(rows: DataFrame) -> DataFrame:
    """rows with piece: those of a group in turn, each task beginning at a piece of its own. Nothing is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() * 7919
        met: Counter[int] = Counter()
        for batch in batches:
            group, pieces = (batch.column(c).to_numpy() for c in ("group", "pieces"))
            piece = np.empty(len(group), dtype=np.int32)
            for g in np.unique(group).tolist():
                own = np.flatnonzero(group == g)
                piece[own] = (first + met[g] + np.arange(len(own))) % pieces[own]
                met[g] += len(own)
            yield batch.append_column("piece", pa.array(piece))

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("piece", IntegerType(), False)]))


def _place(stats: DataFrame, rows: DataFrame, shards: int, setting: Setting) -> DataFrame:
    """rows with shard and slot, packed by the sums of stats."""
    spark, cells = rows.sparkSession, setting.cells
    total = stats.agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).first()
    total = [float(x or 0) for x in total]
    # groups above a cell's share; fewer than 3 x cells, as each holds over 1/cells of a total
    groups = stats.groupBy("group").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("r"))
    is_large = F.lit(False)
    for c, x in zip("btr", total):
        is_large = is_large | (F.col(c) > x / cells)
    cell = F.pmod(F.xxhash64("group"), F.lit(cells))
    sums = groups.groupBy(F.when(is_large, F.col("group")).alias("large"), F.when(~is_large, cell).alias("cell")).agg(*(F.sum(c).alias(c) for c in "btr")).collect()
    sums.sort(key=lambda r: (r.large is None, r.large or 0, r.cell or 0))
    capacity = [max(x, 1.0) / shards for x in total]
    items, vectors = [], []
    for r in sums:
        v = np.array([r.b / capacity[0], r.t / capacity[1], r.r / capacity[2]])
        pieces = int(np.ceil(4 * v.max())) if r.large is not None and v.max() > 1 else 1
        for p in range(pieces):
            items.append((r.large, r.cell, pieces, p))
            vectors.append(v / pieces)
    put = pack(np.array(vectors), shards, setting.weights) if items else []
    plan = [(*x, int(s)) for x, s in zip(items, put)]
    # both bounded by the number of cells, so they can be broadcast
    large = spark.createDataFrame([(g, n) for g, _, n, p, _ in plan if g is not None and p == 0], "large long, pieces int")
    places = spark.createDataFrame([(g if g is not None else c, g is not None, p, s) for g, c, _, p, s in plan], "p_key long, p_large boolean, p_piece int, shard int")
    rows = rows.join(F.broadcast(large), F.col("group") == F.col("large"), "left")
    rows = rows.withColumn("key", F.coalesce(F.col("large"), cell))
    # a hash leaves nulls out, so rows of small groups are spread by id and text alone
    rows = rows.withColumn("spread", F.xxhash64("doc_id", "group", F.when(F.col("large").isNotNull(), F.col("number"))))
    kept = rows.where("pieces is null or pieces = 1").withColumn("piece", F.lit(0))
    rows = kept.unionByName(_dealt(rows.where("pieces > 1"))) if any(n > 1 for _, _, n, _, _ in plan) else kept
    rows = rows.join(F.broadcast(places), (F.col("key") == F.col("p_key")) & (F.col("large").isNotNull() == F.col("p_large")) & (F.col("piece") == F.col("p_piece")))
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("spread", F.lit(7)), F.lit(setting.sub_buckets)).cast("int"))
    counts = rows.groupBy("shard", "sub").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(F.col("shard").alias("c_shard"), F.col("sub").alias("c_sub"), (F.sum("n").over(Window.partitionBy("shard").orderBy("sub")) - F.col("n")).alias("base"))
    # shards x sub_buckets rows
    rows = rows.join(F.broadcast(counts), (F.col("shard") == F.col("c_shard")) & (F.col("sub") == F.col("c_sub")))
    order = Window.partitionBy("shard", "sub").orderBy("spread", "doc_id", "text_crc32", "size")
    slot = (F.col("base") + F.row_number().over(order) - 1).cast("long")
    return rows.withColumn("shard", F.col("shard").cast("int")).withColumn("slot", slot)
