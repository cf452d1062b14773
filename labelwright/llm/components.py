"""Connected components of an edge table, by alternating large and small stars, without collecting anything."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _large(e: DataFrame) -> DataFrame:
    """Joins the larger neighbours of every node to its least neighbour (or itself)."""
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """Joins the smaller neighbours of every node, and the node, to the least of them; e: a > b."""
    least = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
    joined = e.join(least, F.col("a") == F.col("n")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()


def _labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the least node of each one's component, by spreading minima and jumping to them."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, label[x], label[y])
        np.minimum.at(label, label[y], label[x])
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            return nodes, nodes[label]


def _contracted(e: DataFrame) -> DataFrame:
    """The edges of each task as stars: an edge from every node to the least one it is joined with there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
        if held:
            node, root = _labels(*(np.concatenate(x) for x in zip(*held)))
            other = node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(root[other])], names=["a", "b"])

    return e.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, task_edges: int = 500_000) -> DataFrame:
    """node, root (least node of the component) for every node but the roots. edges: a, b.

    Each round first turns the edges of a task into stars (a task reads a file or some of a bounded size), then joins
    stars over all tasks; rounds go on until nothing moves, which takes about log2 of the longest path. As soon as no
    more than ``task_edges`` edges are left, which is counted, one task turns them into the final stars. Each round is
    written to shared storage, which cuts the lineage, and the former round's table is deleted. Minima are aggregated
    map-side and joined back, so a hub with very many neighbours is a skewed join, which adaptive execution splits, and
    no hot group.
    """
    e = edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b")
    e = written(_contracted(e), "edges")
    before = None
    while True:
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state[0] <= task_edges:
            return _contracted(e.coalesce(1)).select(F.col("a").alias("node"), F.col("b").alias("root"))
        if state == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        former, e = e, written(_small(_large(_contracted(e))), "edges")
        discard(former)
