"""Lanes over one shared table: merged rows, one computation, failures."""

import pytest
from pyspark.sql import functions as F

from labelwright.operators.lanes import fan_out


def test_lanes_are_merged_by_key_and_the_table_is_computed_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    shared = spark.createDataFrame([(1, 5), (1, 6), (2, 7), (None, 8)], "k int, v int").coalesce(1).mapInArrow(counted, "k int, v int")
    lanes = {
        "sums": lambda t: t.groupBy("k").agg(F.sum("v").alias("s")),
        "large": lambda t: t.where("v > 6").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("m")),
        "none": lambda t: t.where("false").groupBy("k").agg(F.max("v").alias("x")),
    }
    got = {r.k: (r.sums.s, r.large and tuple(r.large), r.none) for r in fan_out(shared, lanes, "k").collect()}
    assert got == {1: (11, None, None), 2: (7, (1, 7), None), None: (8, (1, 8), None)}
    assert runs.value == 4


def test_two_rows_of_one_key_and_failures_are_errors(spark):
    shared = spark.createDataFrame([(1, 5), (1, 6)], "k int, v int")
    with pytest.raises(Exception, match="two rows of one key"):
        fan_out(shared, {"twice": lambda t: t}, "k").collect()
    with pytest.raises(ZeroDivisionError):
        fan_out(shared, {"fails": lambda t: t.limit(1 // 0), "works": lambda t: t.limit(1)}, "k")
    assert fan_out(shared.where("false"), {"none": lambda t: t}, "k").collect() == []
