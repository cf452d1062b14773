"""Fan-out and merge: lanes that read one table, run side by side, and are joined by key."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import new_dir, written

Lane = Callable[[DataFrame], DataFrame]


def fan_out(shared: DataFrame, lanes: dict[str, Lane], key: str, at_once: int = 8) -> DataFrame:
    """key and, per lane, a struct of the lane's other columns; a key that a lane says nothing on has null there.

    The shared table is computed and written once, and every lane reads that. Lanes are independent jobs, each in a
    scheduler pool of its own name, so that with fair scheduling a short lane does not wait for a long one; none sees
    another's result. A lane has one row per key at most; a second one is an error of the lane and raises when the result
    is read. A null key is a key. A lane that fails fails the whole, as a merged row without it would look complete.
    """
    spark = shared.sparkSession
    table = written(shared, "lanes-shared")

    def run(name: str) -> DataFrame:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            rows = lanes[name](table)
            own = F.struct(*(c for c in rows.columns if c != key)).alias("own")
            path = new_dir(spark, f"lane-{name}")
            rows.select(key, F.lit(name).alias("lane"), own).write.parquet(path)
            return spark.read.parquet(path)
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(min(at_once, len(lanes))) as pool:
        done = dict(zip(lanes, pool.map(inheritable_thread_target(spark)(run), lanes)))
    # one aggregate puts all lanes together: their rows are shuffled once, and no lane is the base of an outer join
    wide = None
    for name, rows in done.items():
        columns = [key, *(F.col("own").alias(n) if n == name else F.lit(None).cast(done[n].schema["own"].dataType).alias(n) for n in done)]
        wide = rows.select(*columns) if wide is None else wide.unionByName(rows.select(*columns))
    merged = wide.groupBy(key).agg(*(F.any_value(n, ignoreNulls=True).alias(n) for n in done), *(F.count(n).alias(f"__n_{n}") for n in done))
    once = F.greatest(*(F.col(f"__n_{n}") for n in done), F.lit(0)) <= 1
    checked = merged.where(F.when(once, True).otherwise(F.raise_error(F.lit("a lane has two rows of one key")).cast("boolean")))
    return checked.select(key, *done)
