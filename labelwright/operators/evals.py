"""Evaluation: multiset recall, structure, golden comparison, confusion, regression against the last run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def multiset_scores(golden: DataFrame, found: DataFrame, by: str, key: str) -> DataFrame:
    """Per group: n golden, n found, n in common (with multiplicity; nulls have nothing in common), recall and precision.

    Both sides are one table that is counted by key: neither is sorted to meet the other.
    """
    sides = golden.select(by, key, F.lit(1).alias("g"), F.lit(0).alias("f")).unionByName(found.select(by, key, F.lit(0).alias("g"), F.lit(1).alias("f")))
    both = sides.groupBy(by, key).agg(F.sum("g").alias("g"), F.sum("f").alias("f"))
    common = F.when(F.col(by).isNotNull() & F.col(key).isNotNull(), F.least("g", "f")).otherwise(0)
    s = both.groupBy(by).agg(F.sum("g").alias("n_golden"), F.sum("f").alias("n_found"), F.sum(common).alias("n_common"))
    share = lambda n: F.when(F.col(n) > 0, F.col("n_common") / F.col(n)).otherwise(1.0)
    return s.withColumn("recall", share("n_golden")).withColumn("precision", share("n_found"))


def structure_accuracy(golden: DataFrame, found: DataFrame, by: str, key: str, order: str, fields: list[str]) -> DataFrame:
    """Per group: the k-th duplicate of a key on one side meets the k-th on the other; shares that agree in every field."""
    w = Window.partitionBy(by, key).orderBy(order)
    g = golden.withColumn("k", F.row_number().over(w)).select(by, key, "k", *(F.col(c).alias(f"g_{c}") for c in fields))
    f = found.withColumn("k", F.row_number().over(w)).select(by, key, "k", *(F.col(c).alias(f"f_{c}") for c in fields))
    agree = F.lit(True)
    for c in fields:
        agree = agree & F.col(f"g_{c}").eqNullSafe(F.col(f"f_{c}"))
    pairs = g.join(f, [by, key, "k"]).withColumn("agree", agree)
    return pairs.groupBy(by).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if("agree").alias("n_agree"))


def compare_sides(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every key of either side: only_a, only_b, agree or disagree."""
    x = a.select(*keys, F.col(value).alias("va"), F.lit(True).alias("ia"))
    y = b.select(*keys, F.col(value).alias("vb"), F.lit(True).alias("ib"))
    both = x.join(y, keys, "full_outer")
    outcome = F.when(F.col("ib").isNull(), "only_a").when(F.col("ia").isNull(), "only_b").when(F.col("va").eqNullSafe(F.col("vb")), "agree").otherwise("disagree")
    return both.select(*keys, outcome.alias("outcome"))


def confusion(proposed: Column, truth: Column, declined: Column, should_decline: Column) -> Column:
    return (
        F.when(should_decline.isNull(), "unscored").when(declined, F.when(should_decline, "correctly_declined").otherwise("wrongly_declined"))
        .when(~should_decline & proposed.eqNullSafe(truth), "correct").otherwise("wrong")
    )


def regressions(runs: DataFrame, by: list[str], order: str, metric: str) -> DataFrame:
    """Each run with the change of its metric since the one before."""
    w = Window.partitionBy(*by).orderBy(order)
    return runs.withColumn("change", F.col(metric) - F.lag(metric).over(w))


def merged_maps(left: Column, right: Column) -> Column:
    """Union of two maps, the right one winning."""
    kept = F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(kept, right)
