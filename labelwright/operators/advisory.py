"""Advisory lanes: substitutes for what is blocked, horizon signals, news caps and the cached fetch. None touches a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalise import lineage, parent_ins
from .provisions import select_rows
from .resolution import registry


def functional_classes(ids: DataFrame, column: str, substances: DataFrame) -> DataFrame:
    """column, classes, inherited: the classes of the nearest registry row of each distinct id; an empty row takes the union of its sub-types'.

    The search stops at the first row that exists, even if it is empty and has no sub-types.
    """
    known = registry(substances).select(F.col("ins").alias("code"), F.col("functional_classes").alias("own"))
    below = known.where(F.size("own") > 0).select(parent_ins(F.col("code")).alias("parent"), F.explode("own").alias("c")).where("parent is not null")
    below = below.groupBy("parent").agg(F.array_sort(F.collect_set("c")).alias("below"))
    known = known.join(below, F.col("code") == F.col("parent"), "left").select("code", "own", "below")
    steps = ids.select(column).where(F.col(column).isNotNull()).distinct().select(column, F.posexplode(lineage(F.col(column))).alias("step", "code"))
    near = steps.join(known, "code").groupBy(column).agg(F.min_by(F.struct("own", "below"), "step").alias("hit"))
    empty = F.size("hit.own") == 0
    return near.select(column, F.when(empty, F.coalesce("hit.below", F.array().cast("array<string>"))).otherwise(F.col("hit.own")).alias("classes"), (empty & F.col("hit.below").isNotNull()).alias("inherited"))


def substitutes(blocked: DataFrame, permits: DataFrame, substances: DataFrame, flagged: DataFrame | None = None, limit: int = 5) -> DataFrame:
    """The best substitutes of each distinct (blocked_id, fcs_code, blocked_level): permitted in the same category, not
    prohibited anywhere, sharing a functional class, with a level no lower. Under-review ones come last, then fewer
    shared classes, then lower levels (no numeric level ranks highest), then the id.

    Work is per distinct blocked pair, joined on the category and on a shared class, so no category is crossed whole.
    """
    pairs = blocked.select("blocked_id", "fcs_code", "blocked_level").distinct()
    banned = permits.where("status = 'prohibited'").select(F.col("canonical_id").alias("candidate_id")).distinct()
    chosen = select_rows(permits.where("fcs_code <> ''"), "canonical_id", "fcs_code").select(F.col("canonical_id").alias("candidate_id"), "fcs_code", F.col("max_level_mg_kg").alias("level"))
    chosen = chosen.join(banned, "candidate_id", "left_anti")
    own = functional_classes(pairs, "blocked_id", substances).select("blocked_id", F.explode("classes").alias("cls"))
    theirs = functional_classes(chosen, "candidate_id", substances).select("candidate_id", F.explode("classes").alias("cls"))
    left, right = pairs.join(own, "blocked_id"), chosen.join(theirs, "candidate_id")
    met = left.join(right, ["fcs_code", "cls"]).where("blocked_id <> candidate_id and (blocked_level is null or level is null or level >= blocked_level)")
    shared = met.groupBy("blocked_id", "fcs_code", "blocked_level", "candidate_id", "level").agg(F.count_distinct("cls").alias("n_shared"))
    if flagged is not None:
        shared = shared.join(flagged.select(F.col("canonical_id").alias("candidate_id"), F.lit(True).alias("review")).distinct(), "candidate_id", "left")
    else:
        shared = shared.withColumn("review", F.lit(False))
    w = Window.partitionBy("blocked_id", "fcs_code", "blocked_level").orderBy(F.coalesce("review", F.lit(False)).cast("int"), F.desc("n_shared"), F.desc(F.coalesce("level", F.lit(float("inf")))), "candidate_id")
    return shared.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def suggestions(blocking: DataFrame, permits: DataFrame, substances: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """blocking (label_id, item_id, blocked_id, fcs_code, blocked_level) with candidates, best first, and the reason where there are none.

    Candidates are found once per distinct pair and joined back to the items.
    """
    found = substitutes(blocking.where("fcs_code is not null"), permits, substances, flagged)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "candidate_id"))), lambda x: x["candidate_id"])
    found = found.groupBy(F.col("blocked_id").alias("f_id"), F.col("fcs_code").alias("f_code"), F.col("blocked_level").alias("f_level")).agg(ordered.alias("candidates"))
    classed = functional_classes(blocking, "blocked_id", substances).where(F.size("classes") > 0).select(F.col("blocked_id").alias("c_id"), F.lit(True).alias("classed"))
    same = (F.col("blocked_id") == F.col("f_id")) & (F.col("fcs_code") == F.col("f_code")) & F.col("blocked_level").eqNullSafe(F.col("f_level"))
    rows = blocking.join(found, same, "left").join(classed, F.col("blocked_id") == F.col("c_id"), "left")
    reason = (
        F.when(F.col("fcs_code").isNull(), "no food category available")
        .when(F.col("classed").isNull(), "functional class of the blocked additive is unknown")
        .when(F.col("candidates").isNull(), "no permitted additive of this category shares a functional class")
    )
    return rows.select(*blocking.columns, F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"), reason.alias("reason"))



def horizon(items: DataFrame, signals: DataFrame, as_of_year: int, max_age: int = 5) -> DataFrame:
    """Signals met by id, else by name where the id meets none; those too old, or without a year, are excluded with a reason.

    items: key, canonical_id, name; signals: canonical_id, substance_name, signal_year and more.
    """
    by_id = signals.select(F.col("canonical_id").alias("s_id"), F.struct(*signals.columns).alias("signal"))
    by_name = signals.select(F.lower("substance_name").alias("s_name"), F.struct(*signals.columns).alias("signal"))
    first = items.join(by_id, F.col("canonical_id") == F.col("s_id"))
    rest = items.join(by_id.select("s_id").distinct(), F.col("canonical_id") == F.col("s_id"), "left_anti").join(by_name, F.lower("name") == F.col("s_name"))
    met = first.select(*items.columns, "signal", F.lit("id").alias("matched_by")).unionByName(rest.select(*items.columns, "signal", F.lit("name").alias("matched_by")))
    age = F.lit(as_of_year) - F.col("signal.signal_year")
    reason = F.when(age.isNull(), "no_year").when(age > max_age, "too_old")
    return met.withColumn("excluded", reason)


def capped(results: DataFrame, max_keys: int = 12, max_per_key: int = 3) -> DataFrame:
    """The first results per key, for the first keys of each run. results: run, key, ord."""
    keys = F.dense_rank().over(Window.partitionBy("run").orderBy("key"))
    place = F.row_number().over(Window.partitionBy("run", "key").orderBy("ord"))
    return results.withColumn("key_rank", keys).withColumn("place", place).where((F.col("key_rank") <= max_keys) & (F.col("place") <= max_per_key))


def cached_fetch(wanted: DataFrame, cache: DataFrame, fetched: DataFrame, as_of: str, ttl_days: int = 7) -> DataFrame:
    """One row per wanted key: the cached value while at most ttl_days old, else the new fetch, else the old value marked
    stale; a key with neither is marked missing. wanted: key; cache: key, fetched_at, value; fetched: key, value (null: failed)."""
    c = cache.groupBy("key").agg(F.max_by(F.struct("fetched_at", "value"), "fetched_at").alias("c"))
    f = fetched.where("value is not null").groupBy("key").agg(F.max("value").alias("new"))
    rows = wanted.select("key").distinct().join(c, "key", "left").join(f, "key", "left")
    age = F.datediff(F.lit(as_of).cast("date"), F.col("c.fetched_at"))
    fresh = F.coalesce(age <= ttl_days, F.lit(False))
    state = F.when(fresh, "fresh").when(F.col("new").isNotNull(), "fetched").when(F.col("c").isNotNull(), "stale_cache_served").otherwise("missing")
    return rows.select("key", state.alias("state"), F.when(fresh, F.col("c.value")).otherwise(F.coalesce("new", F.col("c.value"))).alias("value"))
