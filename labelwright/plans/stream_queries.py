"""Queries that run as streams over the given tables, and lanes over one shared table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import verdicts as V
from ..operators.lanes import fan_out
from ..storage import new_dir
from ..streaming import cache, confirmed, latest, once_each, ttl_cache, upsert_latest
from .registry import load, query
from .verdict_queries import VERDICT_VIEWS, item_verdicts, verdict_sql


def _in_slices(rows: DataFrame, order: Column, sink: Callable[[DataFrame], DataStreamWriter], parts: int = 3) -> None:
    """Runs a stream over the rows as they arrive: slices by quantile of the order, one after the other, the query started
    anew for each from its checkpoint."""
    spark = rows.sparkSession
    path, checkpoint = new_dir(spark, "arriving"), new_dir(spark, "checkpoint")
    cuts = rows.select(F.percentile_approx(order, [k / parts for k in range(1, parts)])).first()[0] or []
    edges = [float("-inf"), *cuts, float("inf")]
    for a, b in zip(edges, edges[1:]):
        rows.where((order > a) & (order <= b)).write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        sink(stream).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@query(
    "st1_cache_stream",
    (),
    """WITH asked AS (SELECT user_id AS key, date_trunc('millisecond', ts) AS ts, CASE WHEN event_id % 3 > 0 THEN event_type END AS fetched FROM events),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, fetched NULLS LAST) AS n FROM asked),
    climb AS (
        SELECT key, n, ts, CASE WHEN fetched IS NULL THEN 'missing' ELSE 'fetched' END AS state, fetched AS value, CASE WHEN fetched IS NOT NULL THEN ts END AS held_at FROM numbered WHERE n = 1
        UNION ALL
        SELECT q.key, q.n, q.ts, CASE WHEN date_diff('day', c.held_at, q.ts) <= 7 THEN 'fresh' WHEN q.fetched IS NOT NULL THEN 'fetched' WHEN c.held_at IS NOT NULL THEN 'stale_cache_served' ELSE 'missing' END,
               CASE WHEN date_diff('day', c.held_at, q.ts) <= 7 THEN c.value ELSE coalesce(q.fetched, c.value) END,
               CASE WHEN date_diff('day', c.held_at, q.ts) <= 7 OR q.fetched IS NULL THEN c.held_at ELSE q.ts END
        FROM climb c JOIN numbered q ON q.key = c.key AND q.n = c.n + 1)
    SELECT key, ts, state, value FROM climb""",
)
def cache_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event asks for its user's entry; a third of the fetches fail. In three restarts, on the state of the one before."""
    events = load(spark, sf_dir, "events")
    fetched = F.when(F.col("event_id") % 3 > 0, F.col("event_type"))
    asked = events.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), fetched.alias("fetched"))
    out, before = new_dir(spark, "served"), spark.conf.get(cache.PROVIDER[0])
    spark.conf.set(*cache.PROVIDER)
    try:
        _in_slices(asked, F.col("ts").cast("double"), lambda s: ttl_cache(s).writeStream.format("parquet").option("path", out).outputMode("append"))
    finally:
        spark.conf.set(cache.PROVIDER[0], before)
    return spark.read.parquet(out).select("key", F.col("ts").cast("timestamp_ntz").alias("ts"), "state", "value")


@query("st2_upsert_stream", (), "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def upsert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user, kept by a sink that may run a batch twice."""
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    path = new_dir(spark, "latest")
    _in_slices(rows, F.col("event_id").cast("double"), lambda s: s.writeStream.foreachBatch(upsert_latest(path, "user_id", "event_id")))
    return latest(spark, path, "user_id", "event_id", "user_id long, event_id long, event_type string")


@query("st3_review_stream", (), "SELECT DISTINCT conv_id, 'reviewed' AS state FROM conversations")
def review_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations come turn by turn; each is reviewed once, when its first turn comes."""
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"))
    path = new_dir(spark, "reviewed")
    review = once_each(path, "conv_id", lambda new: new.select("conv_id", F.lit("reviewed").alias("state")).distinct())
    _in_slices(rows, F.col("turn").cast("double"), lambda s: s.writeStream.foreachBatch(review))
    return spark.read.schema("conv_id long, state string").option("recursiveFileLookup", "true").parquet(path)


@query(
    "st5_confirmations",
    (),
    """WITH p AS (SELECT event_id, user_id AS key, ts AS paused_at FROM events WHERE event_type = 'view'), c AS (SELECT user_id AS key, ts AS confirmed_at, event_id AS choice FROM events WHERE event_type = 'purchase')
    SELECT p.event_id, c.choice, CASE WHEN c.choice IS NULL THEN 'unconfirmed' ELSE 'confirmed' END AS state
    FROM p LEFT JOIN c ON p.key = c.key AND c.confirmed_at >= p.paused_at AND c.confirmed_at <= p.paused_at + INTERVAL 2 DAY""",
)
def confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views wait two days for purchases of the same user; the stream form is held against this one in the tests."""
    events = load(spark, sf_dir, "events")
    paused = events.where("event_type = 'view'").select("event_id", F.col("user_id").alias("key"), F.col("ts").alias("paused_at"))
    said = events.where("event_type = 'purchase'").select(F.col("user_id").alias("key"), F.col("ts").alias("confirmed_at"), F.col("event_id").alias("choice"))
    return confirmed(paused, said).select("event_id", "choice", "state")


_BLOCKING = "headline IN ('not_authorised_eu', 'not_permitted_in_category') AND verdict_certainty = 'certain'"


@query(
    "st4_advisory_lanes",
    VERDICT_VIEWS,
    verdict_sql(f""", counted AS (SELECT label_id, count(*) FILTER (WHERE b = 'blocked') AS n_blocked, count(*) FILTER (WHERE b = 'review') AS n_review FROM (
        SELECT label_id, CASE WHEN headline IN ('unresolved', 'category_unknown') OR category_conflict THEN 'review' WHEN {_BLOCKING} THEN 'blocked' ELSE 'other' END AS b FROM verdicts) GROUP BY label_id),
    blocked AS (SELECT label_id, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS ids FROM verdicts WHERE {_BLOCKING} GROUP BY label_id),
    sensitive AS (SELECT label_id, count(*) AS n_sensitive FROM verdicts WHERE category_sensitive GROUP BY label_id)
    SELECT c.label_id, n_blocked, n_review, b.ids AS blocked, n_sensitive FROM counted c LEFT JOIN blocked b ON c.label_id = b.label_id LEFT JOIN sensitive s ON c.label_id = s.label_id"""),
)
def advisory_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, blocked items and sensitive items of each label: three lanes over the verdicts, which are computed once."""
    blocking = V.is_blocking(F.col("headline"), F.col("verdict_certainty"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda x: x.cast("string")), ",")
    lanes = {
        "counts": lambda v: V.count_buckets(v).select("label_id", "n_blocked", "n_review"),
        "blocked": lambda v: v.where(blocking).groupBy("label_id").agg(ids.alias("ids")),
        "sensitive": lambda v: v.where("category_sensitive").groupBy("label_id").agg(F.count(F.lit(1)).alias("n_sensitive")),
    }
    verdicts = item_verdicts(spark, sf_dir).select("label_id", "item_id", "headline", "verdict_certainty", "category_conflict", "category_sensitive")
    merged = fan_out(verdicts, lanes, "label_id")
    return merged.select("label_id", "counts.n_blocked", "counts.n_review", F.col("blocked.ids").alias("blocked"), "sensitive.n_sensitive")
