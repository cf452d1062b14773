"""Queries that write what they read: JSON with a default, image bytes, recorded searches, stage folders; and substitutes under review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import advisory as A
from ..sources import readers as S
from ..sources import search_results as Q
from ..storage import new_dir
from .advisory_queries import _BLOCKED, _CLASSES
from .registry import load, query
from .resolution_queries import _substances
from .verdict_queries import CLEAN, DEDUP, SELECTED, _permits, lineage_sql


@query("src1_scan_default", (), "SELECT item_id, text, 'file' AS origin FROM benchmark")
def scan_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents written and read with their schema, beside a file that isn't there and reads as no rows."""
    path, schema = new_dir(spark, "json"), "item_id long, text string"
    load(spark, sf_dir, "benchmark").select("item_id", "text").write.json(path)
    there = spark.read.schema(schema).json(path).withColumn("origin", F.lit("file"))
    return there.unionByName(S.read_json(spark, f"{path}-missing", schema).withColumn("origin", F.lit("default")))


@query("src5_images", (), "SELECT sum(octet_length(encode(lang)) + 1 + octet_length(encode(coalesce(source, ''))) + 1)::BIGINT AS n_bytes, true AS whole FROM documents")
def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read as bytes: their lengths are those of their contents, and of the lines written."""
    path = new_dir(spark, "files")
    load(spark, sf_dir, "documents").select(F.concat("lang", F.lit(" "), F.coalesce("source", F.lit(""))).alias("value")).write.text(path)
    files = S.images(spark, path)
    return files.agg(F.sum("length").alias("n_bytes"), F.bool_and(F.octet_length("content") == F.col("length")).alias("whole"))


@query(
    "src18_search_results",
    (),
    """SELECT event_type AS query, event_id, ts::DATE AS published, value AS score FROM events WHERE event_type IN ('view', 'purchase') AND user_id % 3 = 0 AND ts::DATE BETWEEN DATE '2024-01-21' AND DATE '2024-01-31'""",
)
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses recorded from the events, read back and searched for two queries, one domain and ten days."""
    path = new_dir(spark, "searches")
    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    site = F.when(F.col("user_id") % 3 == 0, "https://news.example.org/").otherwise("https://example.org.other.net/")
    result = F.struct(F.col("event_id").cast("string").alias("title"), F.concat(site, "event_id").alias("url"), F.lit("x").alias("content"), F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("published_date"), F.col("value").alias("score"))
    # twenty events a response at most, so none grows with the table
    e.groupBy(F.col("event_type").alias("query"), F.floor(F.col("event_id") / 20).alias("part")).agg(F.collect_list(result).alias("results")).select("query", "results").write.json(path)
    queries = spark.createDataFrame([("view",), ("purchase",), ("nobody asked",), ("view",)], "query string")
    found = Q.search(Q.recorded(spark, path), queries, ["example.org"], 10, "2024-01-31")
    return found.select("query", F.col("title").cast("long").alias("event_id"), "published", "score")


@query("snk1_stage_folders", (), "SELECT n_regionkey % 2 AS label, CASE WHEN n_regionkey % 2 = 1 THEN 'resolve' ELSE 'extract' END AS stage, count(*) AS n FROM nation GROUP BY 1, 2 UNION ALL SELECT n_regionkey % 2, CASE WHEN n_regionkey % 2 = 1 THEN 'extract' ELSE 'resolve' END, count(*) FROM nation GROUP BY 1, 2")
def stage_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages of two labels, one of them written twice: the second time replaces that folder alone."""
    path = new_dir(spark, "stages")
    rows = load(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_regionkey") % 2).cast("long").alias("label"))
    S.write_stages(rows.withColumn("stage", F.explode(F.array(F.lit("extract"), F.lit("resolve")))), path, by=("label", "stage"))
    S.write_stages(rows.where("label = 1").withColumn("stage", F.lit("resolve")), path, by=("label", "stage"))
    back = spark.read.schema("n_nationkey int, label long, stage string").parquet(path)
    return back.groupBy("label", "stage").agg(F.count(F.lit(1)).alias("n"))


_FLAGGED = "CAST(regexp_extract(canonical_id, '^[0-9]+', 0) AS int) % 3 = 0"


@query(
    "tk10_review_last",
    ("items", "permits", "substances"),
    "WITH " + ", ".join([CLEAN.format(table="permits"), DEDUP, SELECTED]) + f""", pairs AS ({_BLOCKED}),
    cand AS (SELECT code AS candidate_id, fcs_code, level, code IN (SELECT canonical_id FROM clean WHERE {_FLAGGED}) AS review FROM selected WHERE code NOT IN (SELECT canonical_id FROM clean WHERE status = 'prohibited')),
    ids AS (SELECT DISTINCT blocked_id AS x FROM pairs UNION SELECT DISTINCT candidate_id FROM cand), {lineage_sql('steps', 'ids', 'x')}, {_CLASSES},
    met AS (
        SELECT p.blocked_id, p.fcs_code, p.blocked_level, c.candidate_id, c.level, c.review, len(list_intersect(a.classes, b.classes)) AS n_shared
        FROM pairs p JOIN cand c ON p.fcs_code = c.fcs_code AND p.blocked_id <> c.candidate_id JOIN classes a ON a.id = p.blocked_id JOIN classes b ON b.id = c.candidate_id
        WHERE (blocked_level IS NULL OR level IS NULL OR level >= blocked_level)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY blocked_id, fcs_code, blocked_level ORDER BY review::INTEGER, n_shared DESC, coalesce(level, 1e308) DESC, candidate_id) AS place FROM met WHERE n_shared > 0)
    SELECT blocked_id, fcs_code, blocked_level, candidate_id, review, place FROM placed WHERE place <= 5""",
)
def review_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: five substitutes of each blocked substance, those under review (every third family) after all others."""
    code = F.concat((1 + F.col("label_id") % 18).cast("string"), F.lit(""))
    blocked = load(spark, sf_dir, "items").select(F.col("canonical_id").alias("blocked_id"), F.when(F.col("item_id") % 3 == 0, 200.0).alias("blocked_level"), code.alias("fcs_code"))
    permits = _permits(spark, sf_dir)
    rows = A.substitutes(blocked, permits, _substances(spark, sf_dir), permits.where(_FLAGGED).select("canonical_id"))
    return rows.select("blocked_id", "fcs_code", "blocked_level", "candidate_id", F.coalesce("review", F.lit(False)).alias("review"), F.col("place").cast("long").alias("place"))
