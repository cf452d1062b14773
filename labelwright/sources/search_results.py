"""Recorded search responses: one JSON document a query, read as rows, searched by query, domain and age."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import rfc2822_date
from .readers import exists

RESPONSE = "query string, answer string, results array<struct<title: string, url: string, content: string, published_date: string, score: double>>"


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """query, place, title, url, content, published_raw, published, score of every result below path; nothing there, no rows.

    A response that brings an answer written by the provider stops the read: no such text may pass for a source. Texts that
    are missing are empty, dates that can't be read are null beside their text, scores stay null.
    """
    responses = spark.read.schema(RESPONSE).json(path) if exists(spark, path) else spark.createDataFrame([], RESPONSE)
    written_answer = F.raise_error(F.concat(F.lit("a response holds an answer of the provider: "), F.coalesce("query", F.lit("")))).cast("boolean")
    clean = responses.where(F.when(F.col("answer").isNull(), True).otherwise(written_answer))
    rows = clean.select("query", F.posexplode("results").alias("place", "r"))
    text = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit("")).alias(c)
    return rows.select(
        "query", "place", text("title"), text("url"), text("content"), F.col("r.published_date").alias("published_raw"), rfc2822_date(F.col("r.published_date")).alias("published"), F.col("r.score").alias("score")
    )


def host(url: str) -> F.Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def search(results: DataFrame, queries: DataFrame, domains: list[str] | None = None, days: int | None = None, as_of: str | None = None) -> DataFrame:
    """The recorded results of each distinct query, in their order; a query that nobody recorded has none.

    domains: only these hosts and what is below them. days: only results published at most so many days before as_of; a result
    without a readable date is not one of them.
    """
    found = queries.select("query").distinct().join(results, "query")
    if domains:
        own = host("url")
        keep = F.lit(False)
        for d in domains:
            keep = keep | (own == d.lower()) | F.endswith(own, F.lit("." + d.lower()))
        found = found.where(keep)
    if days is not None:
        found = found.where(F.datediff(F.lit(as_of).cast("date") if as_of else F.current_date(), "published").between(0, days))
    return found
