"""News lanes on an additive or on a trade route: every sentence is a template around a verbatim quote, never composed prose.

The model's answers come as a column of JSON text; what it may not say is dropped here, so no signal touches a verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Kinds of news and their labels in each lane, the route's origin, and its subject without a category.
ADDITIVE_LABELS = {
    "regulatory_review": "Under regulatory review",
    "safety_opinion": "Referenced in a safety opinion",
    "market_action": "Market or import action reported",
    "consumer_alert": "Referenced in a consumer alert",
}
ROUTE_LABELS = {
    "import_control": "EU import control",
    "border_rejection": "Consignments rejected at the EU border",
    "trade_agreement": "Trade agreement development",
    "consumer_alert": "EU consumer alert",
}
ORIGIN, ORIGIN_ADJECTIVE, ANY_CATEGORY = "India", "Indian", "food"


def _label(labels: dict[str, str], kind: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), kind)


def _sentence(subject: Column, label: Column, quote: Column, url: Column, published: Column) -> Column:
    day = F.coalesce(F.concat(F.lit(", "), published.cast("string")), F.lit(""))
    return F.concat(subject, F.lit(": "), label, F.lit(' -- "'), quote, F.lit('" ('), url, day, F.lit(")."))


def additive_sentence(name: Column, kind: Column, quote: Column, url: Column, published: Column) -> Column:
    """Null for a kind without a label."""
    return _sentence(name, _label(ADDITIVE_LABELS, kind), quote, url, published)


def route_sentence(category_name: Column, kind: Column, quote: Column, url: Column, published: Column) -> Column:
    return _sentence(F.concat(F.lit(f"{ORIGIN} "), category_name, F.lit(" exports")), _label(ROUTE_LABELS, kind), quote, url, published)


def additive_query(name: Column) -> Column:
    return F.concat(name, F.lit(" food additive EU regulation"))


def plain_category(name: Column) -> Column:
    """A category's name without its legal citation, with single spaces."""
    return F.array_join(F.filter(F.split(T.without_citation(F.replace(name, F.lit("_"), F.lit(" "))), r"\s+"), lambda w: w != ""), " ")


def route_query(category_name: Column) -> Column:
    subject = F.when(F.coalesce(category_name, F.lit("")) == "", ANY_CATEGORY).otherwise(plain_category(category_name))
    return F.concat(F.lit(f"{ORIGIN_ADJECTIVE} "), subject, F.lit(" exports EU import rules"))


def _checked(results: DataFrame, labels: dict[str, str], sentence: Column) -> DataFrame:
    """results whose answer names a kind of the lane and quotes the source, without contradiction or a word too strong."""
    source = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    rows = results.withColumn("answer", T.strip_fences(F.col("answer"))).withColumn("source_text", source)
    rows = rows.withColumn("category", F.get_json_object("answer", "$.category")).withColumn("quoted_span", F.get_json_object("answer", "$.quoted_span"))
    rows = rows.where(F.col("category").isin(*labels) & (F.col("quoted_span") != "") & T.quotes_verbatim(F.col("quoted_span"), F.col("source_text")))
    rows = rows.where(~T.contradicts_category(F.col("category"), F.col("quoted_span"))).withColumn("sentence", sentence)
    rows = rows.where(F.size(T.unbacked_modality(F.col("sentence"), F.col("source_text"))) == 0)
    found = [
        F.when(~T.is_well_formed_url(F.col("url")), "malformed_source_url"),
        F.when(F.col("published_date").isNull(), F.when(F.coalesce("published_raw", F.lit("")) != "", "unparseable_published_date").otherwise("no_published_date")),
        F.col("cache_flag"),
    ]
    return rows.withColumn("flags", F.array_compact(F.array(*found)))


def additive_signals(results: DataFrame, max_keys: int = 12, max_per_key: int = 3) -> DataFrame:
    """Signals of the first additives of each run, from the first relevant results of each.

    results: run, key (the additive), name, ord, title, content, url, published_date, published_raw, score, cache_flag,
    answer; an additive that was asked for and found nothing has a row of nulls, since it takes one of the run's places.
    """
    asked = F.dense_rank().over(Window.partitionBy("run").orderBy("key"))
    rows = results.withColumn("asked", asked).where(F.col("asked") <= max_keys)
    source = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    rows = rows.where(T.meets_score(F.col("score")) & T.is_relevant(F.col("name"), source))
    place = F.row_number().over(Window.partitionBy("run", "key").orderBy("ord"))
    rows = rows.withColumn("place", place).where(F.col("place") <= max_per_key)
    sentence = additive_sentence(F.col("name"), F.col("category"), F.col("quoted_span"), F.col("url"), F.col("published_date"))
    rows = _checked(rows, ADDITIVE_LABELS, sentence).withColumn("search_query", additive_query(F.col("name")))
    return rows.select("run", "key", "ord", "category", "quoted_span", "sentence", "search_query", "flags")


def route_signals(results: DataFrame, max_results: int = 3) -> DataFrame:
    """Signals on the route of each run's product: results as above, with category_name (null: none confirmed) for key and name."""
    rows = results.where(T.meets_score(F.col("score")))
    place = F.row_number().over(Window.partitionBy("run").orderBy("ord"))
    rows = rows.withColumn("place", place).where(F.col("place") <= max_results)
    subject = F.when(F.coalesce("category_name", F.lit("")) == "", ANY_CATEGORY).otherwise(plain_category(F.col("category_name")))
    sentence = route_sentence(subject, F.col("category"), F.col("quoted_span"), F.col("url"), F.col("published_date"))
    rows = _checked(rows, ROUTE_LABELS, sentence).withColumn("search_query", route_query(F.col("category_name")))
    return rows.select("run", "ord", "category", "quoted_span", "sentence", "search_query", "flags")
