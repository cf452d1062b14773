"""The lookups that a review of an item may call, and the rules its proposal must meet. Each takes a table of questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalise import normalise_code, normalise_text, parent_ins
from ..functions.text import strip_fences
from .resolution import fuzzy_match, registry

# What a proposal may classify as, and how sure it may be.
CLASSIFICATIONS = ("additive", "food_ingredient", "flavouring", "enzyme", "unknown")
CONFIDENCES = ("high", "medium", "low")


def codex(asks: DataFrame, substances: DataFrame, synonyms: DataFrame) -> DataFrame:
    """query, found, matched_on, ins, name, functional_classes, parent_ins: by code, broader code, name, synonym, then a like name.

    asks: query; substances: row_ord, ins, name, functional_classes; synonyms: row_ord, ins, term.
    """
    q = asks.select("query").distinct()
    code, text = normalise_code(F.col("query")), normalise_text(F.col("query"))
    tried = [(1, "code_exact", code), (2, "code_parent", parent_ins(code)), (3, "name_exact", text), (4, "synonym_exact", text)]
    probes = q.select("query", F.explode(F.array(*(F.struct(F.lit(t).alias("tier"), k.alias("key"), F.lit(m).alias("matched_on")) for t, m, k in tried))).alias("p")).select("query", "p.*")
    codes = substances.select(F.col("ins").alias("key"), "ins").distinct()
    named = substances.groupBy(normalise_text(F.col("name")).alias("key")).agg(F.min_by("ins", "row_ord").alias("ins"))
    called = synonyms.groupBy(normalise_text(F.col("term")).alias("key")).agg(F.min_by("ins", "row_ord").alias("ins"))
    known = reduce(DataFrame.unionByName, (t.select(F.lit(k).alias("tier"), "key", "ins") for k, t in ((1, codes), (2, codes), (3, named), (4, called))))
    hit = probes.join(known, ["tier", "key"]).groupBy("query").agg(F.min_by(F.struct("matched_on", "ins"), "tier").alias("hit")).select("query", "hit.*")
    like = fuzzy_match(q.join(hit, "query", "left_anti").select(F.col("query").alias("name")), substances)
    like = like.select(F.col("name").alias("query"), F.concat(F.lit("fuzzy (score "), F.round("score").cast("int").cast("string"), F.lit(")")).alias("matched_on"), "ins")
    rows = q.join(hit.unionByName(like), "query", "left").join(registry(substances), "ins", "left")
    return rows.select("query", F.col("ins").isNotNull().alias("found"), "matched_on", "ins", "name", "functional_classes", parent_ins(F.col("ins")).alias("parent_ins"))


def eu_list(asks: DataFrame, permits: DataFrame) -> DataFrame:
    """query, found, canonical_id, additive_name, statuses (sorted), n_rows, source_url: the exact code alone, first row by row_ord."""
    first = lambda c: F.min_by(c, "row_ord").alias(c)
    held = permits.groupBy("canonical_id").agg(first("additive_name"), F.array_sort(F.collect_set("status")).alias("statuses"), F.count(F.lit(1)).alias("n_rows"), first("source_url"))
    rows = asks.select("query").distinct().withColumn("code", normalise_code(F.col("query"))).join(held, F.col("code") == F.col("canonical_id"), "left")
    return rows.select("query", F.col("canonical_id").isNotNull().alias("found"), "canonical_id", "additive_name", "statuses", "n_rows", "source_url")


def food_lexicon(asks: DataFrame, terms: DataFrame) -> DataFrame:
    """query, is_known_food, matched_term, match_type, score: the first term (by row_ord) alike but for case and space, else the likest one."""
    q = asks.select("query").distinct()
    known = terms.groupBy(normalise_text(F.col("term")).alias("key")).agg(F.min_by("term", "row_ord").alias("matched_term"))
    exact = q.join(known, normalise_text(F.col("query")) == F.col("key")).select("query", "matched_term", F.lit("exact").alias("match_type"), F.lit(100.0).alias("score"))
    left = q.join(exact, "query", "left_anti").select(F.col("query").alias("name"))
    like = fuzzy_match(left, terms.select("row_ord", F.col("term").alias("ins"), F.col("term").alias("name")))
    like = like.select(F.col("name").alias("query"), F.col("ins").alias("matched_term"), F.lit("fuzzy").alias("match_type"), "score")
    rows = q.join(exact.unionByName(like), "query", "left")
    return rows.select("query", F.col("matched_term").isNotNull().alias("is_known_food"), "matched_term", "match_type", "score")


def family(asks: DataFrame, substances: DataFrame) -> DataFrame:
    """ask_id, members (ins, name, functional_classes, in the order asked) and not_found. asks: ask_id, codes."""
    each = asks.select("ask_id", F.posexplode_outer("codes").alias("at", "asked"))
    rows = each.join(registry(substances), normalise_code(F.col("asked")) == F.col("ins"), "left")
    listed = lambda cond, c: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("at", c.alias("x"))))), lambda e: e["x"])
    member = F.struct("ins", "name", "functional_classes")
    return rows.groupBy("ask_id").agg(listed(F.col("ins").isNotNull(), member).alias("members"), listed(F.col("ins").isNull() & F.col("asked").isNotNull(), F.col("asked")).alias("not_found"))


def product_context(items: DataFrame, products: DataFrame) -> DataFrame:
    """items (label_id, item_id, name) with their product's columns and the names of the other items of the label, in order."""
    named = F.collect_list(F.when(F.col("name").isNotNull(), F.struct("item_id", "name"))).over(Window.partitionBy("label_id"))
    rows = items.withColumn("__all", F.array_sort(named)).join(products, "label_id", "left")
    others = F.transform(F.filter("__all", lambda x: x["item_id"] != F.col("item_id")), lambda x: x["name"])
    return rows.withColumn("other_ingredient_names", others).drop("__all")


def proposal(answer: Column, n_tool_calls: Column) -> Column:
    """The answer as a struct; declined, whatever it says, if it is no JSON object, has no evidence, or no lookup was called.

    A single text as evidence counts as a list of one.
    """
    body = strip_fences(answer)
    v = F.try_parse_json(body)
    got = lambda key: F.try_variant_get(v, f"$.{key}", "string")
    listed = F.coalesce(F.try_variant_get(v, "$.evidence", "array<string>"), F.array(got("evidence")))
    evidence = F.filter(F.transform(listed, lambda e: F.regexp_replace(e, r"^\s+|\s+$", "")), lambda e: F.coalesce(e, F.lit("")) != "")
    reason = (
        F.when(F.coalesce(answer, F.lit("")) == "", "model produced no final answer")
        .when(v.isNull(), "final answer was not valid JSON")
        .when(~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), "final answer was not a JSON object")
        .when(F.size(evidence) == 0, "proposal had no supporting evidence")
        .when(F.coalesce(n_tool_calls, F.lit(0)) == 0, "no tool was called -- nothing to cite as evidence")
    )
    valid = reason.isNull()
    own = F.coalesce(~got("declined").isin("false", "0", ""), F.lit(False))
    said = lambda key, among, other: F.when(valid & got(key).isin(*among), got(key)).otherwise(other)
    return F.struct(
        F.when(valid, got("proposed_canonical_ins")).alias("proposed_canonical_ins"),
        said("proposed_classification", CLASSIFICATIONS, "unknown").alias("proposed_classification"),
        said("confidence", CONFIDENCES, "low").alias("confidence"),
        F.coalesce(got("reasoning"), F.lit("")).alias("reasoning"),
        F.when(valid, evidence).otherwise(F.array().cast("array<string>")).alias("evidence"),
        (~valid | own).alias("declined"),
        F.coalesce(reason, F.when(own, F.nullif(got("decline_reason"), F.lit("")))).alias("decline_reason"),
    )
