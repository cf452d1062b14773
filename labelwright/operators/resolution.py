"""Identity: from a declared code or name to a canonical substance, and on to the permission table's ids."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalise import normalise_code, normalise_text, parent_ins
from .name_join import alike, token_set_ratio, with_canonical

# Families whose members must not be guessed.
GUARDED = (
    [f"472{x}" for x in "abcdef"] + [f"160{x}" for x in "abcdef"] + [f"150{x}" for x in "abcd"]
    + [f"{n}{x}" for n in ("341", "339") for x in ("(i)", "(ii)", "(iii)")] + [str(n) for n in (*range(306, 310), *range(620, 626))]
)
FLAVOUR_ENHANCERS = ("flavour enhancer", "flavour enhancers", "flavor enhancer", "flavor enhancers")


def registry(substances: DataFrame) -> DataFrame:
    """One row per ins, the last one (by row_ord) where there are several: ins, name, functional_classes."""
    return substances.groupBy("ins").agg(F.max_by(F.struct("name", "functional_classes"), "row_ord").alias("r")).select("ins", "r.*")


def resolve_by_code(items: DataFrame, substances: DataFrame) -> DataFrame:
    """items with ins, method, confidence and flag from declared_code: exact, else one step broader."""
    known = substances.select(F.col("ins").alias("known")).distinct()
    code = normalise_code(F.col("declared_code"))
    rows = items.withColumn("code", code).withColumn("wider", parent_ins(code))
    rows = rows.join(known.select(F.col("known").alias("k0")), F.col("code") == F.col("k0"), "left").join(known.select(F.col("known").alias("k1")), F.col("wider") == F.col("k1"), "left")
    return rows.select(
        *(c for c in items.columns),
        F.coalesce("k0", "k1").alias("ins"),
        F.when(F.col("k0").isNotNull(), "code_exact").when(F.col("k1").isNotNull(), "code_parent").alias("method"),
        F.when(F.col("k0").isNotNull(), 0.98).when(F.col("k1").isNotNull(), 0.90).otherwise(0.0).alias("confidence"),
        F.when(F.col("k0").isNull() & F.col("k1").isNotNull(), "widened_to_parent").alias("flag"),
    )


def lookups(names: DataFrame, synonyms: DataFrame, aliases: DataFrame, lexicon: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """The name tiers as one table: key, tier, ins, method, confidence.

    names, synonyms, aliases: term, ins, row_ord; lexicon, ambiguous: term. Names and aliases keep their last row,
    synonyms their first.
    """
    key = normalise_text(F.col("term"))
    tiers = [
        names.groupBy(key.alias("key")).agg(F.max_by("ins", "row_ord").alias("ins")).select("key", F.lit(1).alias("tier"), "ins", F.lit("codex_name").alias("method"), F.lit(0.98).alias("confidence")),
        synonyms.groupBy(key.alias("key")).agg(F.min_by("ins", "row_ord").alias("ins")).select("key", F.lit(2).alias("tier"), "ins", F.lit("codex_name").alias("method"), F.lit(0.95).alias("confidence")),
        aliases.groupBy(key.alias("key")).agg(F.max_by("ins", "row_ord").alias("ins")).select("key", F.lit(3).alias("tier"), "ins", F.lit("alias").alias("method"), F.lit(0.92).alias("confidence")),
        lexicon.select(key.alias("key")).distinct().select("key", F.lit(4).alias("tier"), F.lit(None).cast("string").alias("ins"), F.lit("food_lexicon").alias("method"), F.lit(0.95).alias("confidence")),
        ambiguous.select(key.alias("key")).distinct().select("key", F.lit(5).alias("tier"), F.lit(None).cast("string").alias("ins"), F.lit("ambiguous").alias("method"), F.lit(0.0).alias("confidence")),
    ]
    return reduce(DataFrame.unionByName, tiers)


def resolve_by_name(items: DataFrame, tiers: DataFrame) -> DataFrame:
    """items with ins, method and confidence of the first tier that knows the name; the lookup is reduced to one row per key first."""
    best = tiers.groupBy("key").agg(F.min_by(F.struct("ins", "method", "confidence"), "tier").alias("hit"))
    rows = items.withColumn("key", normalise_text(F.coalesce("name_as_declared", F.lit(""))))
    return rows.join(best, "key", "left").select(*items.columns, F.col("hit.ins").alias("ins"), F.coalesce("hit.method", F.lit("unresolved")).alias("method"), F.coalesce("hit.confidence", F.lit(0.0)).alias("confidence"))


def token_set_ratios(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([token_set_ratio(p, q) for p, q in zip(x, y)], dtype="float64")

    return ratio(a, b)


def fuzzy_match(names: DataFrame, substances: DataFrame, least: float = 90.0) -> DataFrame:
    """name, ins, score: the best registry name for each distinct leftover name, the first (by row_ord) of equals.

    Names that may be alike enough meet by keys (name_join), so neither side is gathered or crossed with the other. Names
    of the same words are one name there. Only names that no other tier resolved should come here.
    """
    left = with_canonical(names.select("name").distinct(), "name")
    known = with_canonical(substances.select(F.col("row_ord").cast("long").alias("row_ord"), "ins", "name"), "name")
    known = known.groupBy("text").agg(F.min("row_ord").alias("row_ord"), F.min_by("ins", "row_ord").alias("ins"))
    pairs = alike(left.select("text").distinct(), known, least / 100)
    best = pairs.join(known, F.col("b") == F.col("text")).groupBy("a").agg(F.min_by(F.struct("ins", "score"), F.struct(-F.col("score"), F.col("row_ord"))).alias("hit"))
    return left.join(best, F.col("text") == F.col("a")).select("name", "hit.ins", "hit.score")


def by_family_name(names: DataFrame, permits: DataFrame) -> DataFrame:
    """ins, n_id: of the listed ids of an ins's family, the one whose name is most like codex_name, the first row of equals.

    names: ins, codex_name. A family is an equi-join on the leading digits, so ids meet only their own family's. A listed
    id belongs to it if a bracket, a letter or nothing follows the digits.
    """
    digits = lambda c: F.regexp_extract(c, r"^([0-9]+)", 1)
    known = permits.groupBy("canonical_id").agg(F.min("row_ord").alias("first"), F.max_by("additive_name", "row_ord").alias("listed"))
    rest = F.substring(F.col("canonical_id"), F.length(digits(F.col("canonical_id"))) + 1, F.lit(1))
    known = known.where((rest == "") | (rest == "(") | rest.rlike("^[a-z]")).select("canonical_id", "first", "listed", digits(F.col("canonical_id")).alias("k_family"))
    pairs = names.where("codex_name is not null and ins is not null").distinct().join(known, digits(F.col("ins")) == F.col("k_family"))
    scored = pairs.withColumn("score", token_set_ratios(F.col("codex_name"), F.col("listed"))).where("score > 0")
    return scored.groupBy("ins").agg(F.min_by("canonical_id", F.struct((-F.col("score")).alias("s"), "first")).alias("n_id"))


def crosswalk(resolved: DataFrame, permits: DataFrame) -> DataFrame:
    """eu_canonical_id, eu_flag and eu_cap from ins: exact, else one step broader, else by name within the family, else none.

    The two lists number the same families differently (470(i), 470a), so a code that neither lookup finds is sought by
    likeness of names, where resolved has codex_name and permits have row_ord and additive_name; such a match is flagged
    and caps confidence at 0.75. Enzymes and flavourings are silently absent.
    """
    known = permits.select(F.col("canonical_id").alias("known")).distinct()
    rows = resolved.withColumn("wider", parent_ins(F.col("ins")))
    rows = rows.join(known.select(F.col("known").alias("e0")), F.col("ins") == F.col("e0"), "left").join(known.select(F.col("known").alias("e1")), F.col("wider") == F.col("e1"), "left")
    if "codex_name" in resolved.columns and {"row_ord", "additive_name"} <= set(permits.columns):
        left = rows.where("ins is not null and e0 is null and e1 is null").select("ins", "codex_name")
        rows = rows.join(by_family_name(left, permits).withColumnRenamed("ins", "n_ins"), F.col("ins") == F.col("n_ins"), "left")
    else:
        rows = rows.withColumn("n_id", F.lit(None).cast("string"))
    found = F.coalesce("e0", "e1", "n_id")
    flag = (
        F.when(F.col("ins").isNull() | F.col("e0").isNotNull(), F.lit(None)).when(F.col("e1").isNotNull(), "eu_widened_to_parent")
        .when(F.col("n_id").isNotNull(), "crosswalk_by_name").when(~F.col("classification").isin("enzyme", "flavouring"), "not_in_eu_list")
    )
    return rows.select(*resolved.columns, found.alias("eu_canonical_id"), flag.alias("eu_flag"), F.when(flag == "crosswalk_by_name", 0.75).alias("eu_cap"))


def is_flavouring(role: Column, name: Column) -> Column:
    r = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    text = F.lower(F.concat_ws(" ", r, F.coalesce(name, F.lit(""))))
    return ~r.isin(*FLAVOUR_ENHANCERS) & (F.contains(text, F.lit("flavour")) | F.contains(text, F.lit("flavoring")))


def needs_family_guard(ins: Column, method: Column) -> Column:
    return F.coalesce(ins.isin(*GUARDED) & (method != "code_exact"), F.lit(False))


def resolve_items(items: DataFrame, substances: DataFrame, tiers: DataFrame, permits: DataFrame) -> DataFrame:
    """The whole cascade per item: code or name, family guard, classification, crosswalk, compound override.

    items: label_id, item_id, parent_item_id, declared_code, name_as_declared, declared_role.
    """
    coded = resolve_by_code(items.where("declared_code is not null"), substances).drop("flag")
    named = resolve_by_name(items.where("declared_code is null"), tiers)
    rows = coded.withColumn("method", F.coalesce("method", F.lit("unresolved"))).unionByName(named)
    classes = registry(substances).select(F.col("ins").alias("r_ins"), "functional_classes", F.col("name").alias("codex_name"))
    rows = rows.join(classes, F.col("ins") == F.col("r_ins"), "left").drop("r_ins")
    guard = needs_family_guard(F.col("ins"), F.col("method"))
    enzyme = F.startswith("ins", F.lit("1101(")) | F.coalesce(F.exists("functional_classes", lambda c: F.contains(F.lower(c), F.lit("enzyme"))), F.lit(False))
    role = F.coalesce(F.col("declared_role"), F.lit("")) != ""
    lexical = F.col("method") == "food_lexicon"
    flavour = is_flavouring(F.col("declared_role"), F.col("name_as_declared"))
    kind = (
        F.when(guard | (F.col("method") == "ambiguous"), "ambiguous")
        .when(lexical, F.when(role, "ambiguous").otherwise("food_ingredient"))
        .when(F.col("ins").isNotNull(), F.when(enzyme, "enzyme").otherwise("additive"))
        .when(flavour, "flavouring")
        .otherwise("unknown")
    )
    confidence = F.when(guard, 0.5).when(lexical & role, 0.0).when(F.col("ins").isNull() & (kind == "flavouring"), 0.95).otherwise(F.col("confidence"))
    rows = rows.withColumn("classification", kind).withColumn("confidence", confidence)
    rows = crosswalk(rows, permits).withColumn("confidence", F.least("confidence", "eu_cap"))
    rows = rows.withColumn("classification", F.when(F.col("eu_canonical_id").isNotNull() & F.col("classification").isin("flavouring", "enzyme"), "additive").otherwise(F.col("classification")))
    parents = items.where("parent_item_id is not null").select("label_id", F.col("parent_item_id").alias("item_id"), F.lit(True).alias("is_parent")).distinct()
    rows = rows.join(parents, ["label_id", "item_id"], "left")
    compound = F.coalesce(F.col("is_parent"), F.lit(False)) & (F.col("classification") != "additive")
    return rows.select(
        "label_id", "item_id", "ins", "eu_canonical_id", "eu_flag",
        F.when(compound, "compound").otherwise(F.col("classification")).alias("classification"),
        F.when(compound, "structural").otherwise(F.col("method")).alias("method"),
        F.when(compound, 0.95).otherwise(F.col("confidence")).alias("confidence"),
    )
