"""Category corpus: the text that stands for each category, in five modes, and counters of the name dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences

MODES = ("name-only", "name-plus-examples", "enriched", "full", "strip-framing")
# The marks of an example, and the stock phrases that may open a sentence.
EXAMPLE_MARKS = ("e.g.", "for example", "examples include", "such as")
FRAMING = ("this category covers", "this category includes", "this category comprises", "includes all other")
#: Classes that an enriched text names.
CLASS_CAP = 10


def example_sentence(description: Column) -> Column:
    """The first sentence that holds the mark of an example, else null."""
    marked = lambda x: F.exists(F.array(*map(F.lit, EXAMPLE_MARKS)), lambda m: F.contains(F.lower(x), m))
    return F.trim(F.get(F.filter(sentences(description), marked), F.lit(0)))


def without_framing(description: Column) -> Column:
    """The description, its sentences freed of stock phrases at their beginning; sentences left empty go."""

    def bare(sentence: Column) -> Column:
        out = sentence
        for phrase in FRAMING:
            out = F.when(F.startswith(F.lower(sentence), F.lit(phrase)), F.substring(sentence, len(phrase) + 1, 1 << 30)).otherwise(out)
        return F.trim(out)

    return F.array_join(F.filter(F.transform(sentences(description), bare), lambda x: x != ""), " ")


def with_ancestors(categories: DataFrame) -> DataFrame:
    """code, ancestors: the rows (name, description) up the dotted code, nearest first, at any depth.

    Every code meets its own prefixes by an equi-join, one row per level; there is no recursion and no prefix search.
    """
    levels = F.split("code", r"\.")
    up = categories.select("code", levels.alias("levels")).where(F.size("levels") > 1)
    up = up.select("code", F.explode(F.sequence(F.lit(1), F.size("levels") - 1)).alias("depth"), "levels")
    up = up.select("code", "depth", F.array_join(F.slice("levels", F.lit(1), F.col("depth")), ".").alias("up"))
    known = categories.select(F.col("code").alias("up"), "name", "description")
    chain = F.sort_array(F.collect_list(F.struct("depth", "name", "description")), asc=False)
    return up.join(known, "up").groupBy("code").agg(chain.alias("ancestors"))


def documents(categories: DataFrame, mode: str = "full", inherit: bool = True, classes: DataFrame | None = None) -> DataFrame:
    """code, document: one text a category. categories: code, name, description (may be null).

    full and strip-framing take the description, and with inherit those of all ancestors; name-plus-examples the
    sentence with an example; enriched the commonest classes permitted (classes: code, class, a row each time).
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode == "enriched" and classes is None:
        raise ValueError("enriched documents need classes")
    parts: list[Column] = [F.col("code"), F.col("name")]
    rows = categories.select("code", "name", "description")
    if mode == "name-plus-examples":
        parts.append(example_sentence(F.col("description")))
    elif mode == "enriched":
        counts = classes.groupBy("code", "class").agg(F.count(F.lit(1)).alias("n"))
        ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.lower("class").alias("class")))), 1, CLASS_CAP)
        clause = counts.groupBy("code").agg(F.array_join(F.transform(ranked, lambda x: x["class"]), ", ").alias("clause"))
        rows = rows.join(clause, "code", "left")
        parts.append(F.concat(F.lit("Typically permits: "), "clause", F.lit(".")))
    elif mode in ("full", "strip-framing"):
        told = without_framing if mode == "strip-framing" else (lambda c: c)
        parts.append(told(F.col("description")))
        if inherit:
            rows = rows.join(with_ancestors(categories), "code", "left")
            parts.append(F.array_join(F.transform("ancestors", lambda a: F.concat_ws(" -- ", a["name"], told(a["description"]))), " -- "))
    return rows.select("code", F.concat_ws(" -- ", *parts).alias("document"))


def backbone_counters(records: DataFrame) -> DataFrame:
    """One row of counts over the name dictionary: canonical_id, is_group, via_group, synonyms, source_url."""
    unmapped = F.startswith("canonical_id", F.lit("UNMAPPED:"))
    parts = F.size(F.split(F.coalesce("source_url", F.lit("")), "gsfaonline")) - 1
    counts = {
        "assigned": ~F.col("is_group"), "groups": F.col("is_group"), "members": F.col("via_group").isNotNull(), "with_synonyms": F.size("synonyms") > 0,
        "sub_types": ~unmapped & F.contains("canonical_id", F.lit("(")), "unmapped_not_group": unmapped & ~F.col("is_group"), "doubled_urls": parts > 1,
    }
    return records.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(n) for n, c in counts.items()))
