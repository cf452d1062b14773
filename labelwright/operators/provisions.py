"""Rows of a permission table: exact duplicates, and the one row that holds for a substance in a category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalise import blank_to_null, category_code, unwrap_paragraph


def clean(permits: DataFrame) -> DataFrame:
    """Blank conditions become null, wrapped names are unwrapped, and the category code is split off."""
    return permits.withColumns(
        {
            "conditions": blank_to_null(F.col("conditions")),
            "additive_name": unwrap_paragraph(F.col("additive_name")),
            "fcs_code": category_code(F.col("food_category_raw")),
        }
    )


DUPLICATE_KEY = ("canonical_id", "food_category_raw", "status", "max_level_mg_kg", "conditions")


def dedupe_rows(permits: DataFrame, key: tuple[str, ...] = DUPLICATE_KEY) -> DataFrame:
    """The first row (by row_ord) of each combination of the key; nulls are equal.

    An aggregate, combined map-side, rather than a window: nothing is sorted.
    """
    rest = [c for c in permits.columns if c not in key]
    first = F.min_by(F.struct(*rest), "row_ord").alias("first")
    return permits.groupBy(*key).agg(first).select(*key, "first.*").select(*permits.columns)


def restrictiveness(status: Column, level: Column, conditions: Column) -> list[Column]:
    """Sort keys, most restrictive first."""
    return [
        F.when(status == "prohibited", 0).otherwise(1),
        F.when(level.isNotNull(), 0).otherwise(1),
        F.coalesce(level, F.lit(float("inf"))),
        F.when(F.coalesce(conditions, F.lit("")) != "", 0).otherwise(1),
    ]


def numbered(texts: Column) -> Column:
    """One text as it is; several as "1) ..." paragraphs; none as null."""
    many = F.array_join(F.transform(texts, lambda x, i: F.concat((i + 1).cast("string"), F.lit(") "), x)), "\n\n")
    return F.when(F.size(texts) == 0, F.lit(None)).when(F.size(texts) == 1, F.get(texts, F.lit(0))).otherwise(many)


def select_rows(permits: DataFrame, *by: str) -> DataFrame:
    """One row per group: the row itself, the most restrictive of rows that disagree in status, or the merged rows.

    Adds n_rows and flags. permits: row_ord, status, max_level_mg_kg, max_level_basis, conditions, note_codes,
    source_url. A group's rows are the provisions of one substance in one category, so the lists stay short. Rows are
    dealt out by group once; duplicates are met there.
    """
    key = dict.fromkeys((*by, *DUPLICATE_KEY))
    held = dict.fromkeys((*key, "row_ord", "max_level_basis", "note_codes", "source_url"))
    rows = dedupe_rows(permits.select(*held).repartition(*by), (*key,))
    level, conditions = F.col("max_level_mg_kg"), F.col("conditions")
    text = F.when(F.coalesce(conditions, F.lit("")) != "", conditions)
    payload = F.struct("status", "max_level_mg_kg", "max_level_basis", "conditions", "note_codes", "source_url")
    grouped = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.min("status") != F.max("status")).alias("conflict"),
        F.min_by(payload, "row_ord").alias("first"),
        F.min_by(payload, F.struct(*restrictiveness(F.col("status"), level, conditions), F.col("row_ord"))).alias("strictest"),
        F.min_by(F.struct("max_level_mg_kg", "max_level_basis"), F.when(level.isNotNull(), F.struct(level, F.col("row_ord")))).alias("lowest"),
        F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(F.col("row_ord"), text.alias("text"))))).alias("texts"),
        F.array_sort(F.collect_list(F.struct("row_ord", "note_codes"))).alias("notes"),
    )
    distinct = F.array_distinct(F.transform("texts", lambda x: x["text"]))
    notes = F.array_distinct(F.flatten(F.transform("notes", lambda x: F.coalesce(x["note_codes"], F.array().cast("array<string>")))))
    merged = F.struct(
        F.col("first.status").alias("status"),
        F.col("lowest.max_level_mg_kg").alias("max_level_mg_kg"),
        F.when(F.col("lowest").isNull(), F.col("first.max_level_basis")).otherwise(F.col("lowest.max_level_basis")).alias("max_level_basis"),
        numbered(distinct).alias("conditions"),
        notes.alias("note_codes"),
        F.col("first.source_url").alias("source_url"),
    )
    chosen = F.when(F.col("n_rows") == 1, F.col("first")).when(F.col("conflict"), F.col("strictest")).otherwise(merged)
    flags = (
        F.when(F.col("n_rows") == 1, F.array().cast("array<string>"))
        .when(F.col("conflict"), F.array(F.lit("conflicting_rows")))
        .otherwise(F.array(F.concat(F.lit("multiple_provisions_apply: "), F.col("n_rows").cast("string"))))
    )
    return grouped.select(*by, "n_rows", flags.alias("flags"), chosen.alias("chosen")).select(*by, "n_rows", "flags", "chosen.*")


def verdict_of(status: Column, conditions: Column, level: Column) -> Column:
    return (
        F.when(status == "prohibited", "not_authorised_eu")
        .when(F.coalesce(conditions, F.lit("")) != "", "permitted_with_conditions")
        .when(level.isNotNull(), "permitted_with_limit")
        .otherwise("permitted_qs")
    )
