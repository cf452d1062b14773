"""Text and code normalisers, as column expressions that stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_code(c: Column) -> Column:
    """Lower case without spaces and without one leading "ins" or "e"."""
    return F.regexp_replace(F.replace(F.lower(c), F.lit(" "), F.lit("")), "^(ins|e)", "")


def normalise_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def without_sub_notation(c: Column) -> Column:
    """160b(i) -> 160b."""
    return F.regexp_replace(c, r"\([^)]*\)$", "")


def without_letter(c: Column) -> Column:
    """160b -> 160."""
    return F.regexp_replace(c, "[a-zA-Z]$", "")


def parent_ins(c: Column) -> Column:
    """The next broader code: X(roman) -> X, digits and a letter -> digits; null if there is none."""
    roman = F.regexp_extract(c, r"^(.*)\(([ivxlc]+)\)$", 1)
    letter = F.regexp_extract(c, r"^(\d+)[a-z]$", 1)
    return F.coalesce(F.nullif(roman, F.lit("")), F.nullif(letter, F.lit("")))


def lineage(c: Column) -> Column:
    """The code and its broader codes, nearest first: [160b(i), 160b, 160]."""
    base = without_sub_notation(c)
    return F.array_distinct(F.array(c, base, without_letter(base)))


def category_code(c: Column) -> Column:
    """ "12.2.2 Seasonings" -> "12.2.2"; trailing points go; null -> ""."""
    return F.coalesce(F.regexp_replace(F.split_part(c, F.lit(" "), F.lit(1)), r"\.+$", ""), F.lit(""))


def dotted_parent(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^(.*)\.[^.]+$", 1), F.lit(""))


def is_ancestor(candidate: Column, of: Column) -> Column:
    return F.startswith(of, F.concat(candidate, F.lit(".")))


def blank_to_null(c: Column) -> Column:
    """A text that is nothing but white space and no-break space marks reads as null."""
    return F.when(F.trim(F.regexp_replace(c, "(?i)&nbsp;|\\u00A0", "")) != "", c)


def unwrap_paragraph(c: Column) -> Column:
    """<p>text</p> around the whole value is taken off; no-break spaces and runs of space become one space."""
    inner = F.regexp_extract(c, r"(?is)^\s*<p[^>]*>(.*)</p>\s*$", 1)
    flat = F.trim(F.regexp_replace(F.regexp_replace(inner, "(?i)&nbsp;|\\u00A0", " "), r"\s+", " "))
    return F.when(inner != "", flat).otherwise(c)


def clean_html(c: Column) -> Column:
    """Line breaks to spaces, tags off, white space collapsed."""
    flat = F.when(F.contains(c, F.lit("<")), F.regexp_replace(F.regexp_replace(c, r"<[bB][rR]\s*/?>", " "), "(?:<[^>]+>)++", "")).otherwise(c)
    # a single space stays as it is
    return F.trim(F.regexp_replace(flat, r"\s{2,}|[^\S ]", " "))


def sort_key(code: Column) -> Column:
    """Natural order of dotted codes."""
    return F.transform(F.split(code, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
