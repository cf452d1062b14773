"""Additive pages: anchors, provision tables and notes, taken apart with column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalise import clean_html
from ..functions.text import parse_level

ANCHOR = r'(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
CATEGORY = r"^\d{2}(\.\d+)*$"
NAME_AND_INS = r"^(.*?)\s*\((\d{3,4}[a-z]?(?:\([ivxlc]+\))?)\)\s*\*?$"


def anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """All links of a page, in order: the other columns, place, href, text."""
    each = F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), 1).alias("href"), F.regexp_extract_all(html, F.lit(ANCHOR), 2).alias("label"))
    rest = [c for c in pages.columns if c != html]
    rows = pages.select(*rest, F.posexplode(each).alias("place", "a"))
    return rows.select(*rest, "place", F.col("a.href").alias("href"), clean_html(F.col("a.label")).alias("text"))


def detail_id(href: Column) -> Column:
    return F.nullif(F.regexp_extract(href, r"details\.html\?id=(\d+)", 1), F.lit(""))


def index_records(pages: DataFrame) -> DataFrame:
    """One record per (kind, id) of links to a detail page, the first of each: kind, detail_id, name, ins.

    pages: page_id, html.
    """
    rows = anchors(pages.select("page_id", "html")).withColumn("detail_id", detail_id(F.col("href"))).where("detail_id is not null")
    kind = F.when(F.contains("href", F.lit("groups/details.html")), "group").otherwise("additive")
    rows = rows.where(~F.endswith(F.regexp_replace("text", r"\s*\([^()]*(?:\([^()]*\))?\)\s*$", ""), F.lit("*")))
    first = rows.groupBy(kind.alias("kind"), "detail_id").agg(F.min_by("text", F.struct("page_id", "place")).alias("text"))
    ins = F.nullif(F.regexp_extract("text", NAME_AND_INS, 2), F.lit(""))
    return first.select("kind", "detail_id", F.when(ins.isNull(), F.col("text")).otherwise(F.regexp_extract("text", NAME_AND_INS, 1)).alias("name"), ins.alias("ins"))


def synonyms(pages: DataFrame) -> DataFrame:
    """detail_id and its starred names, distinct, in order."""
    rows = anchors(pages.select("page_id", "html")).withColumn("detail_id", detail_id(F.col("href"))).where("detail_id is not null")
    name = F.regexp_replace("text", r"\s*\(\d{3,4}[a-z]?(?:\([ivxlc]+\))?\)\s*$", "")
    starred = rows.withColumn("name", name).where(F.endswith("name", F.lit("*"))).withColumn("name", F.trim(F.regexp_replace("name", r"[*,\s]+$", "")))
    ordered = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "place", "name"))), lambda x: x["name"]))
    return starred.groupBy("detail_id").agg(ordered.alias("synonyms"))


def _element(tag: str, attribute: str = "") -> str:
    """Pattern of an element; group 1 is what lies before its first end tag. Runs without a tag are passed over at once, not letter by letter."""
    return rf"(?i)<{tag}\b{attribute}[^>]*>((?:[^<]+|<(?!/{tag}>))*+)</{tag}>"


def _table(html: Column, table_id: str) -> Column:
    return F.regexp_extract(html, _element("table", rf'[^>]*\bid="{table_id}"'), 1)


def _rows(table: Column) -> Column:
    return F.transform(F.regexp_extract_all(table, F.lit(_element("tr")), 1), lambda tr: F.regexp_extract_all(tr, F.lit(_element("td")), 1))


def notes(cell: Column) -> Column:
    """Parallel codes and texts of a notes cell, padded with empty strings."""
    blocks = F.regexp_extract_all(cell, F.lit(_element("div")), 1)
    # a variable of transform, so that the pattern is gone through once
    blocks = F.get(F.transform(F.array(blocks), lambda b: F.when(F.size(b) > 0, b).otherwise(F.array(cell))), F.lit(0))
    pairs = F.transform(blocks, lambda b: F.struct(F.regexp_extract(clean_html(b), r"Note\s+([A-Za-z0-9]+)", 1).alias("code"), F.trim(F.regexp_extract(b, r'(?is)<img\b[^>]*\btitle="([^"]*)"', 1)).alias("text")))
    return F.filter(pairs, lambda p: (p["code"] != "") | (p["text"] != ""))


def provisions(pages: DataFrame, *kept: str) -> DataFrame:
    """Every row of the allowances table whose number cell is a category code: page_id, row, code, name, level, basis, conditions, note_codes, and the page's columns kept."""
    rows = pages.select("page_id", *kept, F.posexplode(_rows(_table(F.col("html"), "allowances"))).alias("row", "td")).where(F.size("td") >= 6)
    code = clean_html(F.get("td", F.lit(2)))
    rows = rows.withColumn("code", code).where(F.col("code").rlike(CATEGORY)).withColumn("level", parse_level(clean_html(F.get("td", F.lit(4))))).withColumn("notes", notes(F.get("td", F.lit(5))))
    text = F.transform("notes", lambda p: F.when((p["text"] != "") & (p["code"] != ""), F.concat(p["text"], F.lit(" [Note "), p["code"], F.lit("]"))).when(p["text"] != "", p["text"]).otherwise(F.concat(F.lit("[Note "), p["code"], F.lit("]"))))
    return rows.select(
        "page_id", "row", "code", clean_html(F.get("td", F.lit(3))).alias("name"), F.col("level.level").alias("max_level_mg_kg"), F.col("level.basis").alias("max_level_basis"),
        F.nullif(F.array_join(text, " | "), F.lit("")).alias("conditions"), F.filter(F.transform("notes", lambda p: p["code"]), lambda c: c != "").alias("note_codes"), *kept,
    )


def table3(pages: DataFrame) -> DataFrame:
    """Categories of good manufacturing practice, only where the page declares them: page_id, row, code, name."""
    gated = pages.where(F.col("html").rlike(r"(?i)Table\s+3\s+Provisions"))
    rows = gated.select("page_id", F.posexplode(_rows(_table(F.col("html"), "categories"))).alias("row", "td")).where(F.size("td") >= 4)
    return rows.withColumn("code", clean_html(F.get("td", F.lit(2)))).where(F.col("code").rlike(CATEGORY)).select("page_id", "row", "code", clean_html(F.get("td", F.lit(3))).alias("name"))


def detail(pages: DataFrame) -> DataFrame:
    """Own provisions and table 3 permissions of a page; a page with neither keeps one row of its identity."""
    own = provisions(pages).select("page_id", F.lit("own").alias("source"), "code", "name", "max_level_mg_kg", "max_level_basis", "conditions")
    gmp = table3(pages).select("page_id", F.lit("table3").alias("source"), "code", "name", F.lit(None).cast("double").alias("max_level_mg_kg"), F.lit("gmp").alias("max_level_basis"), F.lit(None).cast("string").alias("conditions"))
    rows = own.unionByName(gmp)
    none = pages.select("page_id").join(rows.select("page_id").distinct(), "page_id", "left_anti").withColumn("source", F.lit("identity"))
    return rows.unionByName(none, allowMissingColumns=True)


def group_provisions(pages: DataFrame) -> DataFrame:
    """A group's members with each of its provisions: page_id, member, code, level and conditions with the shared-limit text.

    A page is read once: its provisions carry its members and notice, and are spread over the members last.
    """
    members = F.transform(F.filter(_rows(_table(F.col("html"), "additives")), lambda td: F.size(td) >= 3), lambda td: clean_html(F.get(td, F.lit(1))))
    notice = F.regexp_extract(clean_html(F.col("html")), r"(The provisions that follow[^.]*total content[^.]*\.)", 1)
    # behind explode, members are computed once and not again for a filter on their number
    read = pages.select("page_id", "html", F.explode(F.array(F.struct(members.alias("members"), notice.alias("notice")))).alias("page"))
    rules = provisions(read.select("page_id", "html", "page.*"), "members", "notice")
    told = F.nullif(F.concat_ws(" | ", "conditions", F.nullif("notice", F.lit(""))), F.lit(""))
    rules = rules.select("page_id", "members", "code", "max_level_mg_kg", "max_level_basis", told.alias("conditions"))
    return rules.select("page_id", F.explode("members").alias("member"), "code", "max_level_mg_kg", "max_level_basis", "conditions")
