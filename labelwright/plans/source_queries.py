"""Queries of the scans, page tables, declarations and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import declarations as D
from ..sources import html_tables as H
from ..sources import readers as S
from ..sources import word_clouds as W
from .registry import load, query


@query("src4_categories", (), "SELECT r_regionkey::VARCHAR || '.1' AS code, CASE WHEN r_regionkey % 2 = 0 THEN r_name ELSE r_regionkey::VARCHAR || '.1' END AS name, r_regionkey::VARCHAR AS parent_code FROM region")
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.col("r_regionkey").cast("string"), F.lit(".1"))
    pair = lambda k, v: F.struct(F.lit(k).alias("valueIdentifier"), v.alias("value"))
    values = F.array(pair("refDataFoodCategoryLevel", code), pair("refDataFoodCategoryEN", F.when(F.col("r_regionkey") % 2 == 0, F.col("r_name"))), pair("refDataFoodCategoryDesc", F.lit("<p>x</p>")))
    return S.categories(load(spark, sf_dir, "region").select(values.alias("childrenValues"))).select("code", "name", "parent_code")


@query(
    "src8_page_anchors",
    (),
    r"""SELECT page_id, i - 1 AS place, hrefs[i] AS href, trim(regexp_replace(regexp_replace(labels[i], '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS text FROM (
        SELECT page_id, regexp_extract_all(html, '<a\b[^>]*?href="([^"]*)"[^>]*>((?s:.*?))</a>', 1) AS hrefs, regexp_extract_all(html, '<a\b[^>]*?href="([^"]*)"[^>]*>((?s:.*?))</a>', 2) AS labels,
               unnest(range(1, len(regexp_extract_all(html, '<a\b[^>]*?href="([^"]*)"[^>]*>((?s:.*?))</a>', 1)) + 1)) AS i FROM pages)""",
)
def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.anchors(load(spark, sf_dir, "pages").select("page_id", "html"))
    return rows.select("page_id", F.col("place").cast("long").alias("place"), "href", "text")


_PAGE = """concat('<table id="allowances"><tr><td></td><td></td><td>', lpad(CAST(1 + p_size % 16 AS string), 2, '0'), '.', CAST(p_size % 5 AS string), '</td><td>', p_name, '</td><td class="allowanceMaxLevel">',
    CASE WHEN p_size % 3 = 0 THEN 'GMP' ELSE concat(CAST(p_size * 10 AS string), ' mg/kg') END, '</td><td><div><img title="', p_type, '"/><a href="notes.html">Note ', CAST(p_size AS string), '</a></div></td></tr></table>')"""


@query(
    "src10_provisions",
    (),
    """SELECT p_partkey AS page_id, lpad(CAST(1 + p_size % 16 AS string), 2, '0') || '.' || CAST(p_size % 5 AS string) AS code, p_name AS name, CASE WHEN p_size % 3 <> 0 THEN p_size * 10.0 END AS level,
        CASE WHEN p_size % 3 = 0 THEN 'gmp' ELSE 'mg/kg' END AS basis, p_type || ' [Note ' || p_size || ']' AS conditions FROM part""",
)
def provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.expr(_PAGE).alias("html"))
    return H.provisions(pages).select("page_id", "code", "name", F.col("max_level_mg_kg").alias("level"), F.col("max_level_basis").alias("basis"), "conditions")


@query(
    "src14_group_members",
    (),
    """SELECT n_regionkey::BIGINT AS page_id, n_name AS member, '05.3' AS code, 1500.0 AS level FROM nation""",
)
def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    member = F.concat(F.lit("<tr><td></td><td>"), "n_name", F.lit("</td><td>x</td></tr>"))
    pages = load(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("page_id")).agg(F.array_join(F.collect_list(member), "").alias("m"))
    rule = '<table id="allowances"><tr><td></td><td></td><td>05.3</td><td>Gum</td><td>1,500 mg/kg</td><td></td></tr></table>'
    html = F.concat(F.lit('<table id="additives">'), "m", F.lit("</table>" + rule))
    return H.group_provisions(pages.select("page_id", html.alias("html"))).select("page_id", "member", "code", F.col("max_level_mg_kg").alias("level"))


@query(
    "src14_group_rules",
    (),
    """SELECT l_orderkey AS page_id, n_name AS member, lpad((1 + l_suppkey % 16)::VARCHAR, 2, '0') || '.' || l_linenumber AS code, CASE WHEN l_quantity < 25 THEN l_quantity * 100 END AS level,
        CASE WHEN l_quantity < 25 THEN 'mg/kg' ELSE 'gmp' END AS basis,
        'at most ' || l_partkey || ' [Note ' || l_linenumber || ']' || CASE WHEN l_orderkey % 2 = 0 THEN ' | The provisions that follow limit the total content of the group.' ELSE '' END AS conditions
    FROM lineitem JOIN nation ON n_regionkey = l_orderkey % 5""",
)
def group_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each order: its lines are the rules, the nations of a region the members, every other page with a shared limit."""
    cells = """concat('<tr><td></td><td></td><td>', lpad(CAST(1 + l_suppkey % 16 AS string), 2, '0'), '.', CAST(l_linenumber AS string), '</td><td>Wares</td><td>',
        CASE WHEN l_quantity < 25 THEN concat(format_number(l_quantity * 100, 0), ' mg/kg') ELSE 'GMP' END, '</td><td><div><img title="at most ', CAST(l_partkey AS string), '"/><a href="n">Note ', CAST(l_linenumber AS string), '</a></div></td></tr>')"""
    rules = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_join(F.collect_list(F.expr(cells)), "").alias("rules"))
    member = F.concat(F.lit("<tr><td></td><td>"), "n_name", F.lit("</td><td>x</td></tr>"))
    members = load(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_join(F.collect_list(member), "").alias("members"))
    pages = rules.join(F.broadcast(members), F.pmod(F.col("page_id"), F.lit(5)) == F.col("region"))
    notice = F.when(F.col("page_id") % 2 == 0, "<p>The provisions that follow limit the total content of the group.</p>").otherwise("")
    html = F.concat(F.lit('<table id="additives">'), "members", F.lit("</table>"), notice, F.lit('<table id="allowances">'), "rules", F.lit("</table>"))
    rows = H.group_provisions(pages.select("page_id", html.alias("html")))
    return rows.select("page_id", "member", "code", F.col("max_level_mg_kg").alias("level"), F.col("max_level_basis").alias("basis"), "conditions")


@query(
    "src15_nearest_anchor",
    (),
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS y, l_orderkey % 50 AS page FROM lineitem GROUP BY 1, 2, 3, 4), a AS (SELECT o_orderkey % 50 AS page, o_totalprice AS y FROM orders GROUP BY 1, 2)
    SELECT page, round(sum(anchor), 2) AS total, count(*) AS n FROM (SELECT p.page, p.y, p.l_orderkey, arg_min(a.y, abs(a.y - p.y) * 1000000 + a.y / 1000000) AS anchor FROM p JOIN a ON p.page = a.page GROUP BY p.page, p.y, p.l_orderkey, p.l_linenumber) GROUP BY page""",
)
def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"), (F.col("l_orderkey") % 50).alias("page")).distinct()
    anchors = load(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("page"), F.col("o_totalprice").alias("y")).distinct()
    near = W.nearest(points, anchors).where("anchor is not null")
    return near.groupBy("page").agg(F.round(F.sum("anchor"), 2).alias("total"), F.count(F.lit(1)).alias("n"))


@query(
    "src15_line_clusters",
    (),
    """WITH w AS (SELECT user_id AS page, value AS y, event_id AS x FROM events), s AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page ORDER BY y, x) <= 0.05 THEN 0 ELSE 1 END AS new FROM w),
    l AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY y, x ROWS UNBOUNDED PRECEDING) AS line FROM s)
    SELECT page, line::BIGINT AS line, round(min(y), 6) AS y, string_agg(x::VARCHAR, ' ' ORDER BY x) AS text FROM l GROUP BY 1, 2""",
)
def line_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = load(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("value").alias("y"), F.col("event_id").alias("x"), F.col("event_id").cast("string").alias("text"))
    return W.lines(words, 0.05).select("page", "line", F.round("y", 6).alias("y"), "text")


@query("tv1_declarations", ())
def declaration_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.parse(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("label_id"), "text"))


@query(
    "tv1_flat_declarations",
    (),
    r"""WITH p AS (SELECT doc_id AS label_id, unnest(list_filter([regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN string_split(translate(text, '()[]:', '     '), ',')], lambda x: x <> '')) AS verbatim,
        generate_subscripts(list_filter([regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN string_split(translate(text, '()[]:', '     '), ',')], lambda x: x <> ''), 1) - 1 AS position FROM documents),
    c AS (SELECT *, regexp_full_match(verbatim, '(?i)((INS|E)\s*)?[0-9]{3,4}[a-z]?') AS code FROM p)
    SELECT label_id, position, verbatim, CASE WHEN NOT code THEN verbatim END AS name_as_declared, CASE WHEN code THEN verbatim END AS declared_code,
        CASE WHEN NOT code THEN 'none' WHEN upper(verbatim) LIKE 'INS%' THEN 'INS' WHEN upper(verbatim) LIKE 'E%' THEN 'E' ELSE 'bare' END AS code_system FROM c""",
)
def flat_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without brackets and colons, so each part is one item, by the table function."""
    D.register(spark)
    return spark.sql(
        """SELECT label_id, CAST(position AS bigint) AS position, verbatim, name_as_declared, declared_code, code_system
        FROM parse_declarations(TABLE(SELECT doc_id AS label_id, translate(text, '()[]:', '     ') AS text FROM {docs}))""",
        docs=load(spark, sf_dir, "documents"),
    )


@query("tv2_additive_list", ("items",), "SELECT label_id, item_id - 1 AS position, 'E' || canonical_id AS declared_code FROM items")
def additive_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array_sort(F.collect_list(F.struct("item_id", F.concat(F.lit("E"), "canonical_id").alias("c"))))
    labels = load(spark, sf_dir, "items").groupBy("label_id").agg(F.array_join(F.transform(codes, lambda x: x["c"]), ", ").alias("text"))
    return D.parse(labels, flat=True).select("label_id", "position", "declared_code")


@query(
    "tv11_trace_rules",
    (),
    """SELECT conv_id, count(*) AS n_turns, count(*) FILTER (WHERE role = 'assistant') AS n_steps, count(*) FILTER (WHERE role = 'assistant') > 5 OR count(*) FILTER (WHERE role = 'user') = 0 AS declined FROM conversations GROUP BY 1""",
)
def trace_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").groupBy("conv_id")
    steps, asked = F.count_if(F.col("role") == "assistant"), F.count_if(F.col("role") == "user")
    return rows.agg(F.count(F.lit(1)).alias("n_turns"), steps.alias("n_steps"), ((steps > 5) | (asked == 0)).alias("declined"))


@query("snk5_append_log", (), "SELECT r_name AS run, r_regionkey AS score, NULL::VARCHAR AS model FROM region UNION ALL SELECT n_name, NULL, 'm' FROM nation")
def append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "region").select(F.col("r_name").alias("run"), F.col("r_regionkey").alias("score"))
    return S.append_log(log, load(spark, sf_dir, "nation").select(F.col("n_name").alias("run"), F.lit("m").alias("model")))


@query("snk3_json_report", (), "SELECT o_orderkey, json_object('o_orderstatus', o_orderstatus, 'o_totalprice', o_totalprice)::VARCHAR AS report FROM orders")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.to_report(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey")


@query("src16_registry_rows", ("substances",), r"""SELECT DISTINCT ins, CASE WHEN regexp_matches(ins, '\([ivxlc]+\)$') THEN regexp_extract(ins, '^(.*)\([ivxlc]+\)$', 1) WHEN regexp_matches(ins, '^\d+[a-z]$') THEN regexp_extract(ins, '^(\d+)[a-z]$', 1) END AS parent_ins,
    split_part(name, ' ', 1) AS name, split_part(name, ' ', 2) AS synonym FROM substances""")
def registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.normalise import parent_ins

    raw = F.concat(F.split_part("name", F.lit(" "), F.lit(1)), F.lit(" ("), F.split_part("name", F.lit(" "), F.lit(2)), F.lit(")"))
    return load(spark, sf_dir, "substances").select("ins", parent_ins(F.col("ins")).alias("parent_ins"), F.trim(F.regexp_extract(raw, r"^(.*)\(([^()]*)\)\s*$", 1)).alias("name"), F.regexp_extract(raw, r"^(.*)\(([^()]*)\)\s*$", 2).alias("synonym")).distinct()
