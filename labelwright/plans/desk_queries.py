"""Queries of news lanes, display labels, review lookups and the evidence on an item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import display as D
from ..operators import lookups as L
from ..operators import news as N
from ..operators import verdicts as J
from ..sources import word_clouds as W
from .registry import load, query
from .resolution_queries import _substances
from .verdict_queries import CLEAN, _permits, lineage_sql

_KIND = "CASE event_id % 5 WHEN 0 THEN 'regulatory_review' WHEN 1 THEN 'safety_opinion' WHEN 2 THEN 'market_action' WHEN 3 THEN 'consumer_alert' ELSE 'unrelated' END"
_ROUTE_KIND = "CASE event_id % 5 WHEN 0 THEN 'import_control' WHEN 1 THEN 'border_rejection' WHEN 2 THEN 'trade_agreement' WHEN 3 THEN 'consumer_alert' ELSE 'unrelated' END"
_LABEL = "CASE event_id % 5 WHEN 0 THEN 'Under regulatory review' WHEN 1 THEN 'Referenced in a safety opinion' WHEN 2 THEN 'Market or import action reported' WHEN 3 THEN 'Referenced in a consumer alert' END"
_ROUTE_LABEL = "CASE event_id % 5 WHEN 0 THEN 'EU import control' WHEN 1 THEN 'Consignments rejected at the EU border' WHEN 2 THEN 'Trade agreement development' WHEN 3 THEN 'EU consumer alert' END"
_FOOD = "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Fruit_juices  as defined by Directive 2001/112/EC and vegetable juices' WHEN 2 THEN 'Cocoa as covered by Regulation 7' ELSE 'Spices' END"
_PLAIN_FOOD = "CASE event_id % 4 WHEN 0 THEN 'food' WHEN 1 THEN 'Fruit juices and vegetable juices' WHEN 2 THEN 'Cocoa' ELSE 'Spices' END"


@query(
    "scl28_templates",
    (),
    f"""SELECT event_id, 'E ' || user_id || ': ' || {_LABEL} || ' -- "q" (https://n.example' || CASE WHEN event_id % 3 = 0 THEN '' ELSE ', ' || CAST(ts AS date) END || ').' AS sentence,
        'India ' || {_PLAIN_FOOD} || ' exports: ' || {_ROUTE_LABEL} || ' -- "q" (https://n.example).' AS route_sentence, 'E ' || user_id || ' food additive EU regulation' AS query, 'Indian ' || {_PLAIN_FOOD} || ' exports EU import rules' AS route_query FROM events""",
)
def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumns({"name": F.concat(F.lit("E "), F.col("user_id").cast("string")), "food": F.expr(_FOOD)})
    url, quote, day = F.lit("https://n.example"), F.lit("q"), F.when(F.col("event_id") % 3 != 0, F.to_date("ts"))
    food = F.coalesce(N.plain_category(F.col("food")), F.lit(N.ANY_CATEGORY))
    return e.select(
        "event_id", N.additive_sentence(F.col("name"), F.expr(_KIND), quote, url, day).alias("sentence"),
        N.route_sentence(food, F.expr(_ROUTE_KIND), quote, url, F.lit(None).cast("date")).alias("route_sentence"),
        N.additive_query(F.col("name")).alias("query"), N.route_query(F.col("food")).alias("route_query"),
    )


#: What a search and a model might return for each event; the quote is from the content, but for one in six.
_RESULTS = f"""SELECT *, CASE WHEN odd THEN 'E Blue' ELSE 'gum' END AS name, CASE event_id % 3 WHEN 0 THEN 'News of e blue' WHEN 1 THEN 'A gum story' ELSE 'On legumes' END AS title,
    concat('Blue: ', said, ' for ', event_type) AS content, CASE WHEN event_id % 6 = 0 THEN 'made up' ELSE said END AS quote
    FROM (SELECT user_id AS run, event_id % 20 AS key, event_id AS ord, event_id, event_type, event_id % 2 = 1 AS odd, value / 100.0 AS score, CASE WHEN event_id % 11 = 0 THEN 'nowhere' ELSE 'https://n.example/x' END AS url,
          CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(ts AS date) END AS published_date, CASE WHEN event_id % 14 = 0 THEN 'soon' END AS published_raw, CASE WHEN event_id % 13 = 0 THEN 'stale_cache_served' END AS cache_flag,
          CASE event_id % 7 WHEN 0 THEN 'the review was completed' WHEN 1 THEN 'the work is in progress' WHEN 2 THEN 'lots were recalled' WHEN 3 THEN 'it plans to act' ELSE 'it is under study' END AS said FROM events) t"""
_FLAGS = """concat_ws(',', CASE WHEN url = 'nowhere' THEN 'malformed_source_url' END, CASE WHEN published_date IS NULL THEN CASE WHEN published_raw IS NULL THEN 'no_published_date' ELSE 'unparseable_published_date' END END, cache_flag)"""


def _results(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = spark.sql(_RESULTS.replace("FROM events", "FROM {events}"), events=load(spark, sf_dir, "events"))
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.expr(kind).alias("category"), F.col("quote").alias("quoted_span"))), F.lit("\n```"))
    return rows.withColumns({"answer": answer, "food": F.expr(_FOOD)})


@query(
    "tv9_additive_signals",
    (),
    f"""WITH r AS ({_RESULTS}), a AS (SELECT *, dense_rank() OVER (PARTITION BY run ORDER BY key) AS asked FROM r),
    p AS (SELECT *, row_number() OVER (PARTITION BY run, key ORDER BY ord) AS place FROM a WHERE asked <= 12 AND score >= 0.6 AND (odd OR event_id % 3 = 1))
    SELECT run, key, ord, {_KIND} AS category, name || ': ' || {_LABEL} || ' -- "' || quote || '" (' || url || coalesce(', ' || published_date, '') || ').' AS sentence, {_FLAGS} AS flags
    FROM p WHERE place <= 3 AND event_id % 5 < 4 AND event_id % 6 <> 0 AND NOT (event_id % 5 = 0 AND event_id % 7 = 0) AND NOT (event_id % 5 = 1 AND event_id % 7 = 1)""",
)
def additive_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.additive_signals(_results(spark, sf_dir, _KIND)).select("run", "key", "ord", "category", "sentence", F.array_join("flags", ",").alias("flags"))


@query(
    "tv9_route_signals",
    (),
    f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ord) AS place FROM ({_RESULTS}) WHERE score >= 0.6)
    SELECT run, ord, {_ROUTE_KIND} AS category, 'India ' || {_PLAIN_FOOD} || ' exports: ' || {_ROUTE_LABEL} || ' -- "' || quote || '" (' || url || coalesce(', ' || published_date, '') || ').' AS sentence, {_FLAGS} AS flags
    FROM p WHERE place <= 3 AND event_id % 5 < 4 AND event_id % 6 <> 0 AND NOT (event_id % 5 = 0 AND event_id % 7 = 2) AND NOT (event_id % 5 = 1 AND event_id % 7 = 3)""",
)
def route_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.route_signals(_results(spark, sf_dir, _ROUTE_KIND).withColumnRenamed("food", "category_name"))
    return rows.select("run", "ord", "category", "sentence", F.array_join("flags", ",").alias("flags"))


@query("scl30_topics", (), "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN concat_ws(chr(10), p_brand, p_type, 'alone') WHEN 1 THEN '' END AS flat FROM part")
def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"What is blocked": ["'), "p_brand", F.lit('", "'), "p_type", F.lit('"], "A note": "alone"}'))
    detail = F.when(F.col("p_size") % 3 == 0, text).when(F.col("p_size") % 3 == 1, "{}").otherwise('["no", "map"]')
    return load(spark, sf_dir, "part").select("p_partkey", T.flattened(T.topics(detail)).alias("flat"))


_VERDICT = "CASE p_size % 5 WHEN 0 THEN 'not_authorised_eu' WHEN 1 THEN 'not_permitted_in_category' WHEN 2 THEN 'permitted_qs' WHEN 3 THEN 'permitted_with_limit' ELSE 'permitted_with_conditions' END"
_LEVEL = "CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN CAST(p_size AS double) ELSE p_size + CAST(0.5 AS double) END"
_TITLE = "CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'cocoa_products as covered by Directive 2000/36/EC' WHEN 2 THEN ' Juices as defined by Directive 2001/112/EC and nectars' ELSE 'Salt' END"
_SHORT = "CASE p_size % 4 WHEN 1 THEN 'Cocoa products' WHEN 2 THEN 'Juices and nectars' WHEN 3 THEN 'Salt' END"
_CONDITIONS = "CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN '2) Permitted via Group II, Colours at quantum satis' WHEN 2 THEN 'Period of application: until 2020' ELSE 'Permitted via Group I. Period of Application ended' END"
_GROUP = "replace('{}', '@', CASE p_size % 4 WHEN 1 THEN 'Group II, Colours' ELSE 'Group I' END)".format(D.GROUP_NOTE.replace("{}", "@"))


@query(
    "scl32_display_labels",
    (),
    f"""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Not allowed in the EU' WHEN 1 THEN 'Not allowed in this food' ELSE CASE WHEN p_partkey % 3 = 0 THEN 'Allowed' ELSE 'Allowed with limits' END END AS status,
        CASE WHEN p_size % 5 < 2 THEN '—' WHEN p_partkey % 3 = 0 THEN 'No fixed limit' WHEN p_partkey % 3 = 1 THEN 'Up to ' || p_size || ' mg/kg' ELSE 'Up to ' || p_size || '.5 mg/kg' END AS amount,
        CASE WHEN p_size % 4 = 0 THEN CAST(p_size AS string) ELSE {_SHORT} || ' (' || p_size || ')' END AS category,
        concat_ws('|', CASE WHEN p_size % 4 IN (1, 3) THEN {_GROUP} END, CASE WHEN p_size % 4 IN (2, 3) THEN '{D.PERIOD_NOTE}' END) AS notes,
        CASE WHEN p_size % 2 = 0 THEN '{D.PROHIBITED}' ELSE '{D.NOT_AUTHORISED}' END AS blocked, CASE p_size % 3 WHEN 0 THEN 'a flavouring, covered by different rules' WHEN 1 THEN 'Reg 9' ELSE 'an ordinary food' END AS out_of_scope,
        CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN 'E' || p_size ELSE 'item ' || p_partkey END AS shown FROM part""",
)
def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    banned = F.array(F.lit("x"), F.when(F.col("p_size") % 2 == 0, "prohibited").otherwise("y"))
    governed = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("governing_regulation: Reg 1334/2008"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("z"), F.lit("governing_regulation: Reg 9"))).otherwise(F.array(F.lit("z")))
    return load(spark, sf_dir, "part").select(
        "p_partkey", D.status_label(F.expr(_VERDICT), F.expr(_LEVEL)).alias("status"), D.max_amount(F.expr(_VERDICT), F.expr(_LEVEL)).alias("amount"),
        D.category_display(F.col("p_size").cast("string"), F.expr(_TITLE)).alias("category"), F.coalesce(F.array_join(D.conditions_notes(F.expr(_CONDITIONS)), "|"), F.lit("")).alias("notes"),
        D.blocking_reason(banned).alias("blocked"), D.out_of_scope_reason(governed).alias("out_of_scope"),
        D.display_name(F.when(k == 0, F.col("p_name")), F.when(k == 1, F.col("p_brand")), F.when(k == 2, F.col("p_size").cast("string")), F.col("p_partkey")).alias("shown"),
    )


@query(
    "jn22_codex",
    ("substances",),
    r"""WITH n AS (SELECT name, arg_min(ins, row_ord) AS ins FROM substances GROUP BY 1), last AS (SELECT ins, arg_max(name, row_ord) AS name FROM substances GROUP BY 1), codes AS (SELECT DISTINCT ins FROM substances),
    q AS (SELECT 'INS ' || ins AS query, 'code_exact' AS matched_on, ins FROM codes UNION ALL SELECT c.ins || '(xx)', 'code_parent', c.ins FROM codes c UNION ALL SELECT '  ' || upper(name), 'name_exact', ins FROM n
        UNION ALL SELECT 'alias ' || ins, 'synonym_exact', ins FROM codes)
    SELECT query, true AS found, matched_on, q.ins, l.name FROM q JOIN last l ON q.ins = l.ins""",
)
def codex_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _substances(spark, sf_dir)
    synonyms = s.select("row_ord", "ins", F.concat(F.lit("Alias  "), "ins").alias("term"))
    asked = F.explode(F.array(F.concat(F.lit("INS "), "ins"), F.concat("ins", F.lit("(xx)")), F.concat(F.lit("  "), F.upper("name")), F.concat(F.lit("alias "), "ins")))
    return L.codex(s.select(asked.alias("query")), s, synonyms).select("query", "found", "matched_on", "ins", "name")


@query(
    "jn22_eu_list",
    ("permits", "substances"),
    """WITH h AS (SELECT canonical_id, arg_min(additive_name, row_ord) AS additive_name, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses, count(*) AS n_rows FROM permits GROUP BY 1)
    SELECT 'E ' || upper(ins) AS query, canonical_id IS NOT NULL AS found, canonical_id, additive_name, statuses, n_rows FROM (SELECT DISTINCT ins FROM substances) LEFT JOIN h ON ins = canonical_id""",
)
def eu_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks = load(spark, sf_dir, "substances").select(F.concat(F.lit("E "), F.upper("ins")).alias("query"))
    return L.eu_list(asks, load(spark, sf_dir, "permits")).select("query", "found", "canonical_id", "additive_name", F.array_join("statuses", ",").alias("statuses"), "n_rows")


@query(
    "jn22_food_lexicon",
    (),
    "SELECT DISTINCT query, true AS is_known_food, p_type AS matched_term, kind AS match_type, 100.0 AS score FROM (SELECT ' ' || lower(p_type) AS query, p_type, 'exact' AS kind FROM part UNION ALL SELECT p_type || ' ground', p_type, 'fuzzy' FROM part)",
)
def food_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part")
    terms = rows.groupBy(F.col("p_type").alias("term")).agg(F.min("p_partkey").alias("row_ord"))
    asked = F.explode(F.array(F.concat(F.lit(" "), F.lower("p_type")), F.concat("p_type", F.lit(" ground"))))
    return L.food_lexicon(rows.select(asked.alias("query")), terms)


@query(
    "jn22_family",
    ("substances",),
    """SELECT p_partkey AS ask_id, concat_ws(',', CASE WHEN a.ins IS NOT NULL THEN a.ins END, CASE WHEN b.ins IS NOT NULL THEN b.ins END) AS members, concat_ws(',', CASE WHEN a.ins IS NULL THEN 'E' || x END, 'none', CASE WHEN b.ins IS NULL THEN 'INS ' || y END) AS not_found
    FROM (SELECT p_partkey, CAST(100 + p_size AS string) AS x, CAST(450 + p_size AS string) || '(i)' AS y FROM part) p LEFT JOIN (SELECT DISTINCT ins FROM substances) a ON a.ins = x LEFT JOIN (SELECT DISTINCT ins FROM substances) b ON b.ins = y""",
)
def family_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (100 + F.col("p_size")).cast("string"), F.concat((450 + F.col("p_size")).cast("string"), F.lit("(i)"))
    asks = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("ask_id"), F.array(F.concat(F.lit("E"), x), F.lit("none"), F.concat(F.lit("INS "), y)).alias("codes"))
    rows = L.family(asks, _substances(spark, sf_dir))
    return rows.select("ask_id", F.array_join(F.col("members.ins"), ",").alias("members"), F.array_join("not_found", ",").alias("not_found"))


@query(
    "jn22_product_context",
    ("declared", "labels_top3"),
    """SELECT a.label_id, a.item_id, any_value(t.fcs_code) AS confirmed_category, coalesce(string_agg(b.name_as_declared, '|' ORDER BY b.item_id), '') AS others FROM declared a
    LEFT JOIN declared b ON a.label_id = b.label_id AND a.item_id <> b.item_id LEFT JOIN labels_top3 t ON a.label_id = t.label_id AND t.rank = 1 GROUP BY 1, 2""",
)
def product_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "declared").select("label_id", "item_id", F.col("name_as_declared").alias("name"))
    products = load(spark, sf_dir, "labels_top3").where("rank = 1").select("label_id", F.col("fcs_code").alias("confirmed_category"))
    return L.product_context(items, products).select("label_id", "item_id", "confirmed_category", F.array_join("other_ingredient_names", "|").alias("others"))


@query(
    "tv11_proposals",
    (),
    """WITH c AS (SELECT *, (conv_id + turn) % 8 AS k, turn AS calls FROM conversations), s AS (SELECT *, k IN (4, 5, 6) AND calls > 0 AS valid FROM c)
    SELECT conv_id, turn, CASE WHEN valid AND k < 6 THEN '330' END AS ins, CASE WHEN valid AND k = 4 THEN 'additive' ELSE 'unknown' END AS classification, CASE WHEN valid AND k = 4 THEN 'high' ELSE 'low' END AS confidence,
        CASE WHEN k IN (3, 4) THEN 'read' ELSE '' END AS reasoning, CASE WHEN valid THEN CASE WHEN k = 5 THEN role ELSE 'INS 330|' || role END ELSE '' END AS evidence, NOT valid OR k = 6 AS declined,
        CASE WHEN k = 0 THEN 'model produced no final answer' WHEN k IN (1, 7) THEN 'final answer was not valid JSON' WHEN k = 2 THEN 'final answer was not a JSON object' WHEN k = 3 THEN 'proposal had no supporting evidence'
             WHEN calls = 0 THEN 'no tool was called -- nothing to cite as evidence' WHEN k = 6 THEN 'two families' END AS reason FROM s""",
)
def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, role = (F.col("conv_id") + F.col("turn")) % 8, F.col("role")
    full = F.concat(F.lit('```json\n{"evidence": ["INS 330", " ", "'), role, F.lit('"], "proposed_classification": "additive", "confidence": "high", "proposed_canonical_ins": "330", "reasoning": "read"}\n```'))
    odd = F.concat(F.lit('{"evidence": " '), role, F.lit('", "proposed_classification": "spice", "confidence": 3, "proposed_canonical_ins": "330"}'))
    own = F.concat(F.lit('{"evidence": ["INS 330", "'), role, F.lit('"], "declined": true, "decline_reason": "two families"}'))
    fixed = {1: "The answer is 330", 2: "[1, 2]", 3: '{"evidence": [" ", ""], "reasoning": "read"}', 7: '{"evidence": ['}
    answer = F.when(k == 4, full).when(k == 5, odd).when(k == 6, own)
    for at, text in fixed.items():
        answer = answer.when(k == at, text)
    p = L.proposal(answer, F.col("turn"))
    return load(spark, sf_dir, "conversations").withColumn("p", p).select(
        "conv_id", "turn", F.col("p.proposed_canonical_ins").alias("ins"), F.col("p.proposed_classification").alias("classification"), "p.confidence", "p.reasoning",
        F.array_join("p.evidence", "|").alias("evidence"), "p.declined", F.col("p.decline_reason").alias("reason"),
    )


@query(
    "tv10_item_evidence",
    ("permits", "resolved", "labels_top3"),
    "WITH " + CLEAN.format(table="permits") + f""", base AS (SELECT r.*, t.fcs_code FROM resolved r LEFT JOIN labels_top3 t ON r.label_id = t.label_id AND t.rank = 1), {lineage_sql('up', 'base', 'eu_canonical_id')},
    banned AS (SELECT id, arg_min(code, step) AS at FROM up WHERE code IN (SELECT canonical_id FROM clean WHERE status = 'prohibited') GROUP BY 1),
    held AS (SELECT canonical_id AS code, fcs_code, string_agg(line, '|' ORDER BY row_ord, line) AS lines FROM (SELECT *, concat('status=', status, ', level=', coalesce(max_level_mg_kg || ' mg/kg', 'no numeric cap'), ', conditions: ', coalesce(conditions, '(none)')) AS line FROM clean) WHERE fcs_code <> '' GROUP BY 1, 2),
    near AS (SELECT p.id, p.fcs_code, arg_min(u.code, step) AS code, min(step) AS step FROM (SELECT DISTINCT eu_canonical_id AS id, fcs_code FROM base) p JOIN up u ON u.id = p.id JOIN held h ON h.code = u.code AND h.fcs_code = p.fcs_code GROUP BY 1, 2),
    far AS (SELECT id, string_agg(place, '|' ORDER BY place) AS lines FROM (SELECT DISTINCT id, concat(code, ' in ', CASE WHEN fcs_code = '' THEN 'no category' ELSE fcs_code END, ': status=', status) AS place FROM up JOIN clean ON canonical_id = code) GROUP BY 1),
    told AS (SELECT label_id, item_id, CASE WHEN classification IN ('flavouring', 'enzyme', 'food_ingredient', 'compound') THEN 'out_of_scope' WHEN classification IN ('unknown', 'ambiguous') THEN 'unresolved' WHEN eu_canonical_id IS NULL THEN 'absent'
            WHEN b.at IS NOT NULL THEN 'prohibited' WHEN base.fcs_code IS NULL THEN 'no_pin' WHEN n.step = 0 THEN 'exact' WHEN n.step IS NOT NULL THEN 'widened' WHEN f.id IS NOT NULL THEN 'elsewhere' ELSE 'nowhere' END AS kind,
            b.at AS b_at, n.code AS n_at, h.lines AS n_lines, f.lines AS f_lines
        FROM base LEFT JOIN banned b ON b.id = eu_canonical_id LEFT JOIN near n ON n.id = eu_canonical_id AND n.fcs_code = base.fcs_code LEFT JOIN held h ON h.code = n.code AND h.fcs_code = n.fcs_code LEFT JOIN far f ON f.id = eu_canonical_id)
    SELECT label_id, item_id, kind, CASE WHEN kind = 'prohibited' THEN b_at WHEN kind IN ('exact', 'widened') THEN n_at END AS at, CASE WHEN kind IN ('exact', 'widened') THEN n_lines WHEN kind = 'elsewhere' THEN f_lines ELSE '' END AS lines FROM told""",
)
def item_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pins = load(spark, sf_dir, "labels_top3").where("rank = 1").select("label_id", "fcs_code")
    items = load(spark, sf_dir, "resolved").join(pins, "label_id", "left")
    return J.evidence(items, _permits(spark, sf_dir)).withColumn("lines", F.array_join("lines", "|"))


@query(
    "src15_zone_words",
    (),
    """WITH w AS (SELECT event_id, event_id % 50 AS doc, event_id % 7 AS page, event_id % 600 AS x, value AS y, CASE WHEN event_id % 97 = 0 THEN '*' ELSE event_type END AS text FROM events),
    n AS (SELECT doc, page, min(y) AS note FROM w WHERE text = '*' AND y > 5 GROUP BY 1, 2)
    SELECT w.doc, w.page, count(*) AS n, min(event_id) AS first, round(max(page * 1000 + y), 6) AS g FROM w LEFT JOIN n USING (doc, page)
    WHERE y >= 5 AND y <= least(90.0, coalesce(note - 1, 90.0)) AND x >= 100 AND x < 400 AND page * 1000 + y > 1000 AND page * 1000 + y < 5050 GROUP BY 1, 2""",
)
def zone_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    words = load(spark, sf_dir, "events").select(
        "event_id", (k % 50).alias("doc"), (k % 7).alias("page"), (k % 600).alias("x"), F.col("value").alias("y"), F.when(k % 97 == 0, "*").otherwise(F.col("event_type")).alias("text")
    )
    rows = W.zone(words, (100, 400), (5, 90), 1000.0, F.lit(1000.0), F.lit(5050.0))
    return rows.groupBy("doc", "page").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.round(F.max("g"), 6).alias("g"))


@query(
    "src15_sections",
    (),
    """SELECT o_orderkey AS doc, 1010.0 + o_orderkey % 5 AS first, 2010.0 AS second, CASE WHEN o_orderkey % 3 > 0 THEN 3020.0 END AS third FROM orders""",
)
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a text of three pages: a heading, a list whose title comes twice, and a supplement that a third of them lack."""
    k = F.col("o_orderkey")
    word = lambda page, x, y, text: F.struct(F.lit(page).alias("page"), F.lit(x).alias("x"), y.cast("double").alias("y"), F.lit(text).alias("text"))
    at = 10 + k % 5
    words = F.array(
        word(1, 2, F.lit(5), "No."), word(1, 1, F.lit(5), "INS"), word(1, 1, at, "Functional"), word(1, 2, at, "classes"), word(2, 1, F.lit(10), "INS"), word(2, 2, F.lit(10), "No."),
        word(3, 1, F.lit(10), "INS"), word(3, 9, F.lit(20), "LIST"), word(3, 3, F.lit(20) + F.when(k % 3 == 0, 1).otherwise(0), "SUPPLEMENTARY"),
    )
    rows = load(spark, sf_dir, "orders").select(k.alias("doc"), F.inline(words))
    b = W.boundaries(rows, ["Functional classes", "INS No.", "SUPPLEMENTARY LIST"], 1000.0)
    return b.select("doc", *(F.get("bounds", F.lit(i)).alias(n) for i, n in enumerate(("first", "second", "third"))))


@query(
    "src15_fragments",
    (),
    """SELECT p_partkey AS doc, g, name FROM part, (VALUES (1.0, 'Flour treatment agent', 0), (3.0, 'Colour', 0), (4.0, 'Gum [UNRECOGNISED]', 1), (5.0, 'Glazing agent', 2), (5.0, 'Glazing [INCOMPLETE]', 3)) t(g, name, k)
    WHERE k = 0 OR (k = 1 AND p_size % 2 = 0) OR (k = 2 AND p_size % 3 > 0) OR (k = 3 AND p_size % 3 = 0)""",
)
def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda g, text, cond: F.when(cond, F.struct(F.lit(g).alias("g"), F.lit(text).alias("text")))
    size, always = F.col("p_size"), F.lit(True)
    texts = F.array_compact(F.array(part(3.0, "Colour", always), part(2.0, "agent", always), part(1.0, "Flour treatment", always), part(4.0, "Gum", size % 2 == 0), part(5.0, "Glazing", always), part(6.0, "agent", size % 3 > 0)))
    rows = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), F.inline(texts))
    return W.merged_fragments(rows, ("Colour", "Flour treatment agent", "Glazing agent"))
