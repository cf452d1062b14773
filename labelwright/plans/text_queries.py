"""Queries of the scalar functions, over the texts at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..functions import text as T
from .registry import load, query

IDS = ("items",)


@query(
    "fn_code_normalisers",
    IDS,
    r"""SELECT canonical_id, count(*) AS n, regexp_replace(replace(lower(concat('INS ', canonical_id)), ' ', ''), '^(ins|e)', '') AS code,
        CASE WHEN regexp_matches(canonical_id, '^.*\([ivxlc]+\)$') THEN regexp_extract(canonical_id, '^(.*)\([ivxlc]+\)$', 1)
             WHEN regexp_matches(canonical_id, '^\d+[a-z]$') THEN regexp_extract(canonical_id, '^(\d+)[a-z]$', 1) END AS parent
        FROM items GROUP BY canonical_id""",
)
def code_normalisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "items").groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("code", N.normalise_code(F.concat(F.lit("INS "), "canonical_id"))).withColumn("parent", N.parent_ins(F.col("canonical_id")))


@query(
    "fn_category_codes",
    ("permits",),
    r"""SELECT fcs_code, CASE WHEN contains(fcs_code, '.') THEN regexp_extract(fcs_code, '^(.*)\.[^.]+$', 1) END AS parent, count(*) AS n
        FROM (SELECT rtrim(split_part(food_category_raw, ' ', 1), '.') AS fcs_code FROM permits WHERE food_category_raw IS NOT NULL) GROUP BY ALL""",
)
def category_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "permits").where("food_category_raw is not null").select(N.category_code(F.col("food_category_raw")).alias("fcs_code"))
    return rows.groupBy("fcs_code").agg(F.count(F.lit(1)).alias("n")).withColumn("parent", N.dotted_parent(F.col("fcs_code")))


@query("fn_clean_html", (), r"""SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (
    SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', ' ', 'g'), '<[^>]+>', '', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS t FROM pages)""")
def clean_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = N.clean_html(F.col("html"))
    return load(spark, sf_dir, "pages").select("page_id", F.length(t).cast("long").alias("n_chars"), F.md5(t.cast("binary")).alias("digest"))


@query("scl1_gate_confidence", (), "SELECT user_id, count(DISTINCT event_type) AS n_evidence, least(count(DISTINCT event_type), 5) / 5.0 AS confidence FROM events GROUP BY user_id")
def gate_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("n_evidence"))
    return rows.withColumn("confidence", T.gate_confidence(F.col("n_evidence")))


@query(
    "scl2_stop_reason",
    (),
    """SELECT doc_id, CASE WHEN lang = 'de' THEN 'not_a_food_label' WHEN NOT contains(text, ',') THEN 'no_ingredients_declaration' WHEN n_chars < 40 THEN 'no_items' END AS stop_reason FROM documents""",
)
def stop_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.when(F.col("n_chars") < 40, 0).otherwise(1)
    return load(spark, sf_dir, "documents").select("doc_id", T.stop_reason(F.col("lang") != "de", F.contains("text", F.lit(",")), items).alias("stop_reason"))


@query(
    "scl3_bbox",
    (),
    """SELECT vec_id, CASE WHEN r - l >= 0.05 AND b - t >= 0.05 THEN round(l, 6) END AS x0, CASE WHEN r - l >= 0.05 AND b - t >= 0.05 THEN round((r - l) * (b - t), 6) END AS area FROM (
        SELECT vec_id, least(x, z) AS l, greatest(x, z) AS r, least(y, w) AS t, greatest(y, w) AS b FROM (
            SELECT vec_id, least(greatest(embedding[1]::DOUBLE, 0), 1) AS x, least(greatest(embedding[2]::DOUBLE, 0), 1) AS y,
                   least(greatest(embedding[3]::DOUBLE, 0), 1) AS z, least(greatest(embedding[4]::DOUBLE, 0), 1) AS w FROM embeddings))""",
)
def bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [F.get("embedding", F.lit(i)).cast("double") for i in range(4)]
    box = T.bbox(*e)
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(box["x0"], 6).alias("x0"), F.round((box["x1"] - box["x0"]) * (box["y1"] - box["y0"]), 6).alias("area"))


_CODES = r"""SELECT DISTINCT canonical_id, concat(CASE length(canonical_id) % 4 WHEN 0 THEN 'E' WHEN 1 THEN 'INS ' WHEN 2 THEN 'x' ELSE '' END, canonical_id) AS declared FROM items"""


@query(
    "scl5_code_system",
    IDS,
    # every id is a code of its own; what the query sets before it tells the system, and an x makes it none
    f"""SELECT canonical_id, declared, CASE length(canonical_id) % 4 WHEN 0 THEN 'E' WHEN 1 THEN 'INS' WHEN 3 THEN 'bare' END AS system FROM ({_CODES})""",
)
def code_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "items").select("canonical_id").distinct()
    k = F.length("canonical_id") % 4
    declared = F.concat(F.when(k == 0, "E").when(k == 1, "INS ").when(k == 2, "x").otherwise(""), "canonical_id")
    return rows.withColumn("declared", declared).withColumn("system", T.code_system(F.col("declared")))


@query("scl7_balanced", (), r"""SELECT doc_id, (d >= 0 AND last = 0) AS balanced FROM (
    SELECT doc_id, coalesce(min(s), 0) AS d, coalesce(arg_max(s, i), 0) AS last FROM (
        SELECT doc_id, i, sum(CASE WHEN c IN ('(', '[') THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY i) AS s
        FROM (SELECT doc_id, unnest(m) AS c, generate_subscripts(m, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[()\[\]]') AS m FROM documents)))
    GROUP BY doc_id) UNION ALL SELECT doc_id, true FROM documents WHERE len(regexp_extract_all(text, '[()\[\]]')) = 0""")
def balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.is_balanced(F.col("text")).alias("balanced"))


@query(
    "scl8_split_top_level",
    (),
    r"""WITH pieces AS (
        SELECT doc_id, unnest(string_split(text, ',')) AS p, generate_subscripts(string_split(text, ','), 1) AS i FROM documents),
    deep AS (
        SELECT doc_id, p, i, sum(length(regexp_replace(p, '[^(\[]', '', 'g')) - length(regexp_replace(p, '[^)\]]', '', 'g'))) OVER (PARTITION BY doc_id ORDER BY i) AS d FROM pieces),
    part AS (SELECT doc_id, p, i, count(*) FILTER (WHERE d = 0) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM deep),
    whole AS (SELECT doc_id, g, regexp_replace(string_agg(p, ',' ORDER BY i), '^\s+|\s+$', '', 'g') AS part FROM part GROUP BY doc_id, g)
    SELECT doc_id, count(*) AS n, md5(string_agg(part, '|' ORDER BY g)) AS digest FROM whole WHERE part <> '' GROUP BY doc_id""",
)
def split_top_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "documents").select("doc_id", T.split_top_level(F.col("text")).alias("parts")).where(F.size("parts") > 0)
    return parts.select("doc_id", F.size("parts").cast("long").alias("n"), F.md5(F.array_join("parts", "|").cast("binary")).alias("digest"))


@query(
    "scl9_simple_item",
    IDS,
    r"""SELECT canonical_id, declared, CASE WHEN own THEN NULL WHEN paired THEN trim(regexp_extract(declared, '^([^()\[\]]+)[(\[](.*)[)\]]\s*$', 1)) ELSE declared END AS name,
        CASE WHEN own THEN declared WHEN paired THEN trim(regexp_extract(declared, '^([^()\[\]]+)[(\[](.*)[)\]]\s*$', 2)) END AS code FROM (
        SELECT canonical_id, declared, regexp_matches(declared, '(?i)^(INS|E)?\s*(\d{3,4})([a-z])?(\([ivx]+\))?$') AS own,
            regexp_matches(declared, '^([^()\[\]]+)[(\[](.*)[)\]]\s*$') AND regexp_matches(trim(regexp_extract(declared, '^([^()\[\]]+)[(\[](.*)[)\]]\s*$', 2)), '(?i)^(INS|E)?\s*(\d{3,4})([a-z])?(\([ivx]+\))?$') AS paired
        FROM (SELECT DISTINCT canonical_id, CASE length(canonical_id) % 3 WHEN 0 THEN concat('E', canonical_id) WHEN 1 THEN concat('Citric Acid (INS ', canonical_id, ')') ELSE 'Sugar' END AS declared FROM items))""",
)
def simple_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.length("canonical_id") % 3
    declared = F.when(k == 0, F.concat(F.lit("E"), "canonical_id")).when(k == 1, F.concat(F.lit("Citric Acid (INS "), "canonical_id", F.lit(")"))).otherwise("Sugar")
    rows = load(spark, sf_dir, "items").select("canonical_id").distinct().withColumn("declared", declared)
    item = T.simple_item(F.col("declared"))
    return rows.select("canonical_id", "declared", item["name"].alias("name"), item["code"].alias("code"))


@query("scl6_functional_class", (), """SELECT p_type, p_name, (lower(concat(CASE WHEN p_size % 2 = 0 THEN 'permitted ' ELSE '' END, 'emulsifier')) IN ('emulsifier', 'permitted emulsifier') AND p_size % 3 = 0) AS is_class, count(*) AS n
    FROM part GROUP BY ALL""")
def functional_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrase = F.concat(F.when(F.col("p_size") % 2 == 0, "Permitted ").otherwise(""), F.when(F.col("p_size") % 3 == 0, "Emulsifiers").otherwise("Sugars"))
    return load(spark, sf_dir, "part").groupBy("p_type", "p_name", T.is_functional_class(phrase).alias("is_class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "scl13_parse_level",
    ("permits",),
    r"""SELECT row_ord, CASE WHEN raw = 'GMP' THEN NULL ELSE try_cast(nullif(replace(regexp_extract(raw, '([\d,]+(?:\.\d+)?)\s*(mg/kg|mg/l|%)', 1), ',', ''), '') AS double) END AS level,
        CASE WHEN raw = 'GMP' THEN 'gmp' WHEN regexp_matches(raw, '[\d,]+(\.\d+)?\s*(mg/kg|mg/l|%)') THEN regexp_extract(raw, '(mg/kg|mg/l|%)', 1) ELSE 'conditional' END AS basis FROM (
        SELECT row_ord, CASE WHEN max_level_mg_kg IS NULL THEN CASE WHEN conditions IS NULL THEN 'GMP' ELSE 'see note' END
            ELSE concat(CAST(CAST(max_level_mg_kg AS bigint) AS string), CASE WHEN max_level_mg_kg > 300 THEN ' mg/kg' ELSE ' mg/l' END) END AS raw FROM permits)""",
)
def parse_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.col("max_level_mg_kg")
    raw = F.when(level.isNull(), F.when(F.col("conditions").isNull(), "GMP").otherwise("see note")).otherwise(F.concat(level.cast("long").cast("string"), F.when(level > 300, " mg/kg").otherwise(" mg/l")))
    parsed = T.parse_level(raw)
    return load(spark, sf_dir, "permits").select("row_ord", parsed["level"].alias("level"), parsed["basis"].alias("basis"))


@query(
    "scl15_join_conditions",
    ("permits",),
    """SELECT row_ord, CASE WHEN notes = '' THEN NULL ELSE concat('text ', split_part(notes, ',', 1), ' [Note ', split_part(notes, ',', 1), '] | text ', split_part(notes, ',', 2), ' [Note ', split_part(notes, ',', 2), ']') END AS joined FROM permits""",
)
def join_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.when(F.col("notes") == "", F.array().cast("array<string>")).otherwise(F.split("notes", ","))
    return load(spark, sf_dir, "permits").select("row_ord", T.join_conditions(codes, F.transform(codes, lambda c: F.concat(F.lit("text "), c))).alias("joined"))


@query(
    "scl17_first_sentence",
    (),
    r"""SELECT item_id, CASE WHEN regexp_matches(text, '[.!?]\s+[A-Z(]') THEN regexp_extract(text, '^((?s:.*?)[.!?])\s+[A-Z(]', 1) ELSE text END AS sentence FROM benchmark""",
)
def first_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select("item_id", T.first_sentence(F.col("text")).alias("sentence"))


_ROLES = "CASE p_size % 6 WHEN 0 THEN 'Permitted Emulsifying Agents' WHEN 1 THEN 'Emulsifying and Stabilizing Agent' WHEN 2 THEN 'Stabilisers' WHEN 3 THEN 'EMULSIFIER OF VEGETABLE ORIGIN' WHEN 4 THEN 'Leavening Agents' ELSE NULL END"


@query(
    "scl18_normalise_role",
    (),
    f"""SELECT role, CASE role WHEN 'Permitted Emulsifying Agents' THEN 'Emulsifier' WHEN 'Emulsifying and Stabilizing Agent' THEN 'Emulsifier, Stabilizer' WHEN 'Stabilisers' THEN 'Stabilizer'
        WHEN 'EMULSIFIER OF VEGETABLE ORIGIN' THEN 'Emulsifier' WHEN 'Leavening Agents' THEN 'Raising agent' ELSE '' END AS classes, count(*) AS n FROM (SELECT {_ROLES} AS role FROM part) GROUP BY ALL""",
)
def normalise_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    purposes = F.create_map(*(F.lit(x) for kv in {"emulsifier": "Emulsifier", "stabilizer": "Stabilizer", "raising agent": "Raising agent", "humectant": "Humectant"}.items() for x in kv))
    rows = load(spark, sf_dir, "part").select(F.expr(_ROLES).alias("role"))
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n")).withColumn("classes", F.array_join(T.normalise_role(F.col("role"), purposes), ", "))


@query("scl20_routing_band", (), "SELECT CASE WHEN c >= 0.95 THEN 'straight_through' WHEN c >= 0.8 THEN 'review_flag' WHEN c > 0 THEN 'never_to_rule_engine' ELSE 'manual_review' END AS band, count(*) AS n FROM (SELECT (event_id % 101) / 100.0 AS c FROM events) GROUP BY ALL")
def routing_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy(T.routing_band((F.col("event_id") % 101) / 100.0).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "scl22_validate_url",
    (),
    r"""SELECT page_id, concat_ws(',', CASE WHEN NOT regexp_matches(u, '^https?://[^\s/?#]+') THEN 'malformed_source_url' END, CASE WHEN page_id % 5 = 0 THEN 'no_published_date' END) AS flags
        FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN replace(url, '://', ':/') ELSE url END AS u FROM pages)""",
)
def validate_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.when(F.col("page_id") % 7 == 0, F.replace("url", F.lit("://"), F.lit(":/"))).otherwise(F.col("url"))
    flags = F.concat_ws(",", F.when(~T.is_well_formed_url(u), "malformed_source_url"), F.when(F.col("page_id") % 5 == 0, "no_published_date"))
    return load(spark, sf_dir, "pages").select("page_id", flags.alias("flags"))


@query(
    "scl23_rfc2822_date",
    (),
    "SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN CAST(ts AS date) END AS published FROM events",
)
def rfc2822_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = F.array(*(F.lit(m) for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()))
    raw = F.concat(F.lit("Mon, "), F.lpad(F.dayofmonth("ts").cast("string"), 2, "0"), F.lit(" "), F.element_at(months, F.month("ts")), F.lit(" "), F.year("ts").cast("string"), F.lit(" 10:00:00 GMT"))
    raw = F.when(F.col("event_id") % 11 == 0, "yesterday").otherwise(raw)
    return load(spark, sf_dir, "events").select("event_id", T.rfc2822_date(raw).alias("published"))


@query("scl24_prefilter", (), r"""SELECT d.doc_id, list_has_any(list_filter(regexp_extract_all(lower(n), '[a-z0-9_]+'), lambda x: length(x) >= 4), regexp_extract_all(lower(d.text), '[\p{L}\p{M}\p{N}\p{Pc}]+')) AS relevant,
    (doc_id % 10) / 10.0 >= 0.6 AS scored FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'thing of note' WHEN 1 THEN 'that nation' ELSE 'with tion' END AS n FROM documents) d""")
def prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    name = F.when(k == 0, "thing of note").when(k == 1, "that nation").otherwise("with tion")
    rows = load(spark, sf_dir, "documents")
    return rows.select("doc_id", T.is_relevant(name, F.col("text")).alias("relevant"), T.meets_score((F.col("doc_id") % 10) / 10.0).alias("scored"))


_QUOTE = "concat(CASE event_id % 4 WHEN 0 THEN 'The review was completed' WHEN 1 THEN 'The ban is ongoing' WHEN 2 THEN 'Lots were Recalled and banned' ELSE 'It is under study' END, ' for ', event_type)"


_KINDS = ("regulatory_review", "safety_opinion", "import_control", "border_rejection", "market_action")
_CLAIM = "concat(CASE event_id % 7 WHEN 0 THEN 'The review was Completed' WHEN 1 THEN 'The work is in progress' WHEN 2 THEN 'Lots were recalled' WHEN 3 THEN 'The ministry plans to act' WHEN 4 THEN 'Nothing concludes' ELSE 'It is under study' END, ' for ', event_type)"


@query(
    "scl25_category_consistency",
    (),
    f"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id % 7 IN (0, 4) WHEN 1 THEN event_id % 7 = 1 WHEN 2 THEN event_id % 7 = 2 WHEN 3 THEN event_id % 7 = 3 ELSE false END AS contradicts FROM events""",
)
def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.get(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % 5).cast("int"))
    return load(spark, sf_dir, "events").select("event_id", T.contradicts_category(category, F.expr(_CLAIM)).alias("contradicts"))


@query(
    "scl26_verbatim_quote",
    (),
    r"""SELECT doc_id, contains(trim(regexp_replace(text, '\s+', ' ', 'g')), trim(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN concat(' ', replace(substring(text, 5, 60), ' ', '  ')) ELSE concat(substring(text, 5, 20), '#', lang) END, '\s+', ' ', 'g'))) AS verbatim FROM documents""",
)
def verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    quote = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.replace(F.substring("text", 5, 60), F.lit(" "), F.lit("  ")))).otherwise(F.concat(F.substring("text", 5, 20), F.lit("#"), "lang"))
    return load(spark, sf_dir, "documents").select("doc_id", T.quotes_verbatim(quote, F.col("text")).alias("verbatim"))


@query(
    "scl27_modality_backstop",
    (),
    rf"""WITH t AS (SELECT event_id, {_QUOTE} AS quote, CASE WHEN event_id % 4 = 2 THEN 'nothing' WHEN event_id % 3 = 0 THEN 'a ban on use' ELSE 'a study' END AS source FROM events),
    f AS (SELECT event_id, lower(source) AS source, list_transform(regexp_extract_all(quote, '(?i)\b({'|'.join(T.MODALITY)})\b', 1), lambda x: lower(x)) AS said FROM t)
    SELECT event_id, array_to_string(list_filter(said, lambda x: NOT contains(source, x)), ',') AS unbacked FROM f""",
)
def modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("event_id") % 3 == 0, "a ban on use").otherwise("a study")
    source = F.when(F.col("event_id") % 4 == 2, F.lit("nothing")).otherwise(source)
    return load(spark, sf_dir, "events").select("event_id", F.array_join(T.unbacked_modality(F.expr(_QUOTE), source), ",").alias("unbacked"))


@query(
    "scl29_faithfulness",
    ("permits",),
    # of the code an other one is claimed where n is 1, with a space where n is 2; levels and 12.2 are backed where the row has them
    r"""WITH claimed AS (SELECT row_ord, canonical_id, max_level_mg_kg AS level, food_category_raw AS category, CAST(substring(row_ord, 1, 12) AS bigint) % 3 AS n FROM permits),
    judged AS (SELECT *, CAST(CAST(coalesce(level, 7) AS bigint) AS string) AS amount,
        concat('E', canonical_id, ' ', coalesce(CAST(CAST(level AS bigint) AS string), '-'), ' mg/kg ', coalesce(category, '')) AS source FROM claimed)
    SELECT row_ord, concat_ws(',', CASE WHEN n = 1 AND NOT contains(source, '999') THEN '999' END, CASE WHEN NOT contains(source, amount) THEN amount END, CASE WHEN NOT contains(source, '12.2') THEN '12.2' END) AS unsupported FROM judged""",
)
def faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.report import unsupported_claims

    n, level = F.substring("row_ord", 1, 12).cast("long") % 3, F.col("max_level_mg_kg").cast("long")
    code = F.when(n == 1, F.lit("E999")).otherwise(F.concat(F.when(n == 2, "e ").otherwise("E"), "canonical_id"))
    text = F.concat(code, F.lit(" is limited to "), F.coalesce(level, F.lit(7)).cast("string"), F.lit(" mg/kg in 12.2"))
    source = F.concat(F.lit("E"), "canonical_id", F.lit(" "), F.coalesce(level.cast("string"), F.lit("-")), F.lit(" mg/kg "), F.coalesce("food_category_raw", F.lit("")))
    return load(spark, sf_dir, "permits").select("row_ord", F.array_join(unsupported_claims(text, source), ",").alias("unsupported"))


@query("scl31_strip_fences", (), r"SELECT conv_id, turn, md5(trim(text)) AS digest FROM conversations")
def strip_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), F.trim("text"), F.lit("\n```"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.strip_fences(fenced).cast("binary")).alias("digest"))


@query(
    "scl32_level_phrase",
    ("permits",),
    "SELECT max_level_mg_kg AS level, max_level_basis AS basis, CASE WHEN max_level_mg_kg IS NULL THEN 'no fixed limit' ELSE concat('up to ', CAST(CAST(max_level_mg_kg AS bigint) AS string), ' mg/kg') END AS phrase, count(*) AS n FROM permits GROUP BY ALL",
)
def level_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "permits").groupBy(F.col("max_level_mg_kg").alias("level"), F.col("max_level_basis").alias("basis")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("phrase", T.level_phrase(F.col("level")))


@query(
    "scl33_short_description",
    (),
    r"""WITH s AS (SELECT item_id, CASE WHEN regexp_matches(text, '[.!?]\s+[A-Z(]') THEN regexp_extract(text, '^((?s:.*?)[.!?])\s+[A-Z(]', 1) ELSE text END AS s FROM benchmark)
    SELECT item_id, CASE WHEN length(s) <= 60 THEN s ELSE concat(regexp_replace(left(s, 60), '\s+[^\s]*$', ''), '…') END AS short FROM s""",
)
def short_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select("item_id", T.short_description(F.col("text"), 60).alias("short"))


@query(
    "scl35_natural_sort",
    ("permits",),
    """SELECT fcs_code, row_number() OVER (ORDER BY CAST(split_part(fcs_code, '.', 1) AS int), coalesce(try_cast(split_part(fcs_code, '.', 2) AS int), -1)) AS place
        FROM (SELECT DISTINCT rtrim(split_part(food_category_raw, ' ', 1), '.') AS fcs_code FROM permits WHERE food_category_raw IS NOT NULL)""",
)
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    codes = load(spark, sf_dir, "permits").where("food_category_raw is not null").select(N.category_code(F.col("food_category_raw")).alias("fcs_code")).distinct()
    # the taxonomy has a few hundred codes at most: one window over them is no bottleneck
    return codes.select("fcs_code", F.row_number().over(Window.orderBy(N.sort_key(F.col("fcs_code")))).cast("long").alias("place"))


@query(
    "scl36_content_hash",
    ("permits",),
    "SELECT substring(sha256(string_agg(concat(canonical_id, '|', status), ';' ORDER BY canonical_id, status)), 1, 12) AS version FROM (SELECT DISTINCT canonical_id, status FROM permits)",
)
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.report import content_version

    return content_version(load(spark, sf_dir, "permits").select("canonical_id", "status").distinct(), ["canonical_id", "status"])


@query("scl11_l2_normalise", (), "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS squared FROM embeddings")
def l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.retrieval import dot, l2_normalised

    v = l2_normalised(F.col("embedding"))
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(dot(v, v), 6).alias("squared"))
