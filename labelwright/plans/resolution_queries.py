"""Queries of identity and scoping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolution as R
from ..operators import scoping as S
from .registry import VIEWS, load, query

VIEWS["declared"] = """
    SELECT label_id, item_id, CASE WHEN item_id > 1 AND item_id % 3 <> 1 THEN CAST(floor(item_id / 2) AS int) END AS parent_item_id,
           CASE WHEN item_id % 3 = 0 THEN NULL ELSE concat(CASE WHEN item_id % 2 = 0 THEN 'INS ' ELSE 'E' END, code) END AS declared_code,
           CASE item_id % 4 WHEN 0 THEN concat(' ', upper(p_name)) WHEN 1 THEN p_type WHEN 2 THEN p_brand ELSE concat(p_name, ' flavouring') END AS name_as_declared,
           CASE WHEN item_id % 5 = 0 THEN 'Emulsifiers' END AS declared_role
    FROM (SELECT l_orderkey AS label_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS int) AS item_id,
                 concat(CAST(100 + l_partkey % 600 AS string), CASE l_linenumber % 4 WHEN 1 THEN 'a' WHEN 2 THEN '(i)' ELSE '' END) AS code, p_name, p_type, p_brand
          FROM lineitem JOIN part ON l_partkey = p_partkey) t"""


def _substances(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    classes = F.when(F.col("class_b") == "", none).otherwise(F.array("class_a", "class_b"))
    return load(spark, sf_dir, "substances").withColumn("functional_classes", classes)


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _substances(spark, sf_dir).withColumnRenamed("name", "term")
    alias = s.where("row_ord % 3 = 0").select(F.col("class_a").alias("term"), "ins", "row_ord")
    brands = load(spark, sf_dir, "part").select(F.col("p_brand").alias("term")).where("p_brand like '%1'")
    vague = load(spark, sf_dir, "part").select(F.col("p_brand").alias("term")).where("p_brand like '%2'")
    return R.lookups(s, s.where("row_ord % 2 = 0"), alias, brands, vague)


_PARENT = r"CASE WHEN regexp_matches({c}, '^.*\([ivxlc]+\)$') THEN regexp_extract({c}, '^(.*)\([ivxlc]+\)$', 1) WHEN regexp_matches({c}, '^\d+[a-z]$') THEN regexp_extract({c}, '^(\d+)[a-z]$', 1) END"
_CODED = rf"""coded AS (
    SELECT *, {_PARENT.format(c="code")} AS wider FROM (SELECT *, regexp_replace(replace(lower(declared_code), ' ', ''), '^(ins|e)', '') AS code FROM declared WHERE declared_code IS NOT NULL)),
known AS (SELECT DISTINCT ins FROM substances),
by_code AS (
    SELECT c.*, coalesce(a.ins, b.ins) AS ins, CASE WHEN a.ins IS NOT NULL THEN 'code_exact' WHEN b.ins IS NOT NULL THEN 'code_parent' END AS method,
           CASE WHEN a.ins IS NOT NULL THEN 0.98 WHEN b.ins IS NOT NULL THEN 0.90 ELSE 0.0 END AS confidence
    FROM coded c LEFT JOIN known a ON c.code = a.ins LEFT JOIN known b ON c.wider = b.ins)"""
_NORM = "trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"
_NAMED = f"""tiers AS (
    SELECT {_NORM.format(c="name")} AS key, 1 AS tier, arg_max(ins, row_ord) AS ins, 'codex_name' AS method, 0.98 AS confidence FROM substances GROUP BY 1
    UNION ALL SELECT {_NORM.format(c="class_a")}, 3, arg_max(ins, row_ord), 'alias', 0.92 FROM substances WHERE row_ord % 3 = 0 GROUP BY 1
    UNION ALL SELECT DISTINCT {_NORM.format(c="p_brand")}, 4, NULL, 'food_lexicon', 0.95 FROM part WHERE p_brand LIKE '%1'
    UNION ALL SELECT DISTINCT {_NORM.format(c="p_brand")}, 5, NULL, 'ambiguous', 0.0 FROM part WHERE p_brand LIKE '%2'),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier) AS k FROM tiers) WHERE k = 1),
by_name AS (
    SELECT d.*, b.ins, coalesce(b.method, 'unresolved') AS method, coalesce(b.confidence, 0.0) AS confidence
    FROM (SELECT *, {_NORM.format(c="name_as_declared")} AS key FROM declared) d LEFT JOIN best b ON d.key = b.key)"""


@query("jn2_code_resolution", ("declared", "substances"), f"WITH {_CODED} SELECT label_id, item_id, ins, method, confidence FROM by_code")
def code_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "declared").where("declared_code is not null")
    return R.resolve_by_code(items, _substances(spark, sf_dir)).select("label_id", "item_id", "ins", "method", "confidence")


@query("jn3_name_cascade", ("declared", "substances"), f"WITH {_NAMED} SELECT label_id, item_id, ins, method, confidence FROM by_name")
def name_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.resolve_by_name(load(spark, sf_dir, "declared"), _tiers(spark, sf_dir)).select("label_id", "item_id", "ins", "method", "confidence")


@query(
    "jn1_lookup_tables",
    ("substances",),
    "WITH " + _NAMED.split("),\nbest AS")[0] + ") SELECT key, tier, ins, method FROM tiers UNION ALL SELECT " + _NORM.format(c="name") + ", 2, arg_min(ins, row_ord), 'codex_name' FROM substances WHERE row_ord % 2 = 0 GROUP BY 1",
)
def lookup_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiers(spark, sf_dir).select("key", "tier", "ins", "method")


@query("jn4_fuzzy_names", ())
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = load(spark, sf_dir, "part").select(F.concat(F.col("p_name"), F.lit(" extra")).alias("name"))
    firsts = _substances(spark, sf_dir).groupBy("name").agg(F.min("row_ord").alias("row_ord"), F.min_by("ins", "row_ord").alias("ins"))
    return R.fuzzy_match(names, firsts)


_GUARDED = ", ".join(f"'{x}'" for x in R.GUARDED)


@query(
    "tv5_resolve_items",
    ("declared", "substances", "permits"),
    f"""WITH {_CODED}, {_NAMED},
    both_ AS (
        SELECT label_id, item_id, parent_item_id, name_as_declared, declared_role, ins, coalesce(method, 'unresolved') AS method, confidence FROM by_code
        UNION ALL SELECT label_id, item_id, parent_item_id, name_as_declared, declared_role, ins, method, confidence FROM by_name WHERE declared_code IS NULL),
    guarded AS (SELECT *, coalesce(ins IN ({_GUARDED}) AND method <> 'code_exact', false) AS guard FROM both_),
    kinds AS (
        SELECT *, CASE WHEN guard OR method = 'ambiguous' THEN 'ambiguous' WHEN method = 'food_lexicon' THEN CASE WHEN declared_role IS NOT NULL THEN 'ambiguous' ELSE 'food_ingredient' END
            WHEN ins IS NOT NULL THEN 'additive' WHEN contains(lower(concat(coalesce(declared_role, ''), ' ', name_as_declared)), 'flavour') THEN 'flavouring' ELSE 'unknown' END AS kind FROM guarded),
    conf AS (SELECT *, CASE WHEN guard THEN 0.5 WHEN method = 'food_lexicon' AND declared_role IS NOT NULL THEN 0.0 WHEN ins IS NULL AND kind = 'flavouring' THEN 0.95 ELSE confidence END AS c FROM kinds),
    eu AS (SELECT DISTINCT canonical_id FROM permits),
    named_alike AS (SELECT regexp_extract(canonical_id, '^[0-9]+', 0) AS family, arg_min(canonical_id, row_ord) AS n_id FROM permits GROUP BY 1),
    crossed AS (
        SELECT k.* REPLACE (CASE WHEN a.canonical_id IS NULL AND b.canonical_id IS NULL AND n_id IS NOT NULL THEN least(c, 0.75) ELSE c END AS c), coalesce(a.canonical_id, b.canonical_id, n_id) AS eu_canonical_id FROM (SELECT *, {_PARENT.format(c="ins")} AS wider FROM conf) k
        LEFT JOIN eu a ON k.ins = a.canonical_id LEFT JOIN eu b ON k.wider = b.canonical_id LEFT JOIN named_alike ON regexp_extract(k.ins, '^[0-9]+', 0) = family),
    parents AS (SELECT DISTINCT label_id, parent_item_id AS p FROM declared WHERE parent_item_id IS NOT NULL)
    SELECT x.label_id, x.item_id, ins, eu_canonical_id, CASE WHEN p IS NOT NULL AND kind <> 'additive' THEN 'compound' ELSE kind END AS classification,
           CASE WHEN p IS NOT NULL AND kind <> 'additive' THEN 'structural' ELSE method END AS method, CASE WHEN p IS NOT NULL AND kind <> 'additive' THEN 0.95 ELSE c END AS confidence
    FROM crossed x LEFT JOIN parents q ON x.label_id = q.label_id AND x.item_id = q.p""",
)
def resolve_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.resolve_items(load(spark, sf_dir, "declared"), _substances(spark, sf_dir), _tiers(spark, sf_dir), load(spark, sf_dir, "permits"))
    return rows.select("label_id", "item_id", "ins", "eu_canonical_id", "classification", "method", "confidence")


_TREE = """WITH RECURSIVE climb AS (
    SELECT label_id, item_id, item_id AS spot, parent_item_id AS up, 0 AS depth FROM items
    UNION ALL SELECT c.label_id, c.item_id, i.item_id, i.parent_item_id, c.depth + 1 FROM climb c JOIN items i ON c.label_id = i.label_id AND c.up = i.item_id),
roots AS (SELECT label_id, item_id, spot AS root, depth FROM climb WHERE up IS NULL),
parents AS (SELECT DISTINCT label_id, parent_item_id AS p FROM items WHERE parent_item_id IS NOT NULL),
comps AS (
    SELECT i.*, r.root, r.depth, q.p IS NOT NULL AS is_compound, CASE WHEN t.p IS NOT NULL THEN r.root END AS component
    FROM items i JOIN roots r ON i.label_id = r.label_id AND i.item_id = r.item_id LEFT JOIN parents q ON i.label_id = q.label_id AND i.item_id = q.p
    LEFT JOIN parents t ON i.label_id = t.label_id AND r.root = t.p)"""


def _tree(body: str) -> str:
    return _TREE.replace("WITH RECURSIVE ", "WITH ", 1) + body


@query("jn6_component_roots", ("items",), _tree(" SELECT label_id, item_id, root AS root_item_id, depth, component FROM comps"))
def component_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_components(load(spark, sf_dir, "items")).select("label_id", "item_id", "root_item_id", "depth", "component")


@query(
    "tv3_category_queries",
    ("items",),
    _tree(""", product AS (
        SELECT label_id, NULL::INT AS component, string_agg(concat('n', item_id), ', ' ORDER BY item_id) AS text, count(*) FILTER (WHERE item_id % 2 = 0) AS n_additives
        FROM comps WHERE depth = 0 AND NOT is_compound GROUP BY label_id),
    part AS (
        SELECT label_id, component, string_agg(concat('n', item_id), ', ' ORDER BY item_id) AS text, count(*) FILTER (WHERE item_id % 2 = 0) AS n_additives
        FROM comps WHERE depth > 0 AND component IS NOT NULL GROUP BY label_id, component)
    SELECT * FROM product UNION ALL SELECT * FROM part WHERE n_additives > 0"""),
)
def category_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "items").withColumn("name", F.concat(F.lit("n"), F.col("item_id").cast("string")))
    items = items.withColumn("additive_id", F.when(F.col("item_id") % 2 == 0, F.concat("canonical_id", F.lit("#"), F.col("item_id").cast("string"))))
    return S.category_queries(items).select("label_id", "component", "text", F.size("additive_ids").cast("long").alias("n_additives"))


@query(
    "jn7_item_category",
    ("items",),
    _tree(""" SELECT label_id, item_id, CASE WHEN component % 2 = 1 THEN concat('c', component) WHEN label_id % 2 = 0 THEN 'p' END AS fcs_code,
        CASE WHEN component % 2 = 1 THEN 'component' WHEN label_id % 2 = 0 THEN 'product' ELSE 'none' END AS scope FROM comps"""),
)
def item_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.with_components(load(spark, sf_dir, "items")).select("label_id", "item_id", "component")
    own = rows.where("component % 2 = 1").select("label_id", "component", F.concat(F.lit("c"), F.col("component").cast("string")).alias("fcs_code")).distinct()
    whole = rows.where("label_id % 2 = 0").select("label_id", F.lit(None).cast("int").alias("component"), F.lit("p").alias("fcs_code")).distinct()
    return S.item_category(rows, own.unionByName(whole)).select("label_id", "item_id", "fcs_code", "scope")


@query(
    "jn18_redundant_children",
    ("items",),
    """WITH texts AS (SELECT *, CASE WHEN item_id % 2 = 1 THEN canonical_id ELSE concat('x', canonical_id) END AS verbatim FROM items),
    lone AS (SELECT label_id, parent_item_id, min(item_id) AS item_id FROM texts WHERE parent_item_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1)
    SELECT t.label_id, t.item_id FROM texts t LEFT JOIN lone l ON t.label_id = l.label_id AND t.item_id = l.item_id
    LEFT JOIN texts p ON p.label_id = l.label_id AND p.item_id = l.parent_item_id WHERE NOT coalesce(t.verbatim = t.canonical_id AND contains(p.verbatim, t.canonical_id), false)""",
)
def redundant_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "items").withColumn("verbatim", F.when(F.col("item_id") % 2 == 1, F.col("canonical_id")).otherwise(F.concat(F.lit("x"), "canonical_id"))).withColumn("declared_code", F.col("canonical_id"))
    return S.drop_redundant_children(items.select("label_id", "item_id", "parent_item_id", "verbatim", "declared_code")).select("label_id", "item_id")


@query("jn14_display_names", ("resolved", "permits", "substances"), """WITH eu AS (SELECT canonical_id, arg_min(additive_name, row_ord) AS n FROM permits GROUP BY 1),
    codex AS (SELECT ins, arg_max(name, row_ord) AS n FROM substances GROUP BY 1)
    SELECT label_id, item_id, coalesce(eu.n, codex.n || ' (INS ' || canonical_ins || ')', 'item ' || item_id) AS display FROM resolved r LEFT JOIN eu ON r.eu_canonical_id = eu.canonical_id LEFT JOIN codex ON r.canonical_ins = codex.ins""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    eu = load(spark, sf_dir, "permits").groupBy(F.col("canonical_id").alias("e_id")).agg(F.min_by("additive_name", "row_ord").alias("e_name"))
    codex = R.registry(_substances(spark, sf_dir)).select(F.col("ins").alias("c_ins"), F.col("name").alias("c_name"))
    rows = load(spark, sf_dir, "resolved").join(eu, F.col("eu_canonical_id") == F.col("e_id"), "left").join(codex, F.col("canonical_ins") == F.col("c_ins"), "left")
    name = F.coalesce("e_name", F.concat("c_name", F.lit(" (INS "), "canonical_ins", F.lit(")")), F.concat(F.lit("item "), F.col("item_id").cast("string")))
    return rows.select("label_id", "item_id", name.alias("display"))


@query("jn17_review_queue", ("resolved", "declared"), "SELECT r.label_id, r.item_id, r.canonical_ins, d.name_as_declared FROM resolved r JOIN declared d ON r.label_id = d.label_id AND r.item_id = d.item_id WHERE r.classification = 'unknown'")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "resolved").where("classification = 'unknown'").select("label_id", "item_id", "canonical_ins")
    return rows.join(load(spark, sf_dir, "declared").select("label_id", "item_id", "name_as_declared"), ["label_id", "item_id"])


@query("jn21_alias_check", ("substances",), """WITH a AS (SELECT class_a AS alias, arg_max(ins, row_ord) AS ins, arg_max(name, row_ord) AS expected FROM substances WHERE row_ord % 3 = 0 GROUP BY 1),
    k AS (SELECT ins, arg_max(name, row_ord) AS name FROM substances WHERE row_ord % 4 <> 0 GROUP BY 1)
    SELECT alias, a.ins, CASE WHEN k.ins IS NULL THEN 'NOT FOUND' WHEN k.name = expected THEN 'PASS' ELSE 'MISMATCH' END AS outcome FROM a LEFT JOIN k ON a.ins = k.ins""")
def alias_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _substances(spark, sf_dir)
    a = s.where("row_ord % 3 = 0").groupBy(F.col("class_a").alias("alias")).agg(F.max_by("ins", "row_ord").alias("ins"), F.max_by("name", "row_ord").alias("expected"))
    k = R.registry(s.where("row_ord % 4 <> 0")).select("ins", "name")
    return a.join(k, "ins", "left").select("alias", "ins", F.when(F.col("name").isNull(), "NOT FOUND").when(F.col("name") == F.col("expected"), "PASS").otherwise("MISMATCH").alias("outcome"))
