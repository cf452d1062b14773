"""Further queries: class strings, guards, phrases, corpus checks, composed lanes and run states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import advisory as A
from ..operators import classes as C
from ..operators import resolution as R
from ..operators import retrieval as V
from ..operators import verdicts as J
from .advisory_queries import _CLASSES
from .registry import load, query
from .resolution_queries import _GUARDED, _PARENT, _substances
from .retrieval_queries import _SCORES, _top
from .verdict_queries import CLEAN, VERDICT_VIEWS, _permits, item_verdicts, lineage_sql, verdict_sql

_VOCABULARY = ("Flavour enhancer", "Sweetener", "Acidity regulator", "Emulsifier")


@query(
    "scl14_split_classes",
    (),
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Flavour enhancer|Sweetener' WHEN 1 THEN 'Emulsifier' WHEN 2 THEN 'Acidity regulator|Emulsifier' ELSE 'Mystery Sweetener' END AS classes FROM part""",
)
def split_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    raw = F.when(k == 0, "Flavour enhancer Sweetener").when(k == 1, "Emulsifier").when(k == 2, "Acidity regulator Emulsifier").otherwise("Mystery Sweetener")
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(C.split_classes(raw, _VOCABULARY), "|").alias("classes"))


@query("scl16_name_and_code", (), "SELECT p_partkey, p_name AS name, CAST(100 + p_partkey % 800 AS string) AS ins FROM part")
def name_and_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", F.lit(" ("), (100 + F.col("p_partkey") % 800).cast("string"), F.lit(")"))
    return load(spark, sf_dir, "part").select("p_partkey", *C.name_and_ins(text))


@query("scl19_role_mismatch", (), "SELECT p_partkey, p_size % 3 = 0 AS mismatch FROM part")
def role_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.array(F.when(F.col("p_size") % 3 == 0, "Humectant").otherwise("Emulsifier"))
    return load(spark, sf_dir, "part").select("p_partkey", C.role_class_mismatch(roles, F.array(F.lit("Emulsifier"), F.lit("Thickener"))).alias("mismatch"))


@query("scl21_family_guard", ("items",), f"SELECT canonical_id, count(*) AS n, canonical_id IN ({_GUARDED}) AS guarded FROM items GROUP BY 1")
def family_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "items").groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("guarded", R.needs_family_guard(F.col("canonical_id"), F.lit("alias")))


@query(
    "scl34_candidates_phrase",
    (),
    """SELECT p_brand, count(DISTINCT p_type) AS n, CASE WHEN count(DISTINCT p_type) < 4 THEN string_agg(DISTINCT p_type, ', ' ORDER BY p_type) ELSE count(DISTINCT p_type) || ' different substances' END AS phrase FROM part GROUP BY 1""",
)
def candidates_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = load(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("names"))
    return names.select("p_brand", F.size("names").cast("long").alias("n"), C.candidates_phrase(F.col("names"), 4).alias("phrase"))


_PERMITTED_CLASSES = f"""WITH {CLEAN.format(table='permits')}, perm AS (SELECT DISTINCT canonical_id, fcs_code FROM clean WHERE status = 'permitted' AND fcs_code <> ''),
    {lineage_sql('steps', 'perm', 'canonical_id')}, {_CLASSES}, c AS (SELECT p.fcs_code, unnest(x.classes) AS cls FROM perm p JOIN classes x ON x.id = p.canonical_id)"""


@query("ag9_classes_by_category", ("permits", "substances"), _PERMITTED_CLASSES + " SELECT fcs_code, string_agg(DISTINCT cls, ',' ORDER BY cls) AS classes FROM c GROUP BY 1")
def classes_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classes_by(V.permitted_pairs(_permits(spark, sf_dir)), "fcs_code", _substances(spark, sf_dir)).select("fcs_code", F.array_join("classes", ",").alias("classes"))


@query("ag10_query_classes", ("items", "substances"), f"WITH {lineage_sql('steps', 'items', 'canonical_id')}, {_CLASSES} SELECT label_id, string_agg(DISTINCT cls, ',' ORDER BY cls) AS classes FROM (SELECT label_id, unnest(classes) AS cls FROM items i JOIN classes c ON c.id = i.canonical_id) GROUP BY 1")
def query_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classes_by(load(spark, sf_dir, "items").select("label_id", "canonical_id"), "label_id", _substances(spark, sf_dir)).select("label_id", F.array_join("classes", ",").alias("classes"))


@query("jn11_blocked_classes", ("resolved", "substances"), f"""WITH ids AS (SELECT canonical_ins AS x FROM resolved UNION SELECT eu_canonical_id FROM resolved), {lineage_sql('steps', 'ids', 'x')}, {_CLASSES}
    SELECT label_id, item_id, array_to_string(coalesce(a.classes, b.classes), ',') AS classes FROM resolved r LEFT JOIN classes a ON a.id = r.canonical_ins LEFT JOIN classes b ON b.id = r.eu_canonical_id""")
def blocked_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sub = load(spark, sf_dir, "resolved"), _substances(spark, sf_dir)
    ids = rows.select(F.col("canonical_ins").alias("x")).union(rows.select("eu_canonical_id"))
    known = A.functional_classes(ids, "x", sub).select("x", "classes")
    a, b = known.select(F.col("x").alias("a_id"), F.col("classes").alias("a")), known.select(F.col("x").alias("b_id"), F.col("classes").alias("b"))
    rows = rows.join(a, F.col("canonical_ins") == F.col("a_id"), "left").join(b, F.col("eu_canonical_id") == F.col("b_id"), "left")
    return rows.select("label_id", "item_id", F.array_join(F.coalesce("a", "b"), ",").alias("classes"))


@query("jn22_family_members", ("substances",), r"SELECT regexp_extract(ins, '^\d+', 0) AS family, string_agg(DISTINCT ins, ',' ORDER BY ins) AS members FROM substances GROUP BY 1")
def family_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.regexp_extract("ins", r"^\d+", 0)
    return load(spark, sf_dir, "substances").groupBy(family.alias("family")).agg(F.array_join(F.array_sort(F.collect_set("ins")), ",").alias("members"))


@query(
    "tk8_hybrid_strategy",
    (),
    f"""WITH {_SCORES}, one AS (SELECT query_id, doc_ord, rank FROM ranked WHERE rank <= 10),
    two AS (SELECT query_id, doc_ord, row_number() OVER (PARTITION BY query_id ORDER BY (c_label = q_label)::int DESC, doc_ord) AS rank FROM ranked WHERE rank <= 10),
    fused AS (SELECT query_id, doc_ord, round(sum(1.0 / (60 + rank)), 12) AS score FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY 1, 2)
    SELECT query_id, doc_ord, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_ord) AS place FROM fused) WHERE place <= 3""",
)
def hybrid_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    q = load(spark, sf_dir, "probes").select("query_id", F.col("label").alias("q"))
    c = load(spark, sf_dir, "corpus").select("doc_ord", F.col("label").alias("c"))
    one = _top(spark, sf_dir, 10).select("query_id", "doc_ord", "rank")
    w = Window.partitionBy("query_id").orderBy((F.col("q") == F.col("c")).cast("int").desc(), "doc_ord")
    two = one.join(q, "query_id").join(c, "doc_ord").select("query_id", "doc_ord", F.row_number().over(w).alias("rank"))
    fused = V.reciprocal_rank_fusion(one.unionByName(two)).withColumn("score", F.round("score", 12))
    return V.top_k(fused, 3).select("query_id", "doc_ord", F.col("rank").cast("long").alias("place"))


@query("ag25_validate_corpus", ("permits",), r"""WITH d AS (SELECT row_ord, split_part(rtrim(split_part(food_category_raw, ' ', 1), '.'), '.', 1) AS own, CAST(1 + length(notes) AS string) AS cited FROM permits WHERE food_category_raw IS NOT NULL)
    SELECT own, count(*) FILTER (WHERE cited <> own) AS n_foreign FROM d GROUP BY 1""")
def validate_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.normalise import category_code

    rows = load(spark, sf_dir, "permits").where("food_category_raw is not null").select(category_code(F.col("food_category_raw")).alias("code"), F.concat(F.lit("see ("), (1 + F.length("notes")).cast("string"), F.lit(".2)")).alias("description"))
    return rows.groupBy(F.split_part("code", F.lit("."), F.lit(1)).alias("own")).agg(F.count_if(C.cites_only_foreign(F.col("code"), F.col("description"))).alias("n_foreign"))


@query("ag27_cache_counts", (), "SELECT count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS hits, count(*) FILTER (WHERE l.doc_id IS NULL) AS misses FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def cache_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = load(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("hit")).distinct()
    rows = load(spark, sf_dir, "documents").select("doc_id").join(held, "doc_id", "left")
    return rows.agg(F.count_if(F.col("hit").isNotNull()).alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))


@query("src7_horizon_scan", ("signals",), "SELECT stage, signal_year, count(*) AS n FROM signals GROUP BY 1, 2")
def horizon_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "signals").groupBy("stage", "signal_year").agg(F.count(F.lit(1)).alias("n"))


@query("tv10_evidence_worksheet", ("permits", "items"), "WITH " + CLEAN.format(table="permits") + f""", {lineage_sql('steps', 'items', 'canonical_id')}, n AS (SELECT canonical_id AS code, count(*) AS n FROM clean GROUP BY 1)
    SELECT s.id AS canonical_id, (row_number() OVER (PARTITION BY s.id ORDER BY s.step) - 1)::INT AS step, s.code, coalesce(n.n, 0) AS n_rows FROM steps s LEFT JOIN n ON n.code = s.code""")
def evidence_worksheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _permits(spark, sf_dir).groupBy(F.col("canonical_id").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    rows = J.with_lineage(load(spark, sf_dir, "items"), "canonical_id").join(counts, "code", "left")
    return rows.select("canonical_id", "step", "code", F.coalesce("n", F.lit(0)).alias("n_rows"))


@query("tv12_accept_proposal", ("declared", "substances"), f"""WITH known AS (SELECT DISTINCT ins FROM substances), p AS (SELECT label_id, item_id, CASE WHEN item_id % 6 = 0 THEN '330' ELSE regexp_replace(replace(lower(declared_code), ' ', ''), '^(ins|e)', '') END AS code FROM declared),
    c AS (SELECT *, {_PARENT.format(c="code")} AS wider FROM p WHERE code IS NOT NULL)
    SELECT label_id, item_id, coalesce(a.ins, b.ins) AS ins FROM c LEFT JOIN known a ON c.code = a.ins LEFT JOIN known b ON c.wider = b.ins""")
def accept_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "declared")
    accepted = items.where("item_id % 6 = 0").select("label_id", "item_id", F.lit("INS 330").alias("override"))
    items = items.join(accepted, ["label_id", "item_id"], "left").withColumn("declared_code", F.coalesce("override", "declared_code")).where("declared_code is not null")
    return R.resolve_by_code(items, _substances(spark, sf_dir)).select("label_id", "item_id", "ins")


@query("st3_incremental_review", (), "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn >= 4)")
def incremental_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn")
    return rows.join(rows.where("turn >= 4").select("conv_id").distinct(), "conv_id", "left_anti")


@query("st5_confirm_and_resume", VERDICT_VIEWS, verdict_sql("SELECT label_id % 2 = 0 AS confirmed, count(*) AS n FROM verdicts WHERE raw_flags LIKE 'category_unconfirmed%' GROUP BY 1"))
def confirm_and_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    sure = load(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("label_id"))
    rows = J.evaluate(load(spark, sf_dir, "resolved"), load(spark, sf_dir, "labels_top3"), _permits(spark, sf_dir), sure)
    flag = F.get("flags", F.lit(0))
    rows = rows.where(flag.isin("category_confirmed_by_user", "category_unconfirmed"))
    return rows.groupBy((flag == "category_confirmed_by_user").alias("confirmed")).agg(F.count(F.lit(1)).alias("n"))


@query("set1_intersection", (), "SELECT DISTINCT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.where("event_type = 'click'").select("user_id").intersect(e.where("event_type = 'purchase'").select("user_id"))


@query("set2_class_overlap", ("substances",), "SELECT row_ord, class_a IN ('ECONOMY', 'Brand#11', 'Brand#1', 'Brand#21') OR class_b IN ('ECONOMY', 'Brand#11', 'Brand#1', 'Brand#21') AS overlaps FROM substances")
def class_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(*map(F.lit, ["ECONOMY", "Brand#11", "Brand#1", "Brand#21"]))
    return load(spark, sf_dir, "substances").select("row_ord", F.arrays_overlap(F.array("class_a", "class_b"), wanted).alias("overlaps"))


@query("ext_rollup_verdicts", VERDICT_VIEWS, verdict_sql("SELECT headline, verdict_certainty, count(*) AS n FROM verdicts GROUP BY ROLLUP (headline, verdict_certainty)"))
def rollup_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: subtotals of verdict counts."""
    return item_verdicts(spark, sf_dir).rollup("headline", "verdict_certainty").agg(F.count(F.lit(1)).alias("n"))
