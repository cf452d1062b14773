"""Queries of the advisory lanes, evaluation, set operations and stateful analogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import advisory as A
from ..operators import evals as E
from .registry import load, query
from .resolution_queries import _PARENT, _substances
from .verdict_queries import CLEAN, DEDUP, SELECTED, _permits, lineage_sql

_CLASSES = rf"""reg AS (SELECT ins AS code, arg_max(CASE WHEN class_b = '' THEN [] ELSE [class_a, class_b] END, row_ord) AS own FROM substances GROUP BY ins),
below AS (SELECT {_PARENT.format(c="code")} AS parent, list_sort(list_distinct(flatten(list(own)))) AS below FROM reg WHERE len(own) > 0 GROUP BY 1),
near AS (SELECT * FROM (SELECT s.id, r.own, b.below, row_number() OVER (PARTITION BY s.id ORDER BY s.step) AS k FROM steps s JOIN reg r ON s.code = r.code LEFT JOIN below b ON b.parent = r.code) WHERE k = 1),
classes AS (SELECT id, CASE WHEN len(own) = 0 THEN coalesce(below, []) ELSE own END AS classes, len(own) = 0 AND below IS NOT NULL AS inherited FROM near)"""


@query("jn10_functional_classes", ("items", "substances"), f"WITH {lineage_sql('steps', 'items', 'canonical_id')}, {_CLASSES} SELECT id AS canonical_id, array_to_string(classes, ',') AS classes, inherited FROM classes")
def functional_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.functional_classes(load(spark, sf_dir, "items"), "canonical_id", _substances(spark, sf_dir))
    return rows.select("canonical_id", F.array_join("classes", ",").alias("classes"), "inherited")


_BLOCKED = "SELECT DISTINCT canonical_id AS blocked_id, CASE WHEN item_id % 3 = 0 THEN 200.0 END AS blocked_level, concat(CAST(1 + label_id % 18 AS string), '') AS fcs_code FROM items"


@query(
    "jn12_substitutes",
    ("items", "permits", "substances"),
    "WITH " + ", ".join([CLEAN.format(table="permits"), DEDUP, SELECTED]) + f""", pairs AS ({_BLOCKED}),
    cand AS (SELECT code AS candidate_id, fcs_code, level FROM selected WHERE code NOT IN (SELECT canonical_id FROM clean WHERE status = 'prohibited')),
    ids AS (SELECT DISTINCT blocked_id AS x FROM pairs UNION SELECT DISTINCT candidate_id FROM cand), {lineage_sql('steps', 'ids', 'x')}, {_CLASSES},
    met AS (
        SELECT p.blocked_id, p.fcs_code, p.blocked_level, c.candidate_id, c.level, len(list_intersect(a.classes, b.classes)) AS n_shared
        FROM pairs p JOIN cand c ON p.fcs_code = c.fcs_code AND p.blocked_id <> c.candidate_id JOIN classes a ON a.id = p.blocked_id JOIN classes b ON b.id = c.candidate_id
        WHERE (blocked_level IS NULL OR level IS NULL OR level >= blocked_level)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY blocked_id, fcs_code, blocked_level ORDER BY n_shared DESC, coalesce(level, 1e308) DESC, candidate_id) AS place FROM met WHERE n_shared > 0)
    SELECT blocked_id, fcs_code, blocked_level, candidate_id, level, n_shared, place FROM placed WHERE place <= 5""",
)
def substitutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat((1 + F.col("label_id") % 18).cast("string"), F.lit(""))
    blocked = load(spark, sf_dir, "items").select(F.col("canonical_id").alias("blocked_id"), F.when(F.col("item_id") % 3 == 0, 200.0).alias("blocked_level"), code.alias("fcs_code"))
    rows = A.substitutes(blocked, _permits(spark, sf_dir), _substances(spark, sf_dir))
    return rows.select("blocked_id", "fcs_code", "blocked_level", "candidate_id", "level", "n_shared", F.col("place").cast("long").alias("place"))


@query(
    "jn13_horizon",
    ("signals",),
    """WITH i AS (SELECT c_custkey AS key, CAST(c_custkey * 2 AS string) AS canonical_id, concat('user ', CAST(c_custkey AS string)) AS name FROM customer),
    s AS (SELECT substance_id AS canonical_id, concat('User ', substance_id) AS substance_name, event_id, signal_year FROM signals),
    m AS (SELECT key, event_id, signal_year, 'id' AS matched_by FROM i JOIN s USING (canonical_id)
          UNION ALL SELECT key, event_id, signal_year, 'name' FROM i JOIN s ON lower(i.name) = lower(substance_name) WHERE i.canonical_id NOT IN (SELECT canonical_id FROM s))
    SELECT key, event_id, matched_by, CASE WHEN signal_year IS NULL THEN 'no_year' WHEN 2026 - signal_year > 5 THEN 'too_old' END AS excluded FROM m""",
)
def horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") * 2).cast("string").alias("canonical_id"), F.concat(F.lit("user "), F.col("c_custkey").cast("string")).alias("name"))
    signals = load(spark, sf_dir, "signals").select(F.col("substance_id").alias("canonical_id"), F.concat(F.lit("User "), "substance_id").alias("substance_name"), "event_id", "signal_year")
    return A.horizon(items, signals, 2026).select("key", F.col("signal.event_id").alias("event_id"), "matched_by", "excluded")


@query("tv8_recency", ("signals",), "SELECT substance_id, count(*) FILTER (WHERE 2026 - signal_year <= 5) AS kept, count(*) FILTER (WHERE 2026 - signal_year > 5) AS excluded FROM signals GROUP BY 1")
def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = (2026 - F.col("signal_year")) > 5
    return load(spark, sf_dir, "signals").groupBy("substance_id").agg(F.count_if(~old).alias("kept"), F.count_if(old).alias("excluded"))


@query("tk12_news_order", (), """WITH g AS (SELECT user_id, event_type, event_id, ts, min(event_id) OVER (PARTITION BY user_id, event_type) AS first FROM events)
    SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY first, ts DESC, event_id) AS place FROM g""")
def news_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").withColumn("first", F.min("event_id").over(Window.partitionBy("user_id", "event_type")))
    w = Window.partitionBy("user_id").orderBy("first", F.col("ts").desc_nulls_last(), "event_id")
    return rows.select("event_id", F.row_number().over(w).cast("long").alias("place"))


@query("tk13_caps", (), """SELECT run, key, ord FROM (SELECT *, dense_rank() OVER (PARTITION BY run ORDER BY key) AS a, row_number() OVER (PARTITION BY run, key ORDER BY ord) AS b
    FROM (SELECT event_type AS run, user_id AS key, event_id AS ord FROM events)) WHERE a <= 12 AND b <= 3""")
def caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.col("user_id").alias("key"), F.col("event_id").alias("ord"))
    return A.capped(rows).select("run", "key", "ord")


@query("tk16_primary_candidate", ("labels_top3",), "SELECT label_id, arg_min(fcs_code, CASE WHEN rank = 1 + label_id % 3 AND label_id % 2 = 0 THEN rank - 100 ELSE rank END) AS fcs_code FROM labels_top3 GROUP BY label_id")
def primary_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    confirmed = (F.col("rank") == 1 + F.col("label_id") % 3) & (F.col("label_id") % 2 == 0)
    return load(spark, sf_dir, "labels_top3").groupBy("label_id").agg(F.min_by("fcs_code", F.struct((~confirmed).cast("int"), "rank")).alias("fcs_code"))


@query("jn19_candidate_union", ("labels_top3",), """WITH u AS (SELECT label_id, fcs_code, rank FROM labels_top3 WHERE rank <= 2 UNION ALL SELECT label_id, fcs_code, rank + 10 FROM labels_top3 WHERE rank >= 2)
    SELECT label_id, fcs_code, min(rank) AS rank FROM u GROUP BY 1, 2""")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "labels_top3")
    both = rows.where("rank <= 2").unionByName(rows.where("rank >= 2").withColumn("rank", F.col("rank") + 10))
    return both.groupBy("label_id", "fcs_code").agg(F.min("rank").alias("rank"))


@query("jn20_backfill", (), """SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END, ''), s_name) AS name FROM part LEFT JOIN supplier ON p_partkey = s_suppkey""")
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").join(load(spark, sf_dir, "supplier"), F.col("p_partkey") == F.col("s_suppkey"), "left")
    own = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name"))
    return rows.select("p_partkey", F.coalesce(F.nullif(own, F.lit("")), "s_name").alias("name"))


_SIDES = "g AS (SELECT label_id, canonical_id AS code FROM items), f AS (SELECT label_id, CASE WHEN item_id % 4 = 0 THEN 'x' ELSE canonical_id END AS code FROM items WHERE item_id % 6 <> 0)"


@query(
    "ag15_multiset_recall",
    ("items",),
    f"""WITH {_SIDES}, a AS (SELECT label_id, code, count(*) AS g FROM g GROUP BY 1, 2), b AS (SELECT label_id, code, count(*) AS f FROM f GROUP BY 1, 2),
    j AS (SELECT coalesce(a.label_id, b.label_id) AS label_id, coalesce(g, 0) AS g, coalesce(f, 0) AS f FROM a FULL OUTER JOIN b ON a.label_id = b.label_id AND a.code = b.code),
    s AS (SELECT label_id, sum(g)::BIGINT AS n_golden, sum(f)::BIGINT AS n_found, sum(least(g, f))::BIGINT AS n_common FROM j GROUP BY 1)
    SELECT *, CASE WHEN n_golden > 0 THEN n_common / n_golden ELSE 1.0 END AS recall, CASE WHEN n_found > 0 THEN n_common / n_found ELSE 1.0 END AS precision FROM s""",
)
def multiset_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "items")
    found = items.where("item_id % 6 <> 0").select("label_id", F.when(F.col("item_id") % 4 == 0, "x").otherwise(F.col("canonical_id")).alias("code"))
    return E.multiset_scores(items.select("label_id", F.col("canonical_id").alias("code")), found, "label_id", "code")


@query(
    "ag16_structure_accuracy",
    ("items",),
    """WITH g AS (SELECT label_id, canonical_id, parent_item_id AS p, row_number() OVER (PARTITION BY label_id, canonical_id ORDER BY item_id) AS k FROM items),
    f AS (SELECT label_id, canonical_id, CASE WHEN item_id % 5 = 0 THEN NULL ELSE parent_item_id END AS p, row_number() OVER (PARTITION BY label_id, canonical_id ORDER BY item_id) AS k FROM items WHERE item_id % 7 <> 0)
    SELECT label_id, count(*) AS n_pairs, count(*) FILTER (WHERE g.p IS NOT DISTINCT FROM f.p) AS n_agree FROM g JOIN f USING (label_id, canonical_id, k) GROUP BY 1""",
)
def structure_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "items")
    found = items.where("item_id % 7 <> 0").withColumn("parent_item_id", F.when(F.col("item_id") % 5 != 0, F.col("parent_item_id")))
    return E.structure_accuracy(items, found, "label_id", "canonical_id", "item_id", ["parent_item_id"])


@query(
    "jn16_model_comparison",
    ("items",),
    """WITH a AS (SELECT label_id, item_id, canonical_id AS v FROM items WHERE item_id % 5 <> 0), b AS (SELECT label_id, item_id, CASE WHEN item_id % 4 = 0 THEN 'x' ELSE canonical_id END AS v FROM items WHERE item_id % 6 <> 0)
    SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN b.label_id IS NULL THEN 'only_a' WHEN a.label_id IS NULL THEN 'only_b' WHEN a.v = b.v THEN 'agree' ELSE 'disagree' END AS outcome
    FROM a FULL OUTER JOIN b ON a.label_id = b.label_id AND a.item_id = b.item_id) GROUP BY 1""",
)
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "items").select("label_id", "item_id", F.col("canonical_id").alias("v"))
    b = items.where("item_id % 6 <> 0").withColumn("v", F.when(F.col("item_id") % 4 == 0, "x").otherwise(F.col("v")))
    return E.compare_sides(items.where("item_id % 5 <> 0"), b, ["label_id", "item_id"], "v").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("jn15_golden_join", (), "SELECT d.doc_id, l.quality IS NOT DISTINCT FROM (CASE WHEN d.n_chars > 300 THEN 1 ELSE 0 END) AS matches FROM documents d LEFT JOIN labels l USING (doc_id)")
def golden_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents").select("doc_id", "n_chars"), load(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.col("quality").eqNullSafe(F.when(F.col("n_chars") > 300, 1).otherwise(0)).alias("matches"))


@query("ag18_agent_confusion", (), """SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN l.quality IS NULL THEN 'unscored' WHEN d.doc_id % 3 = 0 THEN CASE WHEN l.quality = 0 THEN 'correctly_declined' ELSE 'wrongly_declined' END
    WHEN l.quality <> 0 AND d.lang = 'en' THEN 'correct' ELSE 'wrong' END AS outcome FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1""")
def agent_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents").select("doc_id", "lang"), load(spark, sf_dir, "labels").select("doc_id", "quality")
    outcome = E.confusion(F.col("lang"), F.lit("en"), F.col("doc_id") % 3 == 0, F.col("quality") == 0)
    return docs.join(labels, "doc_id", "left").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("ag19_regression", (), """WITH d AS (SELECT event_type, CAST(ts AS date) AS day, round(avg(value), 6) AS metric FROM events GROUP BY 1, 2)
    SELECT event_type, day, metric, round(metric - lag(metric) OVER (PARTITION BY event_type ORDER BY day), 6) AS change FROM d""")
def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = load(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("metric"))
    return E.regressions(runs, ["event_type"], "day", "metric").withColumn("change", F.round("change", 6))


@query("ag26_group_conditions", ("permits",), "SELECT fcs, coalesce(conditions, concat('none ', row_ord)) AS grp, count(*) AS n FROM (SELECT coalesce(food_category_raw, '') AS fcs, conditions, row_ord FROM permits) GROUP BY 1, 2")
def group_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    grp = F.coalesce("conditions", F.concat(F.lit("none "), "row_ord"))
    return load(spark, sf_dir, "permits").groupBy(F.coalesce("food_category_raw", F.lit("")).alias("fcs"), grp.alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query("ag23_quality_report", ("permits",), """SELECT count(*) AS n, count(DISTINCT canonical_id) AS n_ids, count(*) FILTER (WHERE food_category_raw IS NULL) AS n_no_category, count(*) FILTER (WHERE conditions IS NOT NULL) AS n_conditions,
    count(*) FILTER (WHERE source_url IS NULL) AS n_uncitable, count(*) FILTER (WHERE max_level_mg_kg <= 0) AS n_bad_level, count(*) FILTER (WHERE status NOT IN ('permitted', 'prohibited')) AS n_bad_status FROM permits""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "permits").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("canonical_id").alias("n_ids"), F.count_if(F.col("food_category_raw").isNull()).alias("n_no_category"),
        F.count_if(F.col("conditions").isNotNull()).alias("n_conditions"), F.count_if(F.col("source_url").isNull()).alias("n_uncitable"),
        F.count_if(F.col("max_level_mg_kg") <= 0).alias("n_bad_level"), F.count_if(~F.col("status").isin("permitted", "prohibited")).alias("n_bad_status"),
    )


@query("src17_cross_check", (), """WITH a AS (SELECT p_brand AS ins, min(p_name) AS name, count(*) AS n FROM part WHERE p_size % 2 = 0 GROUP BY 1), b AS (SELECT p_brand AS ins, min(p_name) AS name, count(*) AS n FROM part WHERE p_size % 3 = 0 GROUP BY 1)
    SELECT coalesce(a.ins, b.ins) AS ins, a.ins IS NULL AS only_b, b.ins IS NULL AS only_a, coalesce(a.n, 0) > 1 AS duplicate_a, a.name <> b.name AS name_mismatch FROM a FULL OUTER JOIN b ON a.ins = b.ins""")
def cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    side = lambda cond, n: part.where(cond).groupBy(F.col("p_brand").alias("ins")).agg(F.min("p_name").alias(f"name_{n}"), F.count(F.lit(1)).alias(f"n_{n}"))
    both = side("p_size % 2 = 0", "a").join(side("p_size % 3 = 0", "b"), "ins", "full_outer")
    return both.select("ins", F.col("n_a").isNull().alias("only_b"), F.col("n_b").isNull().alias("only_a"), (F.coalesce("n_a", F.lit(0)) > 1).alias("duplicate_a"), (F.col("name_a") != F.col("name_b")).alias("name_mismatch"))


@query("set3_difference", (), "SELECT DISTINCT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90")
def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.where("event_type = 'click'").select("user_id").subtract(e.where("event_type = 'purchase' and value > 90").select("user_id"))


@query("set4_multiset", (), "SELECT c_nationkey FROM customer WHERE c_acctbal > 0 EXCEPT ALL SELECT s_nationkey FROM supplier")
def multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_nationkey").exceptAll(load(spark, sf_dir, "supplier").select("s_nationkey"))


@query("set5_right_biased_union", (), """SELECT k, v FROM (SELECT c_mktsegment AS k, max(c_acctbal) AS v FROM customer GROUP BY 1 UNION ALL SELECT 'EXTRA', 1.0)""")
def right_biased(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = load(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.max("c_acctbal").alias("v"))
    left = F.map_from_entries(F.collect_list(F.struct("c_mktsegment", F.lit(-1.0).alias("w"))))
    right = F.map_concat(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "v"))), F.create_map(F.lit("EXTRA"), F.lit(1.0)))
    return best.agg(E.merged_maps(left, right).alias("m")).select(F.explode("m").alias("k", "v"))


@query("set6_union_all", (), "SELECT kind, count(*) AS n FROM (SELECT 'own' AS kind FROM part UNION ALL SELECT 'inherited' FROM supplier) GROUP BY 1")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, more = load(spark, sf_dir, "part").select(F.lit("own").alias("kind")), load(spark, sf_dir, "supplier").select(F.lit("inherited").alias("kind"))
    return own.unionByName(more).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "st1_ttl_cache",
    (),
    """WITH c AS (SELECT user_id AS key, max(ts) AS fetched_at, arg_max(event_type, ts) AS value FROM events WHERE event_id % 3 <> 0 GROUP BY 1), d AS (SELECT max(CAST(ts AS date)) AS today FROM events),
    f AS (SELECT user_id AS key, 'new' AS value FROM events WHERE user_id % 2 = 0 GROUP BY 1), w AS (SELECT DISTINCT c_custkey AS key FROM customer)
    SELECT w.key, CASE WHEN date_diff('day', CAST(c.fetched_at AS date), DATE '2024-01-31') <= 7 THEN 'fresh' WHEN f.key IS NOT NULL THEN 'fetched' WHEN c.key IS NOT NULL THEN 'stale_cache_served' ELSE 'missing' END AS state
    FROM w LEFT JOIN c ON w.key = c.key LEFT JOIN f ON w.key = f.key""",
)
def ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    cache = events.where("event_id % 3 <> 0").select(F.col("user_id").alias("key"), F.col("ts").alias("fetched_at"), F.col("event_type").alias("value"))
    fetched = events.where("user_id % 2 = 0").select(F.col("user_id").alias("key"), F.lit("new").alias("value")).distinct()
    wanted = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return A.cached_fetch(wanted, cache, fetched, "2024-01-31").select("key", "state")


@query("st2_resume", (), "SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 95) GROUP BY 1")
def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    done = events.where("event_type = 'purchase' and value > 95").select("user_id").distinct()
    return events.join(done, "user_id", "left_anti").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("st6_event_windows", (), "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import windowed_counts

    return windowed_counts(load(spark, sf_dir, "events"), "1 hour").select("event_type", F.col("start").alias("hour"), "n")


@query("snk7_content_cache", (), "SELECT sha256(concat(lang, '|', source)) AS key, count(*) AS n FROM documents GROUP BY 1")
def content_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.sha2(F.concat_ws("|", "lang", "source").cast("binary"), 256)
    return load(spark, sf_dir, "documents").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
