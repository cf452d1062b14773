"""Queries of category retrieval and its diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import tfidf as X
from .registry import load, query

_SCORES = """scores AS (
    SELECT p.vec_id AS query_id, c.vec_id AS doc_ord, list_cosine_similarity(p.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score, p.label AS q_label, c.label AS c_label
    FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) p, embeddings c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_ord) AS rank FROM scores)"""


def _top(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return R.similarity_top_k(load(spark, sf_dir, "probes"), load(spark, sf_dir, "corpus").select("doc_ord", "embedding"), k)


@query("tk2_top_k", (), f"WITH {_SCORES} SELECT query_id, doc_ord, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, 10).select("query_id", "doc_ord", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("tk1_similarity_scores", (), f"WITH {_SCORES} SELECT query_id, doc_ord, round(score, 6) AS score FROM scores")
def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.similarity_scores(load(spark, sf_dir, "probes"), load(spark, sf_dir, "corpus"), places=6)


@query("scl10_cosine", (), "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(R.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


_FUSED = f"""WITH {_SCORES}, one AS (SELECT query_id, doc_ord, rank FROM ranked WHERE rank <= 10),
    two AS (SELECT query_id, doc_ord, row_number() OVER (PARTITION BY query_id ORDER BY doc_ord DESC) AS rank FROM one),
    fused AS (SELECT query_id, doc_ord, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY 1, 2)"""


@query("tk3_rank_fusion", (), _FUSED + " SELECT query_id, doc_ord, round(score, 9) AS score FROM fused")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    one = _top(spark, sf_dir, 10).select("query_id", "doc_ord", "rank")
    two = one.select("query_id", "doc_ord", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("doc_ord"))).alias("rank"))
    return R.reciprocal_rank_fusion(one.unionByName(two)).select("query_id", "doc_ord", F.round("score", 9).alias("score"))


@query("tk4_mmr_pure_similarity", (), f"WITH {_SCORES} SELECT query_id, rank AS pick, doc_ord FROM ranked WHERE rank <= 10")
def mmr_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = load(spark, sf_dir, "corpus")
    return R.mmr(_top(spark, sf_dir, 20).drop("rank"), corpus, 1.0).select("query_id", F.col("pick").cast("long").alias("pick"), "doc_ord")


@query("tk4_mmr_diverse", ())
def mmr_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mmr(_top(spark, sf_dir, 20).drop("rank"), load(spark, sf_dir, "corpus"), 0.5)


_CLASSIFIED = f"""WITH {_SCORES}, placed AS (
    SELECT query_id, doc_ord, c_label % 2 = q_label % 2 AS permitted, row_number() OVER (PARTITION BY query_id ORDER BY (c_label % 2 = q_label % 2)::int DESC, round(score, 12) DESC, doc_ord) AS place
    FROM ranked WHERE rank <= 10)"""


@query("tk5_classify", (), _CLASSIFIED + " SELECT query_id, doc_ord, permitted, place, CASE WHEN place <= 3 THEN NULL WHEN NOT permitted THEN 'not_permitted' ELSE 'ranked_below_top3' END AS reason FROM placed")
def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _top(spark, sf_dir, 10).select("query_id", "doc_ord", "score")
    q = load(spark, sf_dir, "probes").select("query_id", F.col("label").alias("q_label"))
    c = load(spark, sf_dir, "corpus").select("doc_ord", F.col("label").alias("c_label"))
    permitted = top.join(q, "query_id").join(c, "doc_ord").where("c_label % 2 = q_label % 2")
    return R.classify(top, permitted).select("query_id", "doc_ord", "permitted", F.col("place").cast("long").alias("place"), "reason")


_WEIGHTS = r"""t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS token FROM documents),
    tf AS (SELECT doc_id, token, count(*) AS tf FROM t GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents),
    idf AS (SELECT token, ln((1.0 + n) / (1.0 + count(*))) + 1.0 AS idf FROM tf, n GROUP BY token, n),
    w AS (SELECT doc_id, token, tf * idf AS w FROM tf JOIN idf USING (token)), s AS (SELECT doc_id, sqrt(sum(w * w)) AS s FROM w GROUP BY 1),
    weighed AS (SELECT doc_id, token, w / s AS weight FROM w JOIN s USING (doc_id))"""


@query("tk6_tfidf", (), f"WITH {_WEIGHTS} SELECT doc_id, token, round(weight, 6) AS weight FROM weighed")
def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = X.build(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return X.weights(index).select("doc_id", "token", F.round("weight", 6).alias("weight"))


@query(
    "tk6_scores",
    (),
    rf"""WITH {_WEIGHTS}, a AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS token FROM benchmark),
    q AS (SELECT query_id, token, count(*) * any_value(idf) AS w FROM a JOIN idf USING (token) GROUP BY 1, 2), l AS (SELECT query_id, sqrt(sum(w * w)) AS l FROM q GROUP BY 1),
    scored AS (SELECT query_id, doc_id AS doc_ord, round(sum(weight * w / l), 9) AS score FROM q JOIN l USING (query_id) JOIN weighed USING (token) GROUP BY 1, 2)
    SELECT query_id, doc_ord, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_ord) AS rank FROM scored) WHERE rank <= 10""",
)
def tfidf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the ten documents most like each benchmark item."""
    index = X.build(load(spark, sf_dir, "documents").select("doc_id", "text"))
    found = X.best(index, load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 10)
    return found.select("query_id", "doc_ord", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("tk6_mean_pairwise", (), f"WITH {_WEIGHTS}, u AS (SELECT token, sum(weight) AS s FROM weighed GROUP BY 1), m AS (SELECT count(DISTINCT doc_id) AS m FROM weighed) SELECT n, round(((SELECT sum(s * s) FROM u) - m) / (n * (n - 1.0)), 6) AS mean_similarity FROM n, m")
def tfidf_mean_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = X.build(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return X.mean_pairwise(index).select("n", F.round("mean_similarity", 6).alias("mean_similarity"))


_TRUTH = f"WITH {_SCORES}, hit AS (SELECT query_id, q_label, min(rank) FILTER (WHERE c_label = q_label AND rank <= 3) AS rank FROM ranked GROUP BY 1, 2)"


@query("ag17_recall_mrr", (), _TRUTH + " SELECT q_label, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_3, round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr, count(*) AS n FROM hit GROUP BY q_label")
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = load(spark, sf_dir, "probes").select("query_id", F.col("label").alias("q_label"))
    c = load(spark, sf_dir, "corpus").select("doc_ord", F.col("label").alias("c_label"))
    hits = _top(spark, sf_dir, 3).join(c, "doc_ord").join(q, "query_id").where("c_label = q_label").groupBy("query_id").agg(F.min("rank").alias("rank"))
    out = R.recall_and_mrr(q.join(hits, "query_id", "left"), ["q_label"])
    return out.select("q_label", F.round("recall_at_1", 6).alias("recall_at_1"), F.round("recall_at_3", 6).alias("recall_at_3"), F.round("mrr", 6).alias("mrr"), "n")


@query(
    "ag20_mean_pairwise_similarity",
    (),
    """WITH v AS (SELECT label, embedding::DOUBLE[] AS e FROM embeddings), u AS (
        SELECT label, i, sum(x / n) AS s, count(*) AS n FROM (
            SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i, sqrt(list_inner_product(e, e)) AS n FROM v) GROUP BY 1, 2)
    SELECT label, n, round((sum(s * s) - n) / (n * (n - 1)), 6) AS mean_similarity FROM u GROUP BY label, n HAVING n > 1""",
)
def mean_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over all pairs from the sum of unit vectors: (|sum|^2 - n) / (n (n - 1)), without any pair."""
    v = load(spark, sf_dir, "embeddings").select("label", R.l2_normalised(F.col("embedding")).alias("u")).select("label", F.posexplode("u").alias("i", "x"))
    s = v.groupBy("label", "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    out = s.groupBy("label", "n").agg(F.sum(F.col("s") * F.col("s")).alias("q")).where("n > 1")
    return out.select("label", "n", F.round((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("mean_similarity"))


@query("ag21_length_report", (), "SELECT lang, count(*) AS n, min(n_chars) AS shortest, quantile_cont(n_chars, 0.5) AS median, max(n_chars) AS longest FROM documents GROUP BY lang")
def length_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").groupBy("lang")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("shortest"), F.percentile("n_chars", F.lit(0.5)).alias("median"), F.max("n_chars").alias("longest"))


@query("ag22_rank_gap", (), f"WITH {_SCORES} SELECT query_id, round(max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 10 THEN score END), 6) AS gap FROM ranked WHERE rank <= 10 GROUP BY query_id")
def rank_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _top(spark, sf_dir, 10)
    gap = F.max(F.when(F.col("rank") == 1, F.col("score"))) - F.max(F.when(F.col("rank") == 10, F.col("score")))
    return top.groupBy("query_id").agg(F.round(gap, 6).alias("gap"))


@query("tk9_prefilter_pool", (), """SELECT p.vec_id AS query_id, count(*) AS pool FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) p
    JOIN embeddings c ON p.label = c.label GROUP BY 1""")
def prefilter_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = load(spark, sf_dir, "corpus").groupBy("label").agg(F.count(F.lit(1)).alias("pool"))
    return load(spark, sf_dir, "probes").join(sizes, "label").select("query_id", "pool")


@query("ag11_enriched_clause", (), """WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, lower(p_type)) AS k FROM c)
    SELECT p_brand AS category, string_agg(p_type, ', ' ORDER BY k) AS clause FROM r WHERE k <= 3 GROUP BY 1""")
def enriched_clause(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = load(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.lower("p_type").alias("l"), "p_type"))), 1, 3)
    return counts.groupBy(F.col("p_brand").alias("category")).agg(F.array_join(F.transform(top, lambda x: x["p_type"]), ", ").alias("clause"))
