"""Category retrieval: permitted categories, similarity ranking, fusion, diversification and classification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import small, written

_SCORED = "query_id long, doc_ord long, score double"
#: Bits of a pair's place among those sorted at once; pairs of a task, below that as rows are not dealt quite evenly; rows handed on at once.
_PLACE_BITS, _TASK_PAIRS, _ROWS_OUT = 24, 12 << 20, 1 << 18
#: From so many pairs on for each pair of different vectors, copies are put together in strips of so many rows.
_COPIES, _STRIP = 4, 512


def permitted_pairs(permits: DataFrame) -> DataFrame:
    return permits.where("status = 'permitted' and fcs_code <> ''").select("canonical_id", "fcs_code").distinct()


def breadth(permits: DataFrame) -> DataFrame:
    """Number of categories that permit each substance."""
    return permitted_pairs(permits).groupBy("canonical_id").agg(F.count(F.lit(1)).alias("breadth"))


def permitted_in(queries: DataFrame, permits: DataFrame) -> DataFrame:
    """Relational division: the categories that permit every considered substance of a query.

    queries: query_id, canonical_id. Substances permitted nowhere are left out of the division, not failed by it.
    A category is a bit of a word of up to 63; a query keeps the bits that all its substances have, so rows are per
    substance and word, not per substance and category. Categories are numbered within lots of some 40.
    """
    pairs = written(permitted_pairs(permits), "permitted")
    lots = 1 + pairs.select(F.count_distinct("fcs_code")).first()[0] // 40
    codes = pairs.select("fcs_code").distinct().withColumn("lot", F.pmod(F.xxhash64("fcs_code"), F.lit(lots)))
    codes = codes.withColumn("at", F.row_number().over(Window.partitionBy("lot").orderBy("fcs_code")) - 1)
    codes = written(codes.select("fcs_code", "lot", F.floor(F.col("at") / 63).alias("part"), (F.col("at") % 63).alias("bit")), "codes")
    words = pairs.join(codes, "fcs_code").groupBy("canonical_id", "lot", "part").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    words = small(words.groupBy("canonical_id").agg(F.collect_list(F.struct("lot", "part", "mask")).alias("words")), "words")
    names = small(codes.groupBy("lot", "part").agg(F.collect_list(F.struct("bit", "fcs_code")).alias("names")), "names")
    own = queries.select("query_id", "canonical_id").where("query_id is not null").distinct().join(words, "canonical_id")
    own = own.withColumn("need", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).select("query_id", "need", F.inline("words"))
    have = own.groupBy("query_id", "need", "lot", "part").agg(F.count(F.lit(1)).alias("have"), F.bit_and("mask").alias("mask")).where("have = need and mask <> 0")
    return have.join(names, ["lot", "part"]).select("query_id", F.explode(F.expr("filter(names, x -> shiftright(mask, x.bit) & 1 = 1)")).alias("x")).select("query_id", "x.fcs_code")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def l2_normalised(v: Column) -> Column:
    n = norm(v)
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def _unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1)
    return np.divide(vectors, size[:, None], out=np.zeros_like(vectors), where=size[:, None] > 0)


def _query_blocks(probes: DataFrame, blocks: int) -> Iterator[Broadcast]:
    """The queries in broadcasts of some count / blocks unit vectors, copies of a vector next to each other: (ids, vectors)."""
    probes = probes.select(F.col("query_id").cast("long").alias("query_id"), "embedding", F.xxhash64("embedding").alias("vector"))
    for b in range(blocks):
        if rows := sorted(probes.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect(), key=lambda r: (r.vector, r.query_id)):
            yield probes.sparkSession.sparkContext.broadcast((np.array([r.query_id for r in rows]), _unit(np.array([r.embedding for r in rows], dtype=np.float64))))


def _united(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _SCORED)


def _keys(q: np.ndarray, m: np.ndarray, places: int) -> np.ndarray:
    """For each pair of a query and a row its rounded score, negated, above its place in the q x m matrix: sorted, the best come first and NaN last.

    Scores are rounded to 12 places as everywhere, then to those asked for as decimals are, half away from zero.
    """
    key, unit = np.empty((len(q), len(m)), dtype=np.int64), 10.0 ** (12 - places)
    for at in range(0, len(q), 512):
        s = np.rint(q[at : at + 512] @ m.T * 1e12)
        s = -np.copysign(np.floor((np.abs(s) + unit / 2) / unit), s)
        key[at : at + 512] = np.where(np.isnan(s), 2.0 * 10**places, s).astype(np.int64) << _PLACE_BITS
    key = key.ravel()
    key |= np.arange(len(key))
    return key


def similarity_scores(probes: DataFrame, corpus: DataFrame, block_rows: int = 20_000, places: int = 6) -> DataFrame:
    """query_id, doc_ord, score: the cosine of every query with every corpus row, to so many decimals (11 at most). probes: query_id, embedding; corpus: doc_ord, embedding.

    The result has a row for each pair, so it grows with the product of both sides, and so does what a sink writes. A
    task has a few million pairs, whatever the sizes, and hands them on in the order that columnar files store best: by
    score, so that equal scores lie side by side and a task's ids are short codes; or, where most vectors are copies of
    others, by query in strips of rows, copies together, so that the same scores follow each other again and again.
    """
    if not 0 <= places <= 11:
        raise ValueError(f"0 to 11 places, not {places}")
    asked = probes.count()
    blocks = max(1, -(-asked // block_rows))
    tasks = 1 + corpus.count() * -(-asked // blocks) // _TASK_PAIRS
    corpus = corpus.select(F.col("doc_ord").cast("long").alias("doc_ord"), "embedding", F.xxhash64("embedding").alias("vector"))
    corpus = corpus.repartitionByRange(tasks, "vector", "doc_ord").sortWithinPartitions("vector", "doc_ord")

    def scored(shared: Broadcast) -> DataFrame:
        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            kinds = len(np.unique(q, axis=0))
            for pdf in batches:
                if not len(pdf):
                    continue
                docs, m = pdf["doc_ord"].to_numpy(), _unit(np.stack(pdf["embedding"].to_numpy()).astype(np.float64))
                copied = len(q) * len(m) >= _COPIES * kinds * pdf["vector"].nunique()
                wide = _STRIP if copied else 32 * _STRIP
                for strip in np.split(np.arange(len(m)), range(wide, len(m), wide)):
                    for part in np.array_split(np.arange(len(q)), -(-len(q) // ((1 << _PLACE_BITS) // len(strip)))):
                        key = _keys(q[part], m[strip], places)
                        if not copied:
                            key.sort()
                        for at in range(0, len(key), _ROWS_OUT):
                            k = -(key[at : at + _ROWS_OUT] >> _PLACE_BITS)
                            row, col = np.divmod(key[at : at + _ROWS_OUT] & (1 << _PLACE_BITS) - 1, len(strip))
                            yield pd.DataFrame({"query_id": ids[part[row]], "doc_ord": docs[strip[col]], "score": np.where(k < -(10**places), np.nan, k / 10**places)})

        return corpus.mapInPandas(score, _SCORED)

    return _united(probes.sparkSession, [scored(shared) for shared in _query_blocks(probes, blocks)])


def _best(probes: DataFrame, corpus: DataFrame, k: int, block_rows: int) -> DataFrame:
    """query_id, doc_ord, score of each task's k best for every query.

    The queries are the smaller side: they are collected in blocks of at most block_rows vectors, each broadcast and
    set against the corpus by matrix product where the corpus lies. Scores that differ only by rounding are ties.
    """
    corpus = corpus.select(F.col("doc_ord").cast("long").alias("doc_ord"), "embedding")

    def searched(shared: Broadcast) -> DataFrame:
        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * -(-len(q) // 512)
            for pdf in batches:
                if not len(pdf):
                    continue
                docs, m = pdf["doc_ord"].to_numpy(), _unit(np.stack(pdf["embedding"].to_numpy()).astype(np.float64))
                for at in range(len(best)):
                    s = np.round(q[512 * at : 512 * at + 512] @ m.T, 12)
                    d = np.broadcast_to(docs, s.shape)
                    if best[at] is not None:
                        s, d = np.concatenate([best[at][0], s], axis=1), np.concatenate([best[at][1], d], axis=1)
                    top = np.lexsort((d, -s), axis=1)[:, :k]
                    best[at] = np.take_along_axis(s, top, axis=1), np.take_along_axis(d, top, axis=1)
            for at, found in enumerate(best):
                if found is not None:
                    yield pd.DataFrame({"query_id": np.repeat(ids[512 * at : 512 * at + 512], found[0].shape[1]), "doc_ord": found[1].ravel(), "score": found[0].ravel()})

        return corpus.mapInPandas(search, _SCORED)

    blocks = max(1, -(-probes.count() // block_rows))
    return _united(probes.sparkSession, [searched(shared) for shared in _query_blocks(probes, blocks)])


def similarity_top_k(probes: DataFrame, corpus: DataFrame, k: int, block_rows: int = 20_000) -> DataFrame:
    """query_id, doc_ord, score, rank: the k most similar corpus rows of each query, ties by doc_ord.

    The corpus is never moved: each task keeps its k best for every query, and a window per query merges those.
    """
    return top_k(_best(probes, corpus, k, block_rows), k)


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """query_id, doc_ord, score -> the k best per query, ties by doc_ord."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_ord")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reciprocal_rank_fusion(rankings: DataFrame, k: int = 60) -> DataFrame:
    """query_id, doc_ord, rank of several rankings -> the sum of 1 / (k + rank)."""
    return rankings.groupBy("query_id", "doc_ord").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))


def mmr(scores: DataFrame, corpus: DataFrame, weight: float, pool: int = 20, select: int = 10) -> DataFrame:
    """Maximal marginal relevance per query: picks that trade similarity against likeness to earlier picks.

    scores: query_id, doc_ord, score. Ten sequential picks from a pool of 20, so one small group per query in pandas.
    Worth that differs only by rounding is a tie, which goes to the smaller doc_ord. Returns query_id, pick, doc_ord, score (the true similarity).
    """
    pooled = top_k(scores, pool).join(corpus.select("doc_ord", "embedding"), "doc_ord").select("query_id", "doc_ord", "score", "embedding")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_ord").reset_index(drop=True)
        v = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        size = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
        alike, score = v @ v.T, pdf["score"].to_numpy()
        left, chosen = list(range(len(pdf))), []
        while left and len(chosen) < select:
            worth = [weight * score[i] - (1 - weight) * (max(alike[i][j] for j in chosen) if chosen else 0.0) for i in left]
            chosen.append(left.pop(int(np.argmax(np.round(worth, 12)))))
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "pick": range(1, len(chosen) + 1), "doc_ord": pdf["doc_ord"].to_numpy()[chosen], "score": score[chosen]})

    return pooled.groupBy("query_id").applyInPandas(pick, "query_id long, pick int, doc_ord long, score double")


def classify(scores: DataFrame, permitted: DataFrame, retrieve: int = 10, keep: int = 3) -> DataFrame:
    """Retrieve ten, put permitted ones first, keep three; the others get the reason they were left out.

    permitted: query_id, doc_ord of the candidates permitted for the query.
    """
    top = top_k(scores, retrieve).drop("rank").join(permitted.select("query_id", "doc_ord", F.lit(True).alias("permitted")).distinct(), ["query_id", "doc_ord"], "left")
    top = top.withColumn("permitted", F.coalesce("permitted", F.lit(False)))
    w = Window.partitionBy("query_id").orderBy(F.col("permitted").cast("int").desc(), F.desc("score"), "doc_ord")
    placed = top.withColumn("place", F.row_number().over(w))
    reason = F.when(F.col("place") <= keep, F.lit(None)).when(~F.col("permitted"), "not_permitted").otherwise("ranked_below_top3")
    return placed.withColumn("reason", reason)


def recall_and_mrr(ranked: DataFrame, by: list[str], ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """ranked: the rank of the truth (null: not found) per case -> recall at each k and the mean reciprocal rank."""
    cols = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}") for k in ks]
    return ranked.groupBy(*by).agg(*cols, F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.count(F.lit(1)).alias("n"))
