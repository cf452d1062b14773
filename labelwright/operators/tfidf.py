"""TF-IDF over an inverted index: weights, scores of queries, and the mean likeness of all pairs.

The index is a table of postings (row, doc_id, token, tf), one a document and distinct token, beside the idf of each token
and the length of each document's vector. Term counts are taken where the texts lie. Only the tokens of two documents or more
have an idf of their own; the most frequent of these, ``common`` at most, reach the postings by broadcast, and these postings,
nearly all, are not shuffled: a document's length is summed where they lie. Postings of rarer tokens meet the idf by shuffle.
Scores join the queries' tokens with the postings of these alone. Likeness is the cosine; a document without tokens has length 0 and is like nothing.

Tokens are runs of two or more word characters of any script, lower case. idf is ln((1 + n) / (1 + df)) + 1 over all n
documents. Every row is a document of its own, also if it repeats another. A null text is empty. A token of a query that no
document has is left out of the query.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .retrieval import top_k

TOKEN = r"[\p{L}\p{N}_]{2,}"


def term_counts(docs: DataFrame, key: str) -> DataFrame:
    """row (a number of the document), key, token, tf. docs: key, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows, names, tokens, counts = [], [], [], []
                for name, words in zip(batch.column("key").slice(at, 256).to_pylist(), batch.column("tokens").slice(at, 256).to_pylist()):
                    n = Counter(words or ())
                    rows += [row] * len(n)
                    names += [name] * len(n)
                    tokens += n
                    counts += n.values()
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(names, pa.int64()), pa.array(tokens, pa.string()), pa.array(counts, pa.int32())], names=["row", key, "token", "tf"])

    words = docs.select(F.col(key).cast("long").alias("key"), F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), 0).alias("tokens"))
    return words.mapInArrow(run, f"row long, {key} long, token string, tf int")


@dataclass
class Index:
    postings: DataFrame
    #: i_token, idf of every token; of the most frequent ones, for a broadcast; and whether all others are of one document.
    idf: DataFrame
    frequent: DataFrame
    rest_single: bool
    lengths: DataFrame | None
    n: int


def _idf(n: int, df: Column) -> Column:
    return F.log(F.lit(1.0 + n) / (1.0 + df)) + 1.0


def _weighed(index: Index) -> DataFrame:
    """The postings with w, tf times idf."""
    met = index.postings.join(F.broadcast(index.frequent), F.col("token") == F.col("i_token"), "left").drop("i_token")
    if index.rest_single:
        met = met.withColumn("idf", F.coalesce("idf", _idf(index.n, F.lit(1))))
    else:
        met = met.where("idf is not null").unionByName(met.where("idf is null").drop("idf").join(index.idf, F.col("token") == F.col("i_token")).drop("i_token"))
    return met.select("row", "doc_id", "token", (F.col("tf") * F.col("idf")).alias("w"))


def build(docs: DataFrame, common: int = 500_000) -> Index:
    """The index of docs (doc_id, text), written once. common: tokens whose idf is broadcast, at most."""
    postings, n = written(term_counts(docs, "doc_id"), "postings"), docs.count()
    counts = postings.groupBy(F.col("token").alias("i_token")).agg(F.count(F.lit(1)).alias("df"))
    idf = written(counts.withColumn("idf", _idf(n, F.col("df"))), "idf")
    size = idf.agg(F.count_if(F.col("df") > 1).alias("shared"), F.count(F.lit(1)).alias("all")).first()
    least = 1
    if size.shared > common:
        least = idf.agg(F.percentile_approx("df", F.lit(1 - common / size["all"]), F.lit(10_000)).alias("df")).first().df
    index = Index(postings, idf.select("i_token", "idf"), idf.where(F.col("df") > least).select("i_token", "idf"), least == 1, None, n)
    squares = _weighed(index).select(F.col("row").alias("l_row"), F.pow("w", F.lit(2.0)).alias("s"))
    index.lengths = written(squares.groupBy("l_row").agg(F.sqrt(F.sum("s")).alias("length")), "lengths")
    return index


def weights(index: Index, lengths: int = 1_000_000) -> DataFrame:
    """row, doc_id, token, weight: the unit vectors of the documents. So many lengths are broadcast at most; more meet the postings by shuffle."""
    own = F.broadcast(index.lengths) if index.n <= lengths else index.lengths
    met = _weighed(index).join(own, F.col("row") == F.col("l_row"))
    return met.select("row", "doc_id", "token", (F.col("w") / F.col("length")).alias("weight"))


def scores(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, doc_ord, score: the cosine of every query with every document that shares a token with it; all others score 0.

    queries: query_id (one row each), text.
    """
    q = term_counts(queries, "query_id").join(index.idf, F.col("token") == F.col("i_token")).select("query_id", F.col("token").alias("q_token"), (F.col("tf") * F.col("idf")).alias("w"), "idf")
    q = written(q, "queries")
    size = q.groupBy(F.col("query_id").alias("of")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("q_length"))
    hits = q.join(index.postings, F.col("q_token") == F.col("token")).groupBy("query_id", "row", "doc_id").agg(F.sum(F.col("w") * F.col("tf") * F.col("idf")).alias("dot"))
    met = hits.join(index.lengths, F.col("row") == F.col("l_row")).join(size, F.col("query_id") == F.col("of"))
    return met.select("query_id", F.col("doc_id").alias("doc_ord"), (F.col("dot") / F.col("length") / F.col("q_length")).alias("score"))


def best(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """query_id, doc_ord, score, rank: the k most alike documents that share a token with the query; likeness that differs by rounding is a tie."""
    return top_k(scores(index, queries).withColumn("score", F.round("score", 9)), k)


def mean_pairwise(index: Index) -> DataFrame:
    """n and mean_similarity over all pairs, from the sum of the unit vectors: (|sum|^2 - number of vectors) / (n (n - 1)); 0 under two documents."""
    total = weights(index).groupBy("token").agg(F.sum("weight").alias("s")).agg(F.coalesce(F.sum(F.col("s") * F.col("s")), F.lit(0.0)).alias("q"))
    some = index.lengths.where("length > 0").agg(F.count(F.lit(1)).alias("m"))
    # one row each
    pairs = F.lit(index.n * (index.n - 1.0))
    return total.join(F.broadcast(some)).select(F.lit(index.n).cast("long").alias("n"), F.when(pairs > 0, (F.col("q") - F.col("m")) / F.nullif(pairs, F.lit(0.0))).otherwise(0.0).alias("mean_similarity"))
