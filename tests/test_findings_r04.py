"""The finding of round 4: the same scores in files of less than half the size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelwright.operators import retrieval


def vectors(spark, v, name):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>")


def bytes_per_row(df, folder):
    df.write.parquet(str(folder))
    return sum(p.stat().st_size for p in folder.glob("*.parquet")) / df.sparkSession.read.parquet(str(folder)).count()


def checked(folder, q, m):
    """The files' rows are all pairs, once each, with the cosine to six places, half away from zero."""
    got = pd.read_parquet(folder).sort_values(["query_id", "doc_ord"])
    q, m = (x.astype(np.float32).astype(np.float64) for x in (q, m))
    q, m = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (q, m))
    assert len(got) == len(q) * len(m)
    assert (got["query_id"].to_numpy().reshape(len(q), -1) == np.arange(len(q))[:, None]).all() and (got["doc_ord"].to_numpy().reshape(len(q), -1) == np.arange(len(m))).all()
    score = got["score"].to_numpy()
    assert np.abs(score - (q @ m.T).ravel()).max() < 5.001e-7 and (score == np.round(score, 6)).all()


def test_files_of_all_scores(spark, tmp_path):
    """F1: scores of different vectors take half the space that they take query by query (over 8 bytes a row)."""
    r = np.random.default_rng(4)
    q, m = r.normal(size=(700, 32)), r.normal(size=(7000, 32))
    assert bytes_per_row(retrieval.similarity_scores(vectors(spark, q, "query_id"), vectors(spark, m, "doc_ord")), tmp_path / "x") < 5.2
    checked(tmp_path / "x", q, m)


def test_files_of_scores_of_copies(spark, tmp_path):
    """F1: where most vectors are copies, their scores take next to nothing; more than one strip, block of queries and task."""
    r = np.random.default_rng(5)
    own = r.normal(size=(150, 32))
    q, m = own[r.permutation(600) % 50], own[r.permutation(3000) % 150]
    assert bytes_per_row(retrieval.similarity_scores(vectors(spark, q, "query_id"), vectors(spark, m, "doc_ord"), block_rows=400), tmp_path / "x") < 0.5
    checked(tmp_path / "x", q, m)


@pytest.mark.parametrize("places, last", [(6, [-0.6, -0.96, 0.5]), (1, [-0.6, -1.0, 0.5]), (0, [-1.0, -1.0, 1.0]), (11, [-0.6, -0.96, 0.5])])
def test_odd_scores_keep_their_values(spark, places, last):
    """F1: a tie of the last place goes away from zero, a vector of zeros scores 0, one that is not finite has no score and keeps its row."""
    v = [[1.0, 0, 0, 0], [0.0, 0, 0, 0], [float("inf"), 1, 0, 0], [-3.0, 4, 0, 0], [-24.0, 7, 0, 0], [1.0, 1, 1, 1]]
    docs = vectors(spark, v, "doc_ord")
    probes = docs.where("doc_ord < 2").select(F.col("doc_ord").alias("query_id"), "embedding")
    got = {(r.query_id, r.doc_ord): r.score for r in retrieval.similarity_scores(probes, docs, places=places).collect()}
    assert len(got) == 12 and [got[0, i] for i in range(6)] == [1.0, 0.0, None, *last] and got[1, 5] == 0.0
