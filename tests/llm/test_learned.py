"""The learned operators on held-out rows, on models of known parameters, and on samples of repeated ids."""

import numpy as np
import pyarrow as pa
import pytest

from labelwright.llm import common, pu_quality, queries, toxicity
from labelwright.llm import textkernel as tk

SF = "/root/testdata/sf0.1"


def held_out(rows, labels):
    """(true, false) positives and negatives over labelled held-out rows: tp, fp, fn, tn."""
    pairs = [(rows[i].predicted, y) for i, y in labels.items() if y is not None and i in rows and rows[i].held_out]
    return tuple(sum(1 for p, y in pairs if (p, y) == k) for k in ((1, 1), (1, 0), (0, 1), (0, 0)))


def test_toxicity_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in queries.op3_toxicity(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    tp, fp, fn, tn = held_out(rows, labels)
    assert tp + fn > 100 and tn > 800
    assert tp / (tp + fp) > 0.9 and tp / (tp + fn) > 0.8 and tn / (tn + fp) > 0.98


def test_quality_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in queries.op7_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    tp, fp, fn, tn = held_out(rows, labels)
    assert tp + fn > 1000 and tn + fp > 150
    assert tp / (tp + fn) > 0.97 and tn / (tn + fp) > 0.95


def test_label_model_recovers_rates_and_correlations():
    """From votes alone: three independent voters, and one that copies the first in nine cases of ten."""
    rng = np.random.default_rng(0)
    n = 6000
    y = rng.random(n) < 0.25
    votes = np.column_stack([rng.random(n) < np.where(y, p, r) for p, r in ((0.7, 0.05), (0.6, 0.03), (0.5, 0.02), (0.5, 0.05))]).astype(float)
    copy = np.where(rng.random(n) < 0.9, votes[:, 0], rng.random(n) < 0.3)
    votes = np.column_stack([votes, copy]).astype(float)
    model, q = toxicity.fit_label_model(votes, np.where(votes.sum(axis=1) >= 2, 0.9, 0.05), 40)
    assert abs(model.prior - 0.25) < 0.05
    assert np.abs(model.fires[1, :4] - [0.7, 0.6, 0.5, 0.5]).max() < 0.1 and np.abs(model.fires[0, :4] - [0.05, 0.03, 0.02, 0.05]).max() < 0.05
    bound = 4 if model.parent[4] == 0 else 0
    assert {int(model.parent[bound]), bound} == {0, 4} and model.correlation[:, bound].min() > 0.6
    # the copy adds next to nothing to what the first says
    alone, both = np.array([[1, 0, 0, 0, 0]]), np.array([[1, 0, 0, 0, 1]])
    assert abs(model.logit(both)[0] - model.logit(alone)[0]) < 0.5
    assert ((q > 0.5) == y).mean() > 0.9


def test_patterns():
    texts = ["YOU IDIOT", "a quiet text", "what an id*ot", "no!!! really?!", "", None, "you are such a moron", "idiot and moron " + "word " * 400]
    got = toxicity.patterns(tk.texts_of(pa.array(texts)))
    assert got.shape == (8, toxicity.N_PATTERNS) and not got[[1, 4, 5]].any()
    assert got[0, [0, 5, 8, 9]].all() and got[2, 4] and got[3, [2]].all() and got[6, 9] and got[7, 6] and not got[7, 7]


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.85])
def test_class_prior_of_known_mixtures(prior):
    rng = np.random.default_rng(4)
    pos = lambda n: rng.normal(1.3, 1, (n, 4))
    neg = lambda n: rng.normal(-1.3, 1, (n, 4))
    k = int(6000 * prior)
    unl = np.concatenate([pos(k), neg(6000 - k)])[rng.permutation(6000)]
    assert abs(pu_quality.class_prior(pos(4000), unl) - prior) < 0.05
    model = pu_quality.fit(pos(4000), unl, None)
    assert abs(model.prior - prior) < 0.05 and (model.score(pos(2000)) > 0.5).mean() > 0.93 and (model.score(neg(2000)) < 0.5).mean() > 0.93


def test_negative_labels_are_not_read(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 7) + "tail" * (i % 5)) for i in range(120)], "doc_id long, text string")
    some = [(i, 1) for i in range(0, 120, 3)]
    a = pu_quality.train(docs, spark.createDataFrame(some, "doc_id long, label int"), pu_quality.held_out_third())
    b = pu_quality.train(docs, spark.createDataFrame(some + [(i, 0) for i in range(1, 120, 3)], "doc_id long, label int"), pu_quality.held_out_third())
    assert a.prior == b.prior and np.array_equal(a.weight, b.weight)


def test_samples_are_bounded_where_ids_repeat(spark, monkeypatch):
    """A labelled id with thousands of rows does not widen what reaches the driver."""
    rows = [(1, f"text {i} of the one id") for i in range(3000)] + [(i, f"text {i}") for i in range(2, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 400)], "doc_id long, label int")
    taken = []
    frame = type(docs)
    real = frame.toPandas
    monkeypatch.setattr(frame, "toPandas", lambda self: taken.append(real(self)) or taken[-1])
    pu_quality.train(docs, labels, pu_quality.held_out_third(), pu_quality.Sample(positives=100, unlabelled=200))
    toxicity.train(docs, labels, toxicity.held_out_quarter(), toxicity.Setting(labelled=100))
    assert len(taken) == 2 and all(len(x) < 450 for x in taken)
    assert common.hashed_share(docs, 10_000, 1, "doc_id").count() == len(rows)


def test_null_labels(spark):
    docs = spark.createDataFrame([(i, "you idiot" if i % 2 else "fine words") for i in range(40)] + [(None, "you idiot"), (41, None)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(40)]
    plain = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, label int"), toxicity.held_out_quarter())
    nulls = toxicity.train(docs, spark.createDataFrame(labels + [(3, None), (None, 1), (41, None)], "doc_id long, label int"), toxicity.held_out_quarter())
    assert np.array_equal(plain.weight, nulls.weight) and plain.bias == nulls.bias
    scores = {r.doc_id: r.score for r in toxicity.score(docs, plain).collect()}
    assert scores[1] > 0.5 > scores[0] and scores[None] == scores[1]
