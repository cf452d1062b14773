"""TF-IDF scores and mean likeness against plain Python, and odd documents."""

import math
import re
from collections import Counter

import pytest

from labelwright.operators import tfidf


def vectors(texts):
    bags = [Counter(re.findall(r"\w{2,}", (t or "").lower())) for t in texts]
    df = Counter(w for b in bags for w in b)
    idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items()}
    out = []
    for b in bags:
        v = {w: n * idf[w] for w, n in b.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        out.append({w: x / size for w, x in v.items()} if size else {})
    return out, idf


def like(a, b):
    return sum(x * b.get(w, 0.0) for w, x in a.items())


TEXTS = ["Seasonings and condiments", "Potato cereal flour or starch based snacks", "Cocoa and chocolate products", "and and and cocoa", None, "", "a b c", "Cocoa and chocolate products", "éété cocoa_1"]


def test_scores_and_mean(spark):
    index = tfidf.build(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3))
    docs, idf = vectors(TEXTS)
    asked = ["Seasonings spices salt", "cocoa and cocoa", "nothing known", None]
    got = {(r.query_id, r.doc_ord): r.score for r in tfidf.scores(index, spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")).collect()}
    for q, text in enumerate(asked):
        v = {w: n * idf[w] for w, n in Counter(re.findall(r"\w{2,}", (text or "").lower())).items() if w in idf}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        for d, doc in enumerate(docs):
            want = like(v, doc) / size
            assert got.get((q, d), 0.0) == pytest.approx(want, abs=1e-12)
            assert ((q, d) in got) == (want > 0)
    pairs = [like(a, b) for i, a in enumerate(docs) for b in docs[:i]]
    assert tuple(tfidf.mean_pairwise(index).first()) == (len(TEXTS), pytest.approx(sum(pairs) / len(pairs)))


def test_repeated_rows_are_documents_of_their_own(spark):
    index = tfidf.build(spark.createDataFrame([(1, "one two"), (1, "one two"), (2, "three")], "doc_id long, text string"))
    rows = sorted((r.doc_id, r.token, round(r.weight, 6)) for r in tfidf.weights(index).collect())
    assert rows == [(1, "one", 0.707107)] * 2 + [(1, "two", 0.707107)] * 2 + [(2, "three", 1.0)]


def test_nothing(spark):
    none = tfidf.build(spark.createDataFrame([], "doc_id long, text string"))
    assert tfidf.weights(none).count() == 0 and tuple(tfidf.mean_pairwise(none).first()) == (0, 0.0)
    assert tfidf.scores(none, spark.createDataFrame([(1, "x y")], "query_id long, text string")).count() == 0
