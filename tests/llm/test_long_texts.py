"""One text of 12 MB, and a copy of it, among the documents, in the operators that handle a text whole."""

import random

import pytest
from pyspark.sql import functions as F

from labelwright.llm import decontam, lm_score, lsh_forest, mixing, pu_quality, repetition, sharding, superkmer, toxicity
from labelwright.llm.common import table

WORDS = 1_700_000


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(8)
    return " ".join(rng.choice("abcdefgh") + str(rng.randrange(200_000)) for _ in range(WORDS))


@pytest.fixture(scope="module")
def docs(spark, sf, long_text):
    big = spark.createDataFrame([(10_001, long_text, "en", "src0", len(long_text)), (10_002, long_text, "en", "src1", len(long_text))], "doc_id long, text string, lang string, source string, n_chars long")
    return table(spark, sf, "documents").where("doc_id < 60").unionByName(big, allowMissingColumns=True).repartition(2).cache()


def of(rows, doc_id):
    return rows.where(F.col("doc_id") == doc_id).collect()


def test_counts_and_shards(docs, long_text):
    assert len(long_text) > 12 << 20 or len(long_text) > 12_000_000
    (row,) = of(mixing.mix(docs, mixing.curriculum), 10_001)
    assert row["size"] == WORDS and row.taken <= 2 * WORDS
    (row,) = of(repetition.repetition_rules(docs), 10_001)
    assert row.n_words == WORDS and row.kept
    assert {r["size"] for r in sharding.shard(docs, 4).where("doc_id > 10000").collect()} == {len(long_text) + sharding.ROW_OVERHEAD}


def test_copies_and_windows(docs):
    (one,), (two,) = (of(superkmer.dedup(docs), i) for i in (10_001, 10_002))
    assert (one.n_words, one.n_removed) == (WORDS, 0) and two.n_removed == WORDS
    classes = lsh_forest.classes(docs)
    name = next(c for c in classes.columns if "class" in c or "component" in c)
    assert len({r[name] for r in classes.where("doc_id > 10000").collect()}) == 1


def test_models_and_benchmark(spark, sf, docs):
    labels = table(spark, sf, "labels")
    for module, column, held_out in ((toxicity, "toxic", toxicity.held_out_quarter()), (pu_quality, "quality", pu_quality.held_out_third())):
        model = module.train(table(spark, sf, "documents"), labels.select("doc_id", F.col(column).alias("label")), held_out)
        (one,), (two,) = (of(module.score(docs, model), i) for i in (10_001, 10_002))
        assert 0 <= one.score <= 1 and one.score == two.score
    (row,) = of(lm_score.score_corpus(docs, labels.where("quality = 1").select("doc_id")), 10_001)
    assert row.n_tokens == WORDS
    assert decontam.leaks(docs, table(spark, sf, "benchmark")).where("doc_id > 10000").count() == 0
