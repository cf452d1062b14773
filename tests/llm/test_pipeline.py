"""The pipeline's stages, each against what it must have done to its own input."""

import corpus_pipeline as P
from labelwright.llm import lsh_forest
from labelwright.llm.common import written


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = written(stage(spark, docs, sf), f"test-{name}")
        sizes[name] = (docs.count(), out.count())
        if k < len(P.STAGES) - 1:
            assert out.columns == columns
            assert out.select("doc_id", "text").distinct().subtract(docs.select("doc_id", "text")).count() == 0
        if name == "near_duplicates":
            assert {r.n_links for r in lsh_forest.classes(out).collect()} == {0}
            kept = {r.doc_id for r in out.collect()}
            assert kept == {r.class_id for r in lsh_forest.classes(docs).collect()}
        docs = out
    for name in ("quality", "near_duplicates", "decontaminate"):
        assert 0 < sizes[name][1] < sizes[name][0]
    assert sizes["mix"][1] > sizes["mix"][0] and sizes["shard"][0] == sizes["shard"][1]
    assert docs.groupBy("shard").count().count() == 24


def test_run(spark, sf):
    rows = P.run(spark, sf).collect()
    assert len({(r.shard, r.slot) for r in rows}) == len(rows) > 0
    assert P.ORACLE_SQL is None


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, sf), f"empty-{name}")
        assert docs.count() == 0


def test_odd_rows(spark, sf):
    """Nulls in every column, clashing extra columns, a repeated row and an empty text pass through every stage."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(3).unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None,) * 5, (10**6, "", "en", "src0", 0), (10**6 + 1, None, None, None, None)], docs.schema))
    docs = docs.unionByName(odd)
    for column in ("size", "key", "root", "__key", "shard", "row", "score"):
        docs = docs.selectExpr("*", f"'kept' as `{column}`")
    for name, stage in P.STAGES:
        out = written(stage(spark, docs, sf), f"odd-{name}")
        assert name == "shard" or out.columns == docs.columns
        assert out.where("`root` <> 'kept' or `score` <> 'kept' or `__key` <> 'kept' or key <> 'kept'").count() == 0 and out.count() > 0
        docs = out
