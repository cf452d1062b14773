"""The vector index: recall of the probed cells, exact search, blocks, reopening and odd rows."""

import numpy as np
import pytest

from labelwright import plans
from labelwright.operators import vector_index as X


def brute(corpus, queries, k):
    """(query, row, rank) of the k most similar rows, ties by row."""
    ids = np.array([i for i, _ in corpus])
    v, q = (np.array([e for _, e in x], dtype=float) for x in (corpus, queries))
    v, q = (m / np.where(np.linalg.norm(m, axis=1) > 0, np.linalg.norm(m, axis=1), 1)[:, None] for m in (v, q))
    out = set()
    for (qid, _), s in zip(queries, np.round(q @ v.T, 12)):
        out |= {(qid, int(ids[i]), r) for r, i in enumerate(np.lexsort((ids, -s))[:k], 1)}
    return out


def table(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} long, embedding array<double>")


def found(df):
    return {(r.query_id, r.doc_ord, r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def clouds():
    """Rows around 12 centres, one centre with a third of all; repeated rows, and one without a direction."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(12, 16))
    which = np.where(rng.random(900) < 0.33, 0, rng.integers(0, 12, 900))
    rows = [(i, e.tolist()) for i, e in enumerate(centre[which] + 0.4 * rng.normal(size=(900, 16)))]
    return [*rows, *((1000 + i, rows[i][1]) for i in range(40)), (2000, [0.0] * 16)]


@pytest.mark.parametrize("setting", [X.Setting(), X.Setting(block_rows=37, block_queries=3), X.Setting(sample=100), X.Setting(max_cells=1)])
def test_exact_search_is_the_brute_force(spark, tmp_path, clouds, setting):
    queries = [(i, e) for i, e in clouds if i % 20 == 0]
    index = X.open_index(table(spark, clouds, "doc_ord"), f"file://{tmp_path}", setting)
    assert index.n == len(clouds)
    got = found(X.search(index, table(spark, queries, "query_id"), 10, n_probe=2, exact=True))
    assert got == brute(clouds, queries, 10)


def test_blocks_of_both_sides_meet_in_many_partitions(spark, tmp_path, clouds):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        index = X.open_index(table(spark, clouds, "doc_ord"), f"file://{tmp_path}", X.Setting(block_rows=50))
        queries = [x for x in clouds if x[0] % 30 == 0]
        assert found(X.search(index, table(spark, queries, "query_id"), 5, n_probe=3, exact=True)) == brute(clouds, queries, 5)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_exact_search_skips_cells(spark, tmp_path, clouds):
    """Queries in a tight cloud need not open the cells of the others."""
    index = X.open_index(table(spark, clouds, "doc_ord"), f"file://{tmp_path}")
    probes = table(spark, [(i, e) for i, e in clouds if i % 50 == 0 and any(e)], "query_id")
    best = X.search(index, probes, 3, n_probe=2)
    opened = X._open_cells(probes, best, index, 2, 3).count()
    assert opened < 0.9 * probes.count() * (len(index.sizes) - 2)


def test_recall_is_what_was_asked_for(spark, tmp_path, clouds):
    index = X.open_index(table(spark, clouds, "doc_ord"), f"file://{tmp_path}")
    queries = [x for x in clouds if x[0] % 7 == 0]
    want = {(q, d) for q, d, _ in brute(clouds, queries, 10)}
    assert (np.diff(index.recall) >= 0).all() and index.cells_for(0.5) < index.cells_for(0.95) < len(index.sizes)
    for recall in (0.8, 0.95):
        got = {(q, d) for q, d, _ in found(X.search(index, table(spark, queries, "query_id"), 10, recall=recall))}
        assert len(got & want) / len(want) >= recall


def test_recall_on_the_given_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = plans.QUERIES["tk7_index_search"](spark, sf).collect()
    want = {(q, d) for q, d, _ in brute(rows, [x for x in rows if x[0] % 20 == 0], 10)}
    recall = len({(r.query_id, r.doc_ord) for r in got} & want) / len(want)
    share = np.mean([r.rows_read for r in got]) / len(rows)
    assert recall >= 0.95 and share < 0.95


def test_rebuilds_only_when_the_corpus_changes(spark, tmp_path):
    rows = [(k, [float(k % 3 + 1), float(k % 5), 1.0]) for k in range(30)]
    corpus = table(spark, rows, "doc_ord")
    one = X.open_index(corpus, f"file://{tmp_path}").rows.inputFiles()
    assert X.open_index(corpus.repartition(7), f"file://{tmp_path}").rows.inputFiles() == one
    two = X.open_index(corpus.where("doc_ord > 0"), f"file://{tmp_path}")
    assert two.rows.inputFiles() != one and two.rows.count() == 29
    best = X.search(two, table(spark, [(7, rows[7][1])], "query_id"), 3).orderBy("rank").collect()
    assert best[0].doc_ord == 7 and best[0].score == pytest.approx(1.0) and [b["rank"] for b in best] == [1, 2, 3]


def test_empty_tables_and_null_embeddings(spark, tmp_path, clouds):
    none = X.open_index(table(spark, [], "doc_ord"), f"file://{tmp_path}/none")
    probe = table(spark, [(1, clouds[0][1]), (2, None)], "query_id")
    assert X.search(none, probe, 3, exact=True).count() == 0
    some = X.open_index(table(spark, [*clouds[:5], (99, None)], "doc_ord"), f"file://{tmp_path}/some")
    assert some.n == 5 and X.search(some, probe, 9, exact=True).count() == 5
    assert X.search(some, table(spark, [], "query_id"), 3, exact=True).count() == 0


def test_closest_pairs_and_extremes_of_all_rows(spark, tmp_path, clouds):
    rows = [*clouds[:400], clouds[-1]]
    index = X.open_index(table(spark, rows, "doc_ord"), f"file://{tmp_path}", X.Setting(block_rows=60))
    v = np.array([e for _, e in rows])
    v = v / np.where(np.linalg.norm(v, axis=1) > 0, np.linalg.norm(v, axis=1), 1)[:, None]
    s, ids = np.round(v @ v.T, 12), [i for i, _ in rows]
    want = sorted((-s[a, b], ids[a], ids[b]) for a in range(len(rows)) for b in range(a + 1, len(rows)))[:10]
    pairs, compared = X.closest_pairs(index, 10)
    assert [(r.x, r.y, round(r.score, 9)) for r in pairs.collect()] == [(a, b, round(-x, 9)) for x, a, b in want]
    done = compared.first()
    assert done.compared < 0.8 * done["of"]
    got = {r.query_id: r for r in X.extremes(index, table(spark, rows[::40], "query_id")).collect()}
    for at in range(0, len(rows), 40):
        others = np.delete(s[at], at)
        r = got[ids[at]]
        assert (r.n, r.most, r.least) == (len(rows) - 1, pytest.approx(others.max()), pytest.approx(others.min())) and r.mean == pytest.approx(others.mean())
