"""A stored vector index with an inverted file of cells: built once for a corpus, opened again while the corpus is unchanged.

Cells are the Voronoi cells of centroids that spherical k-means trains on a bounded sample; every row of the corpus is
stored in the cell of its nearest centroid, sorted by cell, so that a search for a few cells reads a few row groups. Beside
the vectors lies one row a cell: its centroid, its size, and its radius, the largest angle between the centroid and a row.

A search probes the nearest cells of each query, as many as the recall asked for takes: when the index is built, the ten
nearest rows of a bounded sample of rows are found exactly, and the share of them that lies in the first 1, 2.. cells is
stored. An exact search goes on to every cell that may still hold one of the k best: no row of a cell is nearer to the
query than the angle to its centroid less its radius.

Scale: rows and queries meet by cell in blocks of bounded size; a large cell is several blocks, and so are its queries. The
driver holds the centroids (``max_cells`` at most) and trains on ``sample`` rows at most; it never holds the corpus or
the queries. A row without a direction (all zeros) has similarity 0 to all, and lies in the first cell; an exact search
finds it. Null embeddings are not indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import exists
from ..storage import shared_dir, written
from .retrieval import dot, l2_normalised, top_k


@dataclass(frozen=True)
class Setting:
    #: Rows that centroids are trained on, at most, and rounds of training.
    sample: int = 65_536
    rounds: int = 12
    #: Cells: the square root of the number of rows, at most this many.
    max_cells: int = 4096
    #: Rows and queries of a block, at most.
    block_rows: int = 20_000
    block_queries: int = 20_000
    #: Rows whose nearest ones are found exactly to measure recall, at most; and how many nearest ones.
    measured: int = 512
    nearest: int = 10
    seed: int = 11


def index_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/vector-index"


def fingerprint(corpus: DataFrame) -> str:
    """A hash of the rows in any order: their number, and the sum of their hashes."""
    row = corpus.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("doc_ord", "embedding").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return f"{row.n:x}-{int(row.h) % (1 << 64):016x}"


#: Numbers of an array of one step, at most: a step goes over as many queries as this allows.
STEP = 1 << 21


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an array column, all of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _against(v: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Cosines with the centroids; those of an index of nothing have no dimension, and count as alike to all."""
    return v @ centre.T if v.shape[1] == centre.shape[1] else np.zeros((len(v), len(centre)))


def _lists(m: np.ndarray) -> pa.Array:
    ends = np.arange(0, m.size + 1, max(1, m.shape[1]), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(m).ravel()))


def train(corpus: DataFrame, n_cells: int, setting: Setting) -> np.ndarray:
    """Unit centroids: spherical k-means on the driver, on rows chosen by a hash of doc_ord, at most ``sample`` of them."""
    n = corpus.count()
    keep = F.pmod(F.xxhash64("doc_ord", F.lit(setting.seed)), F.lit(max(n, 1))) < setting.sample
    # twice the bound is no share that the hash gives; the limit is the stated bound of the sample
    rows = corpus.where(keep if n > setting.sample else F.lit(True)).select("embedding").limit(setting.sample).toArrow()
    v = _unit(matrix(rows.column("embedding")))
    v = np.unique(v[np.abs(v).sum(axis=1) > 0], axis=0)
    if len(v) <= n_cells:
        return v if len(v) else np.zeros((1, 1))
    rng = np.random.default_rng(setting.seed)
    centre = v[rng.choice(len(v), n_cells, replace=False)]
    for _ in range(setting.rounds):
        near = np.concatenate([np.argmax(v[i : i + 4096] @ centre.T, axis=1) for i in range(0, len(v), 4096)])
        total = np.zeros_like(centre)
        np.add.at(total, near, v)
        empty = np.bincount(near, minlength=n_cells) == 0
        total[empty] = v[rng.choice(len(v), int(empty.sum()), replace=False)]
        centre = _unit(total)
    return centre


@dataclass
class Index:
    """The stored rows (doc_ord, unit embedding, cell), and per cell its centroid, number of rows and radius.

    recall[i]: the share of nearest rows, measured, in the i + 1 nearest cells.
    """

    rows: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    setting: Setting
    recall: np.ndarray | None = None

    @property
    def n(self) -> int:
        return int(self.sizes.sum())

    def cells_for(self, recall: float) -> int:
        """Cells to probe for a recall: the fewest whose measured share is above it by a hundredth, else all."""
        enough = np.flatnonzero(self.recall >= min(1.0, recall + 0.01))
        return int(enough[0]) + 1 if len(enough) else len(self.sizes)


def build(corpus: DataFrame, place: str, setting: Setting) -> None:
    spark = corpus.sparkSession
    given = corpus.select(F.col("doc_ord").cast("long").alias("doc_ord"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    n_cells = int(min(setting.max_cells, max(1, round(given.count() ** 0.5))))
    centre = train(given, n_cells, setting)
    # at most max_cells vectors
    shared = spark.sparkContext.broadcast(centre)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _unit(matrix(batch.column("embedding")))
                s = _against(v, shared.value)
                cell = np.argmax(s, axis=1)
                angle = np.arccos(np.clip(s[np.arange(len(v)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column("doc_ord"), _lists(v), pa.array(cell.astype(np.int32)), pa.array(angle)], names=["doc_ord", "embedding", "cell", "angle"])

    assigned = given.mapInArrow(assign, "doc_ord long, embedding array<double>, cell int, angle double")
    assigned.repartitionByRange("cell", F.xxhash64("doc_ord")).sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{place}/rows")
    stored = spark.read.parquet(f"{place}/rows")
    cells = {r.cell: (r.n, r.radius) for r in stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()}
    sizes, radii = (np.array([cells.get(c, (0, 0.0))[k] for c in range(len(centre))]) for k in (0, 1))
    share = measured_recall(Index(stored.select("doc_ord", "embedding", "cell"), centre, sizes.astype(np.int64), radii.astype(np.float64), setting))
    # one row a cell
    table = pa.table({"cell": pa.array(np.arange(len(centre), dtype=np.int32)), "centroid": _lists(centre), "n": sizes.astype(np.int64), "radius": radii.astype(np.float64), "recall": share})
    spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(f"{place}/cells")


def measured_recall(index: Index) -> np.ndarray:
    """Of the nearest rows of sampled rows, other than these, the share in each one's first 1, 2.. cells."""
    setting, n_cells = index.setting, len(index.sizes)
    keep = F.pmod(F.xxhash64("doc_ord", F.lit(setting.seed + 1)), F.lit(max(index.n, 1))) < setting.measured
    some = index.rows.where(keep if index.n > setting.measured else F.lit(True)).select(F.col("doc_ord").alias("query_id"), "embedding").limit(setting.measured)
    # a bounded number of rows, and of their nearest ones
    probes = some.toArrow()
    if not probes.num_rows:
        return np.ones(n_cells)
    found = _scored(_asked(index.rows.sparkSession.createDataFrame(probes), index, n_cells), index, setting.nearest + 1)
    near = top_k(found, setting.nearest + 1).where("query_id <> doc_ord").select("query_id", "cell").toArrow()
    order = np.argsort(-np.where(index.sizes > 0, matrix(probes.column("embedding")) @ index.centroids.T, -2.0), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n_cells)[None, :], axis=1)
    ids = probes.column("query_id").to_numpy()
    by_id = np.argsort(ids)
    row = by_id[np.searchsorted(ids[by_id], near.column("query_id").to_numpy())]
    at = place[row, near.column("cell").to_numpy()]
    return np.cumsum(np.bincount(at, minlength=n_cells)) / max(1, len(at))


def open_index(corpus: DataFrame, path: str, setting: Setting = Setting()) -> Index:
    """The index of these very rows below path, built first if none lies there. corpus: doc_ord, embedding."""
    spark = corpus.sparkSession
    place = f"{path}/{fingerprint(corpus)}-{setting.sample}-{setting.rounds}-{setting.max_cells}-{setting.measured}-{setting.nearest}-{setting.seed}"
    if not exists(spark, f"{place}/cells/_SUCCESS"):
        build(corpus, place, setting)
    cells = spark.read.parquet(f"{place}/cells").orderBy("cell").toArrow()
    sizes, radii, recall = (cells.column(c).to_numpy() for c in ("n", "radius", "recall"))
    return Index(spark.read.parquet(f"{place}/rows").select("doc_ord", "embedding", "cell"), matrix(cells.column("centroid")), sizes, radii, setting, recall)


def _asked(probes: DataFrame, index: Index, n_probe: int) -> DataFrame:
    """query_id, unit embedding, cell: each query with each of its nearest cells."""
    shared = probes.sparkSession.sparkContext.broadcast((index.centroids, index.sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, sizes = shared.value
        step = max(1, STEP // max(1, centre.size))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                q = _unit(matrix(part.column("embedding")))
                score = np.where(sizes > 0, _against(q, centre), -2.0)
                cell = np.argsort(-score, axis=1, kind="stable")[:, :n_probe]
                again = np.repeat(np.arange(len(q)), cell.shape[1])
                full = sizes[cell.ravel()] > 0
                again, cell = again[full], cell.ravel()[full]
                yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(again)), _lists(q[again]), pa.array(cell.astype(np.int32))], names=["query_id", "embedding", "cell"])

    given = probes.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    return given.mapInArrow(run, "query_id long, embedding array<double>, cell int")


def _open_cells(probes: DataFrame, found: DataFrame, index: Index, n_probe: int, k: int, floor: float = -2.0) -> DataFrame:
    """query_id, unit embedding, cell: the cells beyond the nearest that may hold one of the k best of the query.

    found: query_id, rank, score of the search so far. A cell is left out if even a row at its rim is worse than rank k, or
    worse than floor.
    """
    shared = probes.sparkSession.sparkContext.broadcast((index.centroids, index.sizes, index.radii))
    kth = found.where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").alias("kth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, sizes, radii = shared.value
        # a query may go on with its vector to every cell
        step = max(1, STEP // max(1, centre.size))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                q = _unit(matrix(part.column("embedding")))
                raw = _against(q, centre)
                order = np.argsort(-np.where(sizes > 0, raw, -2.0), axis=1, kind="stable")
                rest = np.zeros(raw.shape, dtype=bool)
                np.put_along_axis(rest, order[:, n_probe:], True, axis=1)
                # a little wider than the bound, for rounding; the rim of a cell with a zero row is all around
                best = np.cos(np.maximum(np.arccos(np.clip(raw, -1, 1)) - radii - 1e-7, 0.0))
                best[np.abs(q).sum(axis=1) == 0] = 1.0
                kth = np.maximum(part.column("kth").fill_null(-2.0).to_numpy(zero_copy_only=False), floor)
                row, cell = np.nonzero(rest & (sizes > 0) & (best >= kth[:, None] - 1e-9))
                yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(row)), _lists(q[row]), pa.array(cell.astype(np.int32))], names=["query_id", "embedding", "cell"])

    given = probes.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    return given.join(kth, F.col("query_id") == F.col("of"), "left").select("query_id", "embedding", "kth").mapInArrow(run, "query_id long, embedding array<double>, cell int")


def _scored(asked: DataFrame, index: Index, k: int) -> DataFrame:
    """query_id, doc_ord, score, cell: of each block the k best rows for each query that asks for its cell."""
    spark, setting = asked.sparkSession, index.setting
    # one row a cell
    counts = dict(asked.groupBy("cell").agg(F.count(F.lit(1))).collect())
    blocks = {int(c): (-(-int(index.sizes[c]) // setting.block_rows), -(-n // setting.block_queries)) for c, n in counts.items()}
    if not blocks:
        return spark.createDataFrame([], "query_id long, doc_ord long, score double, cell int")
    plan = F.broadcast(spark.createDataFrame([(c, a, b) for c, (a, b) in blocks.items()], "p_cell int, n_rows int, n_queries int"))
    # the cells asked for reach the scan as a filter, as long as they are few
    rows = index.rows.where(F.col("cell").isin(sorted(blocks))) if len(blocks) <= 256 else index.rows
    # the keys of both sides are of one type, as groups meet by hash
    rows = rows.join(plan, F.col("cell") == F.col("p_cell")).select(
        "doc_ord", "embedding", "cell", F.pmod(F.xxhash64("doc_ord"), "n_rows").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("n_queries") - 1)).alias("share")
    )
    asking = asked.join(plan, F.col("cell") == F.col("p_cell")).select(
        "query_id", "embedding", "cell", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), "n_queries").cast("int").alias("share")
    )

    def search(docs: pa.Table, queries: pa.Table) -> pa.Table:
        ids, scores, owners = [], [], []
        if docs.num_rows and queries.num_rows:
            m, doc = matrix(docs.column("embedding")), docs.column("doc_ord").to_numpy()
            q, query = matrix(queries.column("embedding")), queries.column("query_id").to_numpy()
            step = max(1, STEP // len(m))
            for at in range(0, len(q), step):
                s = np.round(q[at : at + step] @ m.T, 12)
                # the k best and all that tie with the last of them, so that ties go by doc_ord
                least = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
                row, column = np.nonzero(s >= least[:, None])
                order = np.lexsort((doc[column], -s[row, column], row))
                row, column = row[order], column[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, column = row[keep], column[keep]
                owners.append(query[at + row])
                ids.append(doc[column])
                scores.append(s[row, column])
        none = np.empty(0)
        owner, doc_ord, score = (np.concatenate([none, *x]) for x in (owners, ids, scores))
        cell = np.full(len(owner), queries.column("cell")[0].as_py() if len(owner) else 0, dtype=np.int32)
        return pa.table({"query_id": owner.astype(np.int64), "doc_ord": doc_ord.astype(np.int64), "score": score, "cell": cell})

    keys = ["cell", "part", "share"]
    return rows.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(search, "query_id long, doc_ord long, score double, cell int")


def search(index: Index, probes: DataFrame, k: int, n_probe: int | None = None, recall: float = 0.95, exact: bool = False) -> DataFrame:
    """query_id, doc_ord, score (cosine), rank: the k best rows of the n_probe nearest cells, or, if exact, of all.

    Without n_probe, as many cells as the recall asked for takes. Ties in score go to the smaller doc_ord. probes: query_id
    (one row each), embedding.
    """
    n_probe = n_probe or index.cells_for(recall)
    first = _scored(_asked(probes, index, n_probe), index, k)
    best = top_k(first, k).drop("cell")
    if not exact:
        return best
    return top_k(first.unionByName(_scored(_open_cells(probes, best, index, n_probe, k), index, k)), k).drop("cell")


def share_read(index: Index, probes: DataFrame, n_probe: int | None = None, recall: float = 0.95) -> DataFrame:
    """query_id, rows: rows of the corpus in the cells that the query probes."""
    n_probe = n_probe or index.cells_for(recall)
    sizes = index.rows.sparkSession.createDataFrame([(c, int(n)) for c, n in enumerate(index.sizes.tolist())], "c int, n long")
    asked = _asked(probes, index, n_probe).select("query_id", "cell")
    return asked.join(F.broadcast(sizes), F.col("cell") == F.col("c")).groupBy("query_id").agg(F.sum("n").alias("rows"))


def _pairs(found: DataFrame, k: int) -> DataFrame:
    """x, y, score of the k best pairs among found; ties by x, then y."""
    pairs = found.where("query_id <> doc_ord").select(F.least("query_id", "doc_ord").alias("x"), F.greatest("query_id", "doc_ord").alias("y"), "score")
    # a pair found from both ends may differ by rounding
    return pairs.groupBy("x", "y").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "x", "y").limit(k)


def closest_pairs(index: Index, k: int) -> tuple[DataFrame, DataFrame]:
    """x, y, score: the k most similar pairs of all rows against all; and rows, cells: the pairs of a row and a cell that were compared.

    Rows search their own cell first. The k-th best pair found there is a floor: of the other cells only those are opened that
    may hold a row as near to the searching row, by their radius, so no pair is lost, and no more than k + 1 rows are kept for
    a row. Repeated doc_ords are one row.
    """
    own = index.rows.select(F.col("doc_ord").alias("query_id"), "embedding")
    # a row's best partner is itself
    first = written(_scored(_asked(own, index, 1), index, k + 1), "first")
    best = _pairs(first, k).collect()
    floor = best[-1].score if len(best) == k else -2.0
    none = first.where("false").withColumn("rank", F.lit(1))
    opened = written(_open_cells(own, none, index, 1, k + 1, floor), "opened")
    met = first.unionByName(_scored(opened, index, k + 1))
    return _pairs(met, k), opened.agg(F.count(F.lit(1)).alias("opened")).select((F.col("opened") + index.n).alias("compared"), F.lit(index.n * int((index.sizes > 0).sum())).alias("of"))


def extremes(index: Index, probes: DataFrame) -> DataFrame:
    """query_id, n, least, most, mean: likeness of each query to all rows but those of its own number, without a pair.

    The mean comes from the sum of the unit vectors, the most like row from an exact search, and the least like one from an
    exact search for the opposite vector. Queries are rows of the index, once each.
    """
    size = index.centroids.shape[1]
    sums = index.rows.select(F.posexplode("embedding").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    # as many numbers as a vector has
    total = F.array(*(F.lit(x) for x in [dict((r.i, r.v) for r in sums).get(i, 0.0) for i in range(size)]))
    unit = l2_normalised(F.col("embedding"))
    asked = probes.select(F.col("query_id").cast("long").alias("query_id"), unit.alias("embedding"))
    other = asked.select("query_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    near, far = (search(index, p, 2, n_probe=1, exact=True).where("query_id <> doc_ord").groupBy(F.col("query_id").alias("of")).agg(F.max("score").alias("best")) for p in (asked, other))
    own = dot(F.col("embedding"), F.col("embedding"))
    rows = asked.select("query_id", F.lit(index.n - 1).cast("long").alias("n"), ((dot(F.col("embedding"), total) - own) / F.lit(float(max(1, index.n - 1)))).alias("mean"))
    rows = rows.join(near.select("of", F.col("best").alias("most")), F.col("query_id") == F.col("of")).drop("of")
    return rows.join(far.select("of", (-F.col("best")).alias("least")), F.col("query_id") == F.col("of")).drop("of")
