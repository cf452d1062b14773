"""Target-distribution importance resampling with hashed n-gram features.

Features are the runs of 1 to ``n`` consecutive words of a text, each hashed to a bucket. A bucket's gain is the scaled
log of its share in the target texts over its share in all documents, both smoothed by one; a document's weight is the
mean gain of its features; documents are drawn without replacement by Gumbel noise on their weights, the noise coming
from a hash of the id, so that reruns agree.

Long texts are cut into chunks of bounded size at word boundaries. A chunk carries the n - 1 words after its end, and owns
the features that start before it, so that each feature belongs to one chunk. Chunks are dealt out over the cluster,
counted like texts, and their numbers and sums of gains added up by document. Texts up to ``chunk_bytes`` stay where they
are.

Scale: counts are a table of ``buckets`` numbers a task, added before and after one shuffle; the driver gets the buckets,
nothing that grows. Ranks come from a range sort by (score, id, row), whose partitions are numbered within and then
offset by the numbers of the partitions before, so equal scores or ids are no single task.

A null or empty text has no features and weight 0. A null doc_id reads as an empty string in the noise and comes last
among ties. Repeated rows are drawn each for itself; their order among each other is arbitrary. Scores tied at the end of
the draw go to smaller ids. Empty documents give an empty result; with an empty target every gain is that of no
occurrence. Only doc_id and text are read, and text of the target.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import written

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that no word has, after lower-casing: all of ASCII but digits and small letters.
_BETWEEN = np.ones(256, dtype=bool)
_BETWEEN[48:58] = _BETWEEN[97:123] = False
_BETWEEN[128:] = False
_ALL_SET = np.uint32(0xFFFFFFFF)


@dataclass(frozen=True)
class Setting:
    #: Longest run of words that is a feature.
    n: int = 2
    buckets: int = 10_000
    #: Scale of gains and noise, which are floored to whole numbers.
    scale: int = 1000
    seed: str = "7"
    min_words: int = 20
    percent: int = 25
    chunk_bytes: int = 1 << 16
    #: Words longer than this are hashed one by one.
    long_word: int = 64


@cache
def _crc_table() -> np.ndarray:
    """CRC-32 of each byte, bit by bit from the reversed polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


def crc_further(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, long_word: int = 64) -> np.ndarray:
    """CRC-32 states (not yet inverted) after reading data[start:end] on from each state."""
    table, size = _crc_table(), end - start
    out = state.copy()
    order = np.argsort(-np.minimum(size, long_word + 1), kind="stable")
    order = order[size[order] <= long_word]
    s, at, left = state[order], start[order], size[order]
    # longest first: the words that have a k-th byte come before those that don't
    stop = len(order) - np.searchsorted(left[::-1], np.arange(int(left[0]) if len(left) else 0), side="right")
    for k, active in enumerate(stop.tolist()):
        x = s[:active]
        s[:active] = table[(x ^ data[at[:active] + k]) & np.uint32(255)] ^ (x >> np.uint32(8))
    out[order] = s
    for i in np.flatnonzero(size > long_word).tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(state[i] ^ _ALL_SET)) ^ 0xFFFFFFFF
    return out


def features(t: tk.Texts, owned: np.ndarray, setting: Setting) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and bucket of each feature that starts in the first ``owned`` bytes of its text; owned words of each document."""
    data = _LOWER[t.data]
    w = tk.words_of(tk.Texts(data, t.offsets), _BETWEEN)
    doc = w.doc()
    mine = w.start - t.offsets[doc] < owned[doc]
    state = crc_further(np.full(len(doc), _ALL_SET), data, w.start, w.end, setting.long_word)
    table = _crc_table()
    docs, buckets, first = [], [], np.flatnonzero(mine)
    for k in range(setting.n):
        if k:
            first = first[first + k < w.first[doc[first] + 1]]
            x = state[first]
            space = table[(x ^ np.uint32(32)) & np.uint32(255)] ^ (x >> np.uint32(8))
            state[first] = crc_further(space, data, w.start[first + k], w.end[first + k], setting.long_word)
        docs.append(doc[first])
        buckets.append((state[first] ^ _ALL_SET) % np.uint32(setting.buckets))
    return np.concatenate(docs), np.concatenate(buckets).astype(np.int64), np.bincount(doc[mine], minlength=t.n)


def cuts(text: np.ndarray, setting: Setting) -> list[tuple[int, int, int]]:
    """begin, owned end and end of the chunks of a text: cut before the first word at or after each multiple of the size."""
    solid = ~_BETWEEN[_LOWER[text]]
    start = np.flatnonzero(solid & ~np.r_[False, solid[:-1]])
    end = np.flatnonzero(solid & ~np.r_[solid[1:], False]) + 1
    if not len(start):
        return []
    heads = np.unique(np.searchsorted(start, np.arange(0, len(text), setting.chunk_bytes)))
    heads = heads[heads < len(start)]
    begins = start[heads]
    # the owned words end where the next chunk begins; n - 1 more words are carried
    owned = np.r_[begins[1:], len(text)]
    last = np.minimum(np.r_[heads[1:], len(start)] - 1 + setting.n - 1, len(start) - 1)
    return list(zip(begins.tolist(), owned.tolist(), end[last].tolist()))


def chunks(texts: DataFrame, setting: Setting) -> DataFrame:
    """Texts over chunk_bytes in chunks: doc_id, row (a number of the text), owned bytes, text; dealt out, and written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i in range(batch.num_rows):
                data = tk.texts_of(batch.column("text").slice(i, 1)).data
                doc_id = batch.column("doc_id")[i].as_py()
                # a text without a word has a chunk too, as its document needs a row
                spans = cuts(data, setting) or [(0, 0, 0)]
                for at in range(0, len(spans), 64):
                    some = spans[at : at + 64]
                    columns = [pa.array([doc_id] * len(some), pa.int64()), pa.array([row] * len(some)), pa.array([b - a for a, b, _ in some])]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([data[a:c].tobytes() for a, _, c in some], pa.binary())], names=["doc_id", "row", "owned", "text"])
                row += 1

    cut = texts.where(F.octet_length("text") > setting.chunk_bytes).mapInArrow(run, "doc_id long, row long, owned long, text binary")
    return written(cut.repartition(F.xxhash64("row", "owned", "text")), "chunks")


def whole(texts: DataFrame, setting: Setting) -> DataFrame:
    """The other texts, as chunks that own all of their bytes."""
    short = texts.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= setting.chunk_bytes)
    return short.select("doc_id", F.lit(None).cast("long").alias("row"), F.octet_length("text").cast("long").alias("owned"), F.col("text").cast("binary").alias("text"))


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, tk.Texts, np.ndarray]]:
    # the kernel reads offsets and bytes only, whatever the bytes are
    for piece in tk.slices(batch, "text"):
        column = piece.column("text").fill_null(b"").cast(pa.large_binary())
        _, offs, data = column.buffers()
        offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
        t = tk.Texts(raw[offsets[0] : offsets[-1]], offsets - offsets[0])
        yield piece, t, piece.column("owned").fill_null(0).to_numpy(zero_copy_only=False)


def bucket_counts(parts: list[DataFrame], setting: Setting) -> np.ndarray:
    """Occurrences of the features of each bucket over all the chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(setting.buckets, dtype=np.int64)
        for batch in batches:
            for _, t, owned in _pieces(batch):
                n += np.bincount(features(t, owned, setting)[1], minlength=setting.buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["bucket", "n"])

    counted = [p.mapInArrow(run, "bucket long, n long") for p in parts]
    out = np.zeros(setting.buckets, dtype=np.int64)
    # one row a bucket
    for r in _union(counted).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gains(source: np.ndarray, target: np.ndarray, setting: Setting) -> np.ndarray:
    """Scaled log ratios of the smoothed bucket shares, floored."""
    s, t, k = source.astype(np.float64), target.astype(np.float64), float(setting.buckets)
    return np.floor(setting.scale * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weighed(short: DataFrame, long: DataFrame, gain: np.ndarray, setting: Setting) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of the texts that the chunks are of."""
    # one number a bucket
    shared = short.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, t, owned in _pieces(batch):
                doc, bucket, words = features(t, owned, setting)
                # whole numbers, exact below 2^53
                total = np.bincount(doc, weights=shared.value[bucket], minlength=t.n).astype(np.int64)
                columns = [pa.array(words.astype(np.int64)), pa.array(np.bincount(doc, minlength=t.n).astype(np.int64)), pa.array(total)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("row"), *columns], names=["doc_id", "row", "n_words", "n_features", "gain"])

    kind = "doc_id long, row long, n_words long, n_features long, gain long"
    summed = long.mapInArrow(run, kind).groupBy("row").agg(F.first("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")))
    each = short.mapInArrow(run, kind).unionByName(summed)
    mean = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div nullif(n_features, 0)")).otherwise(0)
    return each.select("doc_id", "n_words", "n_features", mean.cast("long").alias("weight"))


def noise(setting: Setting) -> F.Column:
    """Gumbel noise of a document, scaled and floored, from a hash of its id."""
    named = F.concat(F.lit(setting.seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-setting.scale * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, drawn: int, setting: Setting) -> DataFrame:
    """The rows with their rank, null behind the first ``drawn`` of those that are long enough; scored: a written table."""
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    rows = scored.withColumn("able", F.col("n_words") >= setting.min_words)
    # partition and place in it: the sort's own numbers
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("of")).agg(F.count(F.lit(1)).alias("n"))
    # one row a partition
    before = sizes.select("of", F.coalesce(F.sum("n").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.col("before") + F.col("at") - F.shiftleft(F.col("of"), 33) + 1
    return placed.join(F.broadcast(before), part == F.col("of")).withColumn("rank", F.when(F.col("able") & (place <= drawn), place))


def resample(docs: DataFrame, target: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (null if not drawn) for every row of docs; target: text."""
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    wanted = target.selectExpr("cast(null as long) doc_id", "cast(text as string) text")
    short, long = whole(texts, setting), chunks(texts, setting)
    gain = gains(bucket_counts([short, long], setting), bucket_counts([whole(wanted, setting), chunks(wanted, setting)], setting), setting)
    scored = weighed(short, long, gain, setting).withColumn("score", F.col("weight") + noise(setting))
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    drawn = setting.percent * scored.where(F.col("n_words") >= setting.min_words).count() // 100
    return ranked(scored, drawn, setting).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
