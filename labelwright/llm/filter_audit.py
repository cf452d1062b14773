"""Filter interaction audit: what each of five filters removes, alone, after the others, and in every order.

The filters are A (few words), B (few distinct words), C (many capitals), D (symbols) and E (a copy of the text under a
smaller doc_id). A task reads the UTF-8 bytes of an Arrow column: a table of byte classes marks separators, capitals,
symbols and first bytes of code points, and prefix sums of the marks give each document's counts at its two offsets.
Distinct words come from word hashes sorted within the document; words of equal hash are compared byte by byte, and a
document where two differ is counted from its words themselves. A document leaves the task as a mask of its filters and
the SHA-256 of its text; its text is not shuffled.

Equal texts have equal masks but for E, so rows are counted by (text, part, labels) before copies meet: of each text one
row a part and label goes on, whatever the number of copies. Last, 32 counts by mask of each part, times constant 0/1
matrices, give every order and step.

A null text is empty and has no words: A alone fails. A null doc_id is no copy and makes no copy, and has no labels. Of
rows that repeat a doc_id and its text all are originals, none being smaller. A null source and an empty one are one
part, the empty string. A doc_id with several labels is good, or toxic, if one of them says so. Empty documents give an
empty result. Only doc_id, text and source, and doc_id, quality and toxic of the labels are read, so other columns may
have any name. A text is one task's work, in some thirty times its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import written

FILTERS = "ABCDE"
_COPY = 1 << FILTERS.index("E")
_MASKS = 1 << len(FILTERS)

# The symbols that filter D looks for.
SYMBOLS = "#$%&*|"


@dataclass(frozen=True)
class Limits:
    """A fails under min_words; B under this share of distinct words; C over this share of capitals."""

    min_words: int = 50
    distinct_percent: int = 65
    capitals_percent: int = 5


_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_FIRST_BYTE = np.array([b & 0xC0 != 0x80 for b in range(256)])


def _counted(marks: np.ndarray, t: tk.Texts) -> np.ndarray:
    return tk.per_doc(marks[t.data].astype(np.int64), t.offsets)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a:a+size] equals data[b:b+size], span by span; a bounded number of bytes at a time."""
    same = np.ones(len(a), dtype=bool)
    ends, i = np.cumsum(size), 0
    while i < len(a):
        before = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + (1 << 22), side="right")))
        n = size[i:j]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differs = data[np.repeat(a[i:j], n) + inner] != data[np.repeat(b[i:j], n) + inner]
        same[i:j] = tk.per_doc(differs.astype(np.int64), np.r_[0, np.cumsum(n)]) == 0
        i = j
    return same


def distinct_words(t: tk.Texts, w: tk.Words) -> np.ndarray:
    """Distinct words of each document, case-sensitive."""
    doc = w.doc()
    keys = tk.doc_keys(tk.hash_spans(t.data, w.start, w.end), doc)
    order = np.argsort(keys)
    equal = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    a, b = order[equal], order[equal + 1]
    size = w.end - w.start
    alike = (doc[a] == doc[b]) & (size[a] == size[b])
    alike[alike] = same_bytes(t.data, w.start[a[alike]], w.start[b[alike]], size[a[alike]])
    out = w.counts - np.bincount(doc[b], minlength=t.n)
    for d in np.unique(np.concatenate([doc[a[~alike]], doc[b[~alike]]])):
        out[d] = len(set(t.data[t.offsets[d] : t.offsets[d + 1]].tobytes().split()))
    return out


def masks(t: tk.Texts, limits: Limits) -> np.ndarray:
    """Filters A to D that each document fails, as bits in their order."""
    w = tk.words_of(t)
    n = w.counts
    fails = [
        n < limits.min_words,
        100 * distinct_words(t, w) < limits.distinct_percent * n,
        100 * _counted(_CAPITAL, t) > limits.capitals_percent * _counted(_FIRST_BYTE, t),
        _counted(_SYMBOL, t) > 0,
    ]
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def scan(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """key, named, part, digest, mask of every row: its doc_id, or if that is null (named false) a number of the task's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unnamed = TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in tk.slices(batch, "text"):
                t = tk.texts_of(piece.column("text"))
                ids = piece.column("doc_id")
                named = ids.is_valid()
                key = ids.fill_null(0).to_numpy(zero_copy_only=False).copy()
                free = ~named.to_numpy(zero_copy_only=False)
                key[free] = unnamed + np.arange(int(free.sum()))
                unnamed += int(free.sum())
                raw = t.data.tobytes()
                digests = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(t.offsets[:-1].tolist(), t.offsets[1:].tolist())]
                columns = [pa.array(key), named, piece.column("part"), pa.array(digests, pa.binary()), pa.array(masks(t, limits), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "named", "part", "digest", "mask"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "coalesce(cast(source as string), '') part")
    return rows.mapInArrow(run, "key long, named boolean, part string, digest binary, mask int")


def cells(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """part, mask (all five filters), good, toxic, n: documents of the part that fail just these filters."""
    known = labels.select(F.col("doc_id").cast("long").alias("l_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    known = known.where("l_id is not null").groupBy("l_id").agg(F.coalesce(F.max("good"), F.lit(False)).alias("good"), F.coalesce(F.max("toxic"), F.lit(False)).alias("toxic"))
    rows = scan(docs, limits).join(known, F.col("named") & (F.col("key") == F.col("l_id")), "left")
    alike = ["digest", "part", "mask", "good", "toxic"]
    rows = rows.select("key", "named", "digest", "part", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    # the join has dealt the rows by key, and so are the groups; then the copies of a text are combined before they are shuffled
    ones = rows.groupBy("key", "named", *alike).agg(F.count(F.lit(1)).alias("n"))
    groups = written(
        ones.groupBy(*alike).agg(
            F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("named"), F.col("n"))), F.lit(0)).alias("n_named"), F.min(F.when(F.col("named"), F.struct("key", "n"))).alias("least")
        ),
        "audit",
    )
    first = groups.groupBy(F.col("digest").alias("of")).agg(F.min("least.key").alias("first"), F.sum("n_named").alias("copies")).where("copies > 1")
    met = groups.join(first, F.col("digest") == F.col("of"), "left")
    copies = F.when(F.col("first").isNull(), 0).otherwise(F.col("n_named") - F.when(F.col("least.key") == F.col("first"), F.col("least.n")).otherwise(0))
    split = F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + _COPY).alias("mask"), F.col("copies").alias("n")))
    each = met.withColumn("copies", copies).select("part", "good", "toxic", F.explode(split).alias("x")).select("part", "good", "toxic", "x.mask", "x.n").where("n > 0")
    return each.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def _orders() -> list[tuple[str, int, int, int]]:
    """(order, step, filter's bit, bits of the filters before it) of all orders."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            out.append(("".join(order), step, bit, before))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per part, filter_order and step, zeros included; see the module."""
    by_mask = [
        F.array(*(F.coalesce(F.sum(F.when((F.col("mask") == m) & which, F.col("n"))), F.lit(0)) for m in range(_MASKS))).alias(name)
        for name, which in (("all", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic")))
    ]
    counts = cells(docs, labels, limits).groupBy("part").agg(*by_mask)
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = _orders()
        mask = np.arange(_MASKS)[:, None]
        bit, before = np.array([x[2] for x in orders]), np.array([x[3] for x in orders])
        fails, reached = mask & bit != 0, mask & before == 0
        removes = (fails & reached).astype(np.int64)
        figures = {
            "kept": (mask & (before | bit) == 0).astype(np.int64), "removed": removes, "redundant": (fails & ~reached).astype(np.int64),
            "unique_fails": (mask == bit).astype(np.int64), "shapley": removes @ (bit[:, None] == bit).astype(np.int64),
        }
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                table = {c: np.array(batch.column(c).to_pylist(), dtype=np.int64) for c in ("all", "good", "toxic")}
                out = {c: table["all"] @ m for c, m in figures.items()}
                out |= {"good_lost": table["good"] @ removes, "toxic_lost": table["toxic"] @ removes}
                k = batch.num_rows
                part = batch.column("part").take(pa.array(np.repeat(np.arange(k), len(orders))))
                columns = [part, pa.array([x[0] for x in orders] * k), pa.array([x[1] for x in orders] * k, pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(out[c].ravel()) for c in names)], names=["part", "filter_order", "step", *names])

    return counts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names))
