"""Vectorised text primitives shared by the training-data operators.

Everything here works on the raw UTF-8 buffer of an Arrow string column, a bounded slice of documents at a time, so
no Python string is built per word. A *word* is a maximal run of bytes other than the six ASCII white-space
characters, which is the same thing as the pattern ``[^\\x20\\x09-\\x0D]+`` over code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LINE_END = np.zeros(256, dtype=bool)
LINE_END[10] = True
#: Bytes of text handled at once; temporaries take some thirty times this.
SLICE_BYTES = 1 << 20
_BASE = 0x9E6C63D0876A9A47
_STEP = 0xD1342543DE82EF95
_U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.full(n, _BASE, dtype=_U64)
    base[0] = 1
    inverse = np.full(n, pow(_BASE, -1, 1 << 64), dtype=_U64)
    inverse[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(inverse)


def _hash_piece(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = 1 << max(16, int(len(data)).bit_length())
    power, inverse = _powers(n)
    running = np.empty(len(data) + 1, dtype=_U64)
    running[0] = 0
    np.cumsum((data.astype(_U64) + _U64(1)) * power[: len(data)], out=running[1:])
    h = (running[end] - running[start]) * inverse[start]
    return mix64(h + (end - start).astype(_U64) * _U64(_STEP))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; spans sorted by start, cut into bounded pieces of the buffer."""
    if not len(start):
        return np.empty(0, dtype=_U64)
    if end[-1] - start[0] <= 2 * SLICE_BYTES:
        lo, hi = int(start[0]), int(end.max())
        return _hash_piece(data[lo:hi], start - lo, end - lo)
    out, i = np.empty(len(start), dtype=_U64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + SLICE_BYTES)))
        lo, hi = int(start[i]), int(end[i:j].max())
        out[i:j] = _hash_piece(data[lo:hi], start[i:j] - lo, end[i:j] - lo)
        i = j
    return out


@dataclass
class Texts:
    """A slice of documents: UTF-8 bytes, and the offset where each document begins (one more at the end)."""

    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def texts_of(column: pa.Array) -> Texts:
    """Bytes and offsets of a string column; a null reads as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    lo = int(offsets[0]) if len(offsets) else 0
    hi = int(offsets[-1]) if len(offsets) else 0
    return Texts(raw[lo:hi], offsets - lo)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``limit`` bytes of text, or of one longer document."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, i = np.cumsum(sizes), 0
    while i < len(ends):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + limit, side="right")))
        j = min(j, i + 4096)
        yield batch.slice(i, j - i)
        i = j


@dataclass
class Words:
    """Word spans in a slice; document d owns words first[d]:first[d+1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words_of(t: Texts, separators: np.ndarray = SPACE) -> Words:
    """Maximal runs without a separator inside each document (with LINE_END: its lines that aren't empty)."""
    solid = ~separators[t.data]
    begins, closes = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    inner = t.offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(solid))]
    begins[inner] = solid[inner]
    closes[inner - 1] = solid[inner - 1]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(closes) + 1, np.searchsorted(start, t.offsets))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each position of h (len(h) - n + 1 of them), by doubling."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, dtype=_U64)
    out, have, width, step = None, 0, 1, h
    power = _STEP
    left = n
    while True:
        if left & 1:
            if out is None:
                out, have = step, width
            else:
                k = len(h) - have - width + 1
                out = out[:k] + _U64(pow(_STEP, have, 1 << 64)) * step[have : have + k]
                have += width
        left >>= 1
        if not left:
            break
        k = len(step) - width
        step = step[:k] + _U64(power) * step[width : width + k]
        power = power * power % (1 << 64)
        width *= 2
    return mix64(out[:m])


def window_docs(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start words of the n-word windows that lie inside one document, and their documents."""
    counts = np.maximum(w.counts - n + 1, 0)
    total = int(counts.sum())
    doc = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(before, counts) + np.repeat(w.first[:-1], counts), doc


def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[d]:bounds[d+1]]; empty ranges give 0."""
    running = np.zeros(len(values) + 1, dtype=np.int64 if values.dtype != np.float64 else np.float64)
    np.cumsum(values, out=running[1:])
    return running[bounds[1:]] - running[bounds[:-1]]


def doc_keys(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes made distinct between documents."""
    return mix64(h ^ mix64(doc.astype(_U64) + _U64(1)))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose key occurs twice or more, and all but one position of each such key."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice, later = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    twice[1:], later[1:] = same, same
    twice[:-1] |= same
    return order[twice], order[later]


def covered(starts: np.ndarray, width: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in some start:start+width."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + width, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


_CORE = np.zeros(256, dtype=bool)
_CORE[48:58] = _CORE[65:91] = _CORE[97:123] = True
_CORE[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes in lower case, for ASCII and Latin-1 letters."""
    out = _LOWER[data]
    after = np.zeros(len(data), dtype=bool)
    after[1:] = data[:-1] == 0xC3
    big = after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    out[big] += 32
    return out


def cores(t: Texts, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words with a letter or digit: their indices, and the spans without marks at either end."""
    solid = _CORE[t.data]
    before = np.zeros(len(solid) + 1, dtype=np.int64)
    np.cumsum(solid, out=before[1:])
    place = np.flatnonzero(solid)
    lo, hi = before[w.start], before[w.end]
    has = np.flatnonzero(hi > lo)
    return has, place[lo[has]], place[hi[has] - 1] + 1
