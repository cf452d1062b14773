"""Substring dedup by super-k-mer partitioning.

A window is ``width`` consecutive words of one document. The minimiser of a window is the least hash among its m-word
grams; consecutive windows that share it travel as one packed string of words to the minimiser's bucket. There the
strings' windows are sorted by hash, equal hashes are confirmed byte by byte, and every window that also starts earlier
(smaller doc_id, or the same document and an earlier start) is marked. Words under a marked window are removed.

Scale: a window costs some 1/8 of a packed string rather than ``width`` words. Equal strings meet once per map block
(``block_bytes``), so a passage in a third of all documents reaches its bucket once per block, with its places. A
minimiser that many different strings share (a common line in many contexts) is found by a counting pass; its windows
travel by their own hash instead, which spreads them. At most ``crowded_keys`` such minimisers are broadcast, and none
below has more than the larger of ``crowded`` and its share of all strings. In that pass a minimiser seen once in a
block is counted by a 64th of its strings, 64-fold: it decides how windows travel, never what is found. Buckets and
tasks follow the bytes of all texts, ``task_bytes`` to a task. Marks come back as distinct word ranges keyed by
document; texts are shuffled once, compressed, for the join. A text is handled whole in one task, in some forty times
its bytes.

A null text has no words. A null doc_id is later than any other. Rows with the same doc_id are told apart by their
text: their windows at equal starts are no earlier than one another; rows equal in both get equal results, and ties are no others. Texts under
``width`` words lose nothing. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import shuffled, written

LAST = (1 << 63) - 1


def _squeeze(raw: bytes) -> bytes:
    """The size, then the compressed bytes."""
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _size(packed: bytes) -> int:
    return int.from_bytes(packed[:8], "little")


def _unsqueeze(packed: bytes) -> bytes:
    return pa.Codec("zstd").decompress(packed[8:], _size(packed), asbytes=True) if _size(packed) else b""



@dataclass(frozen=True)
class Setting:
    width: int = 20
    gram: int = 3
    block_bytes: int = 24 << 20
    #: Different strings of one minimiser, over all blocks, from which its windows travel singly; most such minimisers.
    crowded: int = 20_000
    crowded_keys: int = 1_000_000
    #: Bytes of text whose strings a task sorts, in buckets_per_task groups.
    task_bytes: int = 8 << 20
    buckets_per_task: int = 8


def joined(t: tk.Texts, w: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with words one space apart, and where each word starts and ends there."""
    keep = ~tk.SPACE[t.data]
    after = w.end[w.end < len(keep)]
    after = after[tk.SPACE[t.data[after]]]
    keep[after] = True
    place = np.zeros(len(keep) + 1, dtype=np.int64)
    np.cumsum(keep, out=place[1:])
    out = t.data[keep].copy()
    out[place[after]] = 32
    return out, place[w.start], place[w.end]


def _minima(g: np.ndarray, span: int) -> np.ndarray:
    """Least of g[i:i+span] for each i."""
    n, width, step = len(g) - span + 1, 1, g
    while width * 2 <= span:
        step = np.minimum(step[: len(step) - width], step[width:])
        width *= 2
    return np.minimum(step[:n], step[span - width : span - width + n])


@dataclass
class Strings:
    """Super-k-mers of a slice: minimiser, first word and one past the last word (of the slice), document."""

    key: np.ndarray
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray


def superkmers(w: tk.Words, h: np.ndarray, setting: Setting, crowded: np.ndarray | None = None) -> Strings:
    starts, doc = tk.window_docs(w, setting.width)
    if not len(starts):
        z = np.empty(0, dtype=np.int64)
        return Strings(z.astype(np.uint64), z, z, z)
    key = _minima(tk.ngram_hashes(h, setting.gram), setting.width - setting.gram + 1)[starts]
    if crowded is not None and len(crowded):
        at = np.minimum(np.searchsorted(crowded, key), len(crowded) - 1)
        single = crowded[at] == key
        key = np.where(single, tk.ngram_hashes(h, setting.width)[starts], key)
    new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]
    head = np.flatnonzero(new)
    tail = np.r_[head[1:], len(starts)] - 1
    return Strings(key[head], starts[head], starts[tail] + setting.width, doc[head])


def _count_minimisers(docs: DataFrame, setting: Setting) -> tuple[np.ndarray, int]:
    """Sorted minimisers of too many different strings, and the bytes of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, total = [], 0, 0

        def flush() -> pa.RecordBatch:
            pair = np.unique(np.concatenate(held), axis=0) if held else np.empty((0, 2), dtype=np.uint64)
            key, first, n = np.unique(pair[:, 0], return_index=True, return_counts=True)
            some = (n >= 2) | (tk.mix64(pair[first, 1]) % np.uint64(64) == 0)
            n = np.where(n == 1, 64, n)
            return pa.RecordBatch.from_arrays([pa.array([*key[some].view(np.int64), None], pa.int64()), pa.array(np.append(n[some], len(pair))), pa.array([0] * int(some.sum()) + [total], pa.int64())], names=["key", "n", "size"])

        for batch in batches:
            for piece in tk.slices(batch, "text"):
                t = tk.texts_of(piece.column("text"))
                w = tk.words_of(t)
                h = tk.hash_spans(t.data, w.start, w.end)
                s = superkmers(w, h, setting)
                total += len(t.data)
                if not len(s.key):
                    continue
                # a string is told by its two ends and its length here: a count, not a result
                ends = tk.ngram_hashes(h, setting.width)
                held.append(np.column_stack([s.key, tk.mix64(ends[s.first] ^ (ends[s.last - setting.width] * np.uint64(3)) ^ (s.last - s.first).astype(np.uint64))]))
                size += 3 * len(t.data)
                if size >= setting.block_bytes:
                    yield flush()
                    held, size, total = [], 0, 0
        yield flush()

    counts = written(docs.select("text").mapInArrow(run, "key long, n long, size long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("size").alias("size")), "minimisers")
    total = counts.where("key is null").first()
    if total is None:
        return np.empty(0, dtype=np.uint64), 0
    # strings / crowded_keys or more each: no more than crowded_keys of them
    least = max(setting.crowded, -(-total.n // setting.crowded_keys))
    keys = counts.where((F.col("n") >= least) & F.col("key").isNotNull()).select("key").collect()
    return np.sort(np.array([r.key for r in keys], dtype=np.int64).view(np.uint64)), total["size"]


def _pack(strings: list[bytes], counts: np.ndarray, doc: np.ndarray, text: np.ndarray, start: np.ndarray) -> bytes:
    sizes = np.array([len(s) for s in strings], dtype=np.int32)
    head = np.array([len(strings), len(doc)], dtype=np.int64)
    raw = b"".join([head.tobytes(), sizes.tobytes(), counts.astype(np.int32).tobytes(), doc.tobytes(), text.tobytes(), start.astype(np.int32).tobytes(), *strings])
    return _squeeze(raw)


def _unpack(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = _unsqueeze(blob)
    n, m = np.frombuffer(raw, np.int64, 2)
    at, parts = 16, []
    for kind, size in ((np.int32, n), (np.int32, n), (np.int64, m), (np.int64, m), (np.int32, m)):
        parts.append(np.frombuffer(raw, kind, size, at))
        at += np.dtype(kind).itemsize * int(size)
    ends = at + np.cumsum(parts[0], dtype=np.int64)
    return [raw[a:b] for a, b in zip([at, *ends[:-1].tolist()], ends.tolist())], *parts[1:]


def _packed(docs: DataFrame, setting: Setting, crowded: np.ndarray, buckets: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(crowded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        keys: list[np.ndarray] = []
        places: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not known:
                return
            key = np.concatenate(keys)
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            own, doc, text, start = (np.concatenate(x) for x in zip(*places))
            strings = list(known)
            by_string = np.argsort(bucket, kind="stable")
            rank = np.empty(len(strings), dtype=np.int64)
            rank[by_string] = np.arange(len(strings))
            order = np.argsort(rank[own], kind="stable")
            doc, text, start = doc[order], text[order], start[order]
            counts = np.bincount(own, minlength=len(strings))[by_string]
            first = np.r_[0, np.cumsum(counts)]
            cut = np.flatnonzero(np.r_[True, np.diff(bucket[by_string]) != 0, True])
            names, blobs = [], []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                x, y = int(first[a]), int(first[b])
                names.append(int(bucket[by_string[a]]))
                blobs.append(_pack([strings[i] for i in by_string[a:b].tolist()], counts[a:b], doc[x:y], text[x:y], start[x:y]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for piece in tk.slices(batch, "text"):
                t = tk.texts_of(piece.column("text"))
                w = tk.words_of(t)
                s = superkmers(w, tk.hash_spans(t.data, w.start, w.end), setting, shared.value)
                if not len(s.key):
                    continue
                norm, begin, end = joined(t, w)
                raw, fresh = norm.tobytes(), []
                own = np.empty(len(s.key), dtype=np.int64)
                for k, (a, b) in enumerate(zip(begin[s.first].tolist(), end[s.last - 1].tolist())):
                    string = raw[a:b]
                    n = len(known)
                    i = known.setdefault(string, n)
                    own[k] = i
                    if i == n:
                        fresh.append(k)
                        size += b - a
                keys.append(s.key[fresh])
                ids = piece.column("doc_key").to_numpy(zero_copy_only=False)
                texts = piece.column("text_key").to_numpy(zero_copy_only=False)
                places.append((own, ids[s.doc], texts[s.doc], s.first - w.first[s.doc]))
                if size >= setting.block_bytes or sum(len(p[0]) for p in places) > 1 << 20:
                    yield from flush()
                    known, keys, places, size = {}, [], [], 0
        yield from flush()

    return docs.mapInArrow(run, "bucket int, blob binary")


def _same(raw: bytes, a: np.ndarray, b: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Groups told apart by the bytes raw[a:b] of their members as well."""
    text = [raw[x:y] for x, y in zip(a.tolist(), b.tolist())]
    if all(g != h or s == u for g, h, s, u in zip(group[1:].tolist(), group[:-1].tolist(), text[1:], text[:-1])):
        return group
    known: dict[tuple[int, bytes], int] = {}
    return np.array([known.setdefault((g, s), len(known)) for g, s in zip(group.tolist(), text)], dtype=np.int64)


def marked(blobs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word ranges (doc_key, text_key, from, to) under windows of a bucket that also start earlier."""
    known: dict[bytes, int] = {}
    owns, docs, texts, starts = [], [], [], []
    for blob in blobs:
        strings, counts, doc, text, start = _unpack(blob)
        ids = np.array([known.setdefault(s, len(known)) for s in strings], dtype=np.int64)
        owns.append(np.repeat(ids, counts))
        docs.append(doc)
        texts.append(text)
        starts.append(start.astype(np.int64))
    own, doc, text, start = (np.concatenate(x) for x in (owns, docs, texts, starts))
    order = np.lexsort((start, doc, own))
    own, doc, text, start = own[order], doc[order], text[order], start[order]
    head = np.searchsorted(own, np.arange(len(known)))
    first_doc, first_start = doc[head], start[head]
    lead = (doc == first_doc[own]) & (start == first_start[own])

    strings = list(known)
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    raw = b"".join(strings)
    t = tk.Texts(np.frombuffer(raw, dtype=np.uint8), np.r_[0, np.cumsum(sizes)])
    w = tk.words_of(t)
    h = tk.hash_spans(t.data, w.start, w.end)
    windows = w.counts - width + 1
    at, string = tk.window_docs(w, width)
    key = tk.ngram_hashes(h, width)[at]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[1:] = same
    twice[:-1] |= same
    several = order[twice]
    late = np.zeros(len(key), dtype=bool)
    if len(several):
        group = np.cumsum(np.r_[True, key[several][1:] != key[several][:-1]])
        group = _same(raw, w.start[at[several]], w.end[at[several] + width - 1], group)
        d = first_doc[string[several]]
        p = first_start[string[several]] + at[several] - w.first[string[several]]
        o = np.lexsort((p, d, group))
        group, d, p = group[o], d[o], p[o]
        lead_at = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], np.arange(len(group)), 0))
        late[several[o]] = (d != d[lead_at]) | (p != p[lead_at])
    # runs of marked windows, for the places that come first
    edge = np.flatnonzero(late & np.r_[True, ~late[:-1] | (string[1:] != string[:-1])]) if len(late) else np.empty(0, dtype=np.int64)
    stop = np.flatnonzero(late & np.r_[~late[1:] | (string[1:] != string[:-1]), True]) if len(late) else edge
    out = []
    n_lead = np.bincount(own[lead], minlength=len(known))
    place = np.flatnonzero(lead)
    begin = np.r_[0, np.cumsum(n_lead)]
    times = n_lead[string[edge]]
    which = np.repeat(np.arange(len(edge)), times)
    pick = place[np.repeat(begin[string[edge]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)] if len(edge) else np.empty(0, dtype=np.int64)
    offset = at[edge[which]] - w.first[string[edge[which]]] if len(edge) else pick
    length = stop[which] - edge[which] + width if len(edge) else pick
    out.append((doc[pick], text[pick], start[pick] + offset, start[pick] + offset + length))
    # all later places of an equal string
    rest = np.flatnonzero(~lead)
    out.append((doc[rest], text[rest], start[rest], start[rest] + windows[own[rest]] - 1 + width))
    return tuple(np.concatenate(x) for x in zip(*out))


def _removed(packed: DataFrame, width: int) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        doc, text, lo, hi = marked(group.column("blob").to_pylist(), width)
        return pa.table({"doc_key": pa.array(doc), "text_key": pa.array(text), "lo": pa.array(lo.astype(np.int32)), "hi": pa.array(hi.astype(np.int32))})

    return packed.groupBy("bucket").applyInArrow(run, "doc_key long, text_key long, lo int, hi int")


def removed_ranges(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """doc_key, text_key and ranges: the distinct word ranges (lo, hi) to remove of each document that has some."""
    rows = _keyed(docs)
    crowded, size = _count_minimisers(rows, setting)
    tasks = max(shuffled(docs.sparkSession), -(-size // setting.task_bytes))
    packed = _packed(rows, setting, crowded, setting.buckets_per_task * tasks).repartition(tasks, "bucket")
    found = _removed(packed, setting.width)
    # repeated rows have equal ranges, which are kept once
    return found.groupBy("doc_key", "text_key").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_key"), F.xxhash64(text).alias("text_key"))


def _packed_texts(rows: DataFrame) -> DataFrame:
    """rows with the text compressed, document by document, for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [_squeeze((t.as_py() or "").encode()) for t in batch.column("text")]
            columns = [batch.column(c) for c in ("doc_id", "doc_key", "text_key")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())], names=["doc_id", "doc_key", "text_key", "packed"])

    return rows.mapInArrow(run, "doc_id long, doc_key long, text_key long, packed binary")


def _texts_again(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch with its texts, in bounded slices."""
    i = 0
    sizes = [_size(x.as_py()) for x in batch.column("packed")]
    while i < batch.num_rows:
        j, size = i, 0
        while j < batch.num_rows and (j == i or size + sizes[j] <= tk.SLICE_BYTES):
            size += sizes[j]
            j += 1
        part = batch.slice(i, j - i)
        texts = [_unsqueeze(x.as_py()) for x in part.column("packed")]
        text = pa.array(texts, pa.binary()).cast(pa.large_binary()).cast(pa.large_string())
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), text, part.column("lo"), part.column("hi")], names=["doc_id", "text", "lo", "hi"])
        i = j


def dedup(docs: DataFrame, setting: Setting = Setting(), with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept: the words left, one space apart) for every row of docs."""
    ranges = removed_ranges(docs, setting).select(F.col("doc_key").alias("r_doc"), F.col("text_key").alias("r_text"), F.col("ranges.lo").alias("lo"), F.col("ranges.hi").alias("hi"))
    rows = _packed_texts(_keyed(docs)).join(ranges, (F.col("doc_key") == F.col("r_doc")) & (F.col("text_key") == F.col("r_text")), "left").select("doc_id", "packed", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _texts_again(batch):
                t = tk.texts_of(piece.column("text"))
                w = tk.words_of(t)
                lo, hi = piece.column("lo"), piece.column("hi")
                times = np.array([len(x) if x.is_valid else 0 for x in lo], dtype=np.int64)
                gone = np.zeros(len(w.start), dtype=bool)
                if times.sum():
                    base = np.repeat(w.first[:-1], times)
                    a, b = base + lo.flatten().to_numpy(), base + hi.flatten().to_numpy()
                    edge = np.bincount(a, minlength=len(gone) + 1) - np.bincount(b, minlength=len(gone) + 1)
                    gone = np.cumsum(edge[:-1]) > 0
                norm, begin, end = joined(t, w)
                drop = np.zeros(len(norm) + 1, dtype=np.int64)
                if gone.any():
                    np.add.at(drop, begin[gone], 1)
                    # the space after a removed word goes with it
                    np.add.at(drop, np.minimum(end[gone] + ((end[gone] < len(norm)) & (norm[np.minimum(end[gone], len(norm) - 1)] == 32)), len(norm)), -1)
                keep = np.cumsum(drop[:-1]) == 0
                left = norm[keep].tobytes()
                kept_before = np.r_[0, np.cumsum(keep)]
                # a document's bytes begin with its first word and end before the next one's
                bounds = np.r_[begin, len(norm)][w.first]
                cut = kept_before[bounds].tolist()
                kept = [left[x:y].rstrip(b" ") for x, y in zip(cut[:-1], cut[1:])]
                columns = [piece.column("doc_id"), pa.array(w.counts), pa.array(tk.per_doc(gone.astype(np.int64), w.first)), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
                if with_text:
                    columns.append(pa.array([k.decode("utf-8") for k in kept], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
