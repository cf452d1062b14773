"""LM scoring by cross-entropy difference.

Two bigram models over every word of the corpus: the target model counts the target documents, the background model all
documents. Every document gets its mean loss per token under both, and the difference: lower is closer to the target.

``score_corpus`` keeps no fixed vocabulary. Unigrams give ``discount`` of each count to all words alike; bigrams are
smoothed by ``prior`` tokens of the unigram, background counts scaled to the target's token mass, so that both are
smoothed alike. A document's own counts are left out of the models that score it: else the background, which holds
every document, would know its rare words by heart and the target would not.

Scale: tables of (64-bit hash, counts) grow with the corpus and stay spread. Texts are read once into blocks of tokens. A
block sends each distinct word and bigram once, packed by range of hashes, so a common one is no hot key; a range sums
what it got and sends each block the totals of its own entries; with those a block scores its documents. Target flags
join on ids alone. The driver gets one row of totals.

``train`` and ``score`` are the bounded model: the ``vocabulary`` most frequent words, shape classes (length, first and
last character) for all others, and two dense tables of its square on the driver and broadcast.

A null or empty text has no tokens and null losses. An empty target leaves uniform target probabilities. Repeated rows
count as often as they occur; a target doc_id listed twice counts once. An empty table gives an empty result. Rows with
a null doc_id are scored and belong to the background. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import shuffled, written, written_by

#: Length buckets x first character kinds x last character kinds of the classes.
_LENGTHS, _FIRST, _LAST = 8, 3, 5
CLASSES = _LENGTHS * _FIRST * _LAST


@dataclass(frozen=True)
class Setting:
    vocabulary: int = 1800
    #: Strength of the unigram prior in a context, in tokens.
    prior: float = 20.0
    #: Words held before a task sends its counts.
    block_words: int = 6_000_000
    #: Contexts summed together, and salts of the first sum.
    context_block: int = 64
    salts: int = 4
    #: Taken off each word's count and given to all words alike.
    discount: float = 0.75
    #: Words of a block of documents, and most and least tokens that a range of hashes is sized for.
    tokens_block: int = 800_000
    range_entries: int = 4_000_000
    least_entries: int = 250_000


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    first, last = np.full(256, 2), np.full(256, 4)
    first[65:91], first[97:123], first[128:] = 0, 1, 1
    last[65:91], last[97:123], last[128:] = 0, 1, 1
    last[48:58] = 2
    last[[44, 46]] = 3
    return first, last


_FIRST_KIND, _LAST_KIND = _kinds()


def word_hashes(t: tk.Texts) -> tuple[tk.Words, np.ndarray, np.ndarray]:
    """Words, their hashes, and the shape class of each."""
    w = tk.words_of(t)
    h = tk.hash_spans(t.data, w.start, w.end)
    length = np.minimum(w.end - w.start, 2 * _LENGTHS) - 1
    shape = (length // 2 * _FIRST + _FIRST_KIND[t.data[w.start]]) * _LAST + _LAST_KIND[t.data[w.end - 1]]
    return w, h, shape.astype(np.int64)


@dataclass
class Vocabulary:
    hashes: np.ndarray
    maybe: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray) -> Vocabulary:
        maybe = np.zeros(1 << 20, dtype=bool)
        maybe[hashes >> np.uint64(44)] = True
        return cls(np.sort(hashes), maybe)

    @property
    def size(self) -> int:
        """Words, classes, and the start of a document as a context."""
        return len(self.hashes) + CLASSES + 1

    def ids(self, h: np.ndarray, shape: np.ndarray) -> np.ndarray:
        out = shape + len(self.hashes)
        near = np.flatnonzero(self.maybe[h >> np.uint64(44)])
        if len(near) and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h[near]), len(self.hashes) - 1)
            hit = self.hashes[at] == h[near]
            out[near[hit]] = at[hit]
        return out

    def bigrams(self, w: tk.Words, ids: np.ndarray) -> np.ndarray:
        """Context of each word times size, plus the word."""
        context = np.r_[self.size - 1, ids[:-1]] if len(ids) else ids
        head = w.first[:-1][w.counts > 0]
        context[head] = self.size - 1
        return context * self.size + ids


def build_vocabulary(docs: DataFrame, setting: Setting) -> Vocabulary:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

        for batch in batches:
            for piece in tk.slices(batch, "text"):
                t = tk.texts_of(piece.column("text"))
                w = tk.words_of(t)
                held.append(tk.hash_spans(t.data, w.start, w.end))
                size += len(held[-1])
                if size >= setting.block_words:
                    yield flush()
                    held, size = [], 0
        yield flush()

    counts = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(setting.vocabulary).collect()
    return Vocabulary.of(np.array([r.word for r in top], dtype=np.int64).view(np.uint64))


def _pack(cells: np.ndarray, counts: np.ndarray) -> bytes:
    raw = cells.astype(np.int32).tobytes() + counts.astype(np.int64).tobytes()
    return len(cells).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], 12 * n, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.int32, n), np.frombuffer(raw, np.int64, n, 4 * n)


def count_bigrams(docs: DataFrame, vocabulary: Vocabulary, setting: Setting) -> np.ndarray:
    """Counts by context and word over all texts of docs."""
    size, block = vocabulary.size, setting.context_block
    cells = block * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, salt = [], 0, 0

        def flush() -> pa.RecordBatch:
            cell, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
            cut = np.searchsorted(cell, np.arange(0, size + block, block) * size)
            some = [k for k in range(len(cut) - 1) if cut[k + 1] > cut[k]]
            blobs = [_pack(cell[cut[k] : cut[k + 1]] - k * cells, n[cut[k] : cut[k + 1]]) for k in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([salt] * len(some), pa.int32()), pa.array(blobs, pa.binary())], names=["block", "salt", "blob"])

        for batch in batches:
            for piece in tk.slices(batch, "text"):
                w, h, shape = word_hashes(tk.texts_of(piece.column("text")))
                held.append(vocabulary.bigrams(w, vocabulary.ids(h, shape)))
                words += len(h)
                if len(h):
                    salt = int(h[0] % np.uint64(setting.salts))
                if words >= setting.block_words:
                    yield flush()
                    held, words = [], 0
        yield flush()

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(cells, dtype=np.int64)
        for blob in group.column("blob"):
            cell, n = _unpack(blob.as_py())
            total[cell] += n
        some = np.flatnonzero(total)
        return pa.table({"block": group.column("block").slice(0, 1).cast(pa.int32()), "blob": pa.array([_pack(some, total[some])], pa.binary())})

    packed = docs.select("text").mapInArrow(run, "block int, salt int, blob binary")
    summed = packed.groupBy("block", "salt").applyInArrow(add, "block int, blob binary").groupBy("block").applyInArrow(add, "block int, blob binary")
    out = np.zeros(size * size, dtype=np.int64)
    for r in summed.toLocalIterator():
        cell, n = _unpack(bytes(r.blob))
        out[cell + r.block * cells] += n
    return out.reshape(size, size)


def losses(counts: np.ndarray, scale: float, prior: float) -> np.ndarray:
    """-log of the interpolated bigram probabilities. The last row is the start context; it is never a word."""
    n = counts * scale
    word = n.sum(axis=0)
    size = len(word) - 1
    unigram = (word + 1.0 / size) / (word.sum() + 1.0)
    context = n.sum(axis=1)
    return -np.log((n + prior * unigram[None]) / (context[:, None] + prior)).astype(np.float32)


def train(docs: DataFrame, target_ids: DataFrame, setting: Setting = Setting()) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """Vocabulary and the losses of the target and background models. target_ids: doc_id of the target documents."""
    vocabulary = build_vocabulary(docs, setting)
    ids = target_ids.select(F.col("doc_id").cast("long").alias("t_id")).where("t_id is not null").distinct()
    # the target grows with the corpus: a shuffled join at every size
    target = count_bigrams(docs.select("doc_id", "text").join(ids.hint("merge"), F.col("doc_id") == F.col("t_id")), vocabulary, setting)
    background = count_bigrams(docs, vocabulary, setting)
    scale = float(target.sum()) / max(float(background.sum()), 1.0)
    return vocabulary, losses(target, 1.0, setting.prior), losses(background, scale, setting.prior)


def score(docs: DataFrame, vocabulary: Vocabulary, target: np.ndarray, background: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score for every row of docs."""
    # bounded by the vocabulary: two float tables of its square
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, np.stack([target.ravel(), background.ravel()])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, tables = shared.value
        for batch in batches:
            n, sums = [], []
            for piece in tk.slices(batch, "text"):
                w, h, shape = word_hashes(tk.texts_of(piece.column("text")))
                cell = vocabulary.bigrams(w, vocabulary.ids(h, shape))
                n.append(w.counts)
                sums.append(np.stack([tk.per_doc(table[cell].astype(np.float64), w.first) for table in tables]))
            if not n:
                continue
            n, sums = np.concatenate(n), np.concatenate(sums, axis=1)
            mean = sums / np.maximum(n, 1)
            none = n == 0
            columns = [pa.array(x, pa.float64(), mask=none) for x in (*mean, mean[0] - mean[1])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), *columns], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


#: Stands before the first word of a document; the greatest hash, so that it sorts last.
_START = np.uint64(2**64 - 1)
_WORD, _PAIR = 0, 1


def _squeeze(x: np.ndarray) -> bytes:
    """Byte planes of the numbers, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(x).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if len(x) else b"")


def _unsqueeze(blob: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.empty(0, dtype=kind)
    planes = pa.decompress(blob[8:], n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).reshape(-1).view(kind)


def _squeeze_keys(keys: np.ndarray) -> bytes:
    """Ascending hashes as differences."""
    return _squeeze(np.diff(keys, prepend=np.uint64(0)))


def _unsqueeze_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_unsqueeze(blob, np.uint64), dtype=np.uint64)


def token_blocks(docs: DataFrame, setting: Setting) -> DataFrame:
    """Documents in blocks: their ids and word counts, the distinct word hashes, and each token's place among these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids, counts, held, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            words, codes = np.unique(np.concatenate(held), return_inverse=True)
            columns = [pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([np.concatenate(counts)], pa.list_(pa.int64())), pa.array([size], pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([_squeeze_keys(words)], pa.binary()), pa.array([_squeeze(codes.astype(np.int32))], pa.binary())], names=["block", "ids", "counts", "size", "words", "codes"])

        for batch in batches:
            for piece in tk.slices(batch, "text"):
                t = tk.texts_of(piece.column("text"))
                w = tk.words_of(t)
                ids += piece.column("doc_id").to_pylist()
                counts.append(w.counts.astype(np.int64))
                held.append(tk.hash_spans(t.data, w.start, w.end))
                size += len(held[-1])
                if size >= setting.tokens_block:
                    yield flush()
                    block += 1
                    ids, counts, held, size = [], [], [], 0
        if ids:
            yield flush()

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(run, "block long, ids array<long>, counts array<long>, size long, words binary, codes binary")


@dataclass
class Tokens:
    """A block's tokens: place of each word and of its context among hashes (the last is the start), document, and bigram."""

    hashes: np.ndarray
    word: np.ndarray
    context: np.ndarray
    doc: np.ndarray
    pairs: np.ndarray
    pair: np.ndarray

    @classmethod
    def of(cls, words: bytes, codes: bytes, counts: np.ndarray) -> Tokens:
        hashes = np.r_[_unsqueeze_keys(words), _START]
        word = _unsqueeze(codes, np.int32).astype(np.int64)
        context = np.r_[len(hashes) - 1, word[:-1]] if len(word) else word
        context[(np.cumsum(counts) - counts)[counts > 0]] = len(hashes) - 1
        pairs, pair = np.unique(tk.mix64(tk.mix64(hashes[context]) + hashes[word]), return_inverse=True)
        return cls(hashes, word, context, np.repeat(np.arange(len(counts)), counts), pairs, pair)


def target_rows(blocks: DataFrame, target_ids: DataFrame) -> DataFrame:
    """block, at: the rows of the target documents."""
    ids = target_ids.select(F.col("doc_id").cast("long").alias("t_id")).where("t_id is not null").distinct()
    # the target grows with the corpus: a shuffled join of ids at every size
    return blocks.select("block", F.posexplode("ids").alias("at", "id")).join(ids.hint("merge"), F.col("id") == F.col("t_id")).select("block", "at")


def gather_counts(blocks: DataFrame, target_ids: DataFrame, parts: int) -> DataFrame:
    """Totals over the corpus of the words and bigrams of each block, by range of hashes: one row a block and range.

    Words have their counts in background and target, and those as a context; bigrams have the first two. The first
    row of a range also has its number of words, those in the target, and the tokens of target and background.
    """
    found = target_rows(blocks, target_ids)
    found = found.groupBy(F.col("block").alias("t_block")).agg(F.collect_list("at").alias("hits"))
    rows = blocks.join(found.hint("merge"), F.col("block") == F.col("t_block"), "left").select("block", "counts", "words", "codes", "hits")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, counts, words, codes, hits = (batch.column(c)[i] for c in ("block", "counts", "words", "codes", "hits"))
                counts = counts.values.to_numpy()
                t = Tokens.of(words.as_py(), codes.as_py(), counts)
                flag = np.zeros(len(counts), dtype=bool)
                flag[hits.as_py() or []] = True
                own = flag[t.doc]
                n, m = len(t.hashes), len(t.pairs)
                tables = [
                    (_WORD, t.hashes, [np.bincount(x, minlength=n) for x in (t.word, t.word[own], t.context, t.context[own])]),
                    (_PAIR, t.pairs, [np.bincount(x, minlength=m) for x in (t.pair, t.pair[own])]),
                ]
                for kind, keys, columns in tables:
                    # keys ascend, and so do their ranges
                    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                    head = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
                    some, spans = part[head].astype(np.int64).tolist(), list(zip(head.tolist(), [*head[1:].tolist(), len(part)]))
                    blobs = [_squeeze_keys(keys[x:y]) for x, y in spans]
                    numbers = [_squeeze(np.concatenate([c[x:y] for c in columns]).astype(np.int64)) for x, y in spans]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array([block.as_py()] * len(some), pa.int64()), pa.array(blobs, pa.binary()), pa.array(numbers, pa.binary())],
                        names=["kind", "part", "block", "keys", "counts"],
                    )

    def total(group: pa.Table) -> pa.Table:
        kind = group.column("kind")[0].as_py()
        width = 4 if kind == _WORD else 2
        keys = [_unsqueeze_keys(x.as_py()) for x in group.column("keys")]
        size = [len(k) for k in keys]
        numbers = np.concatenate([_unsqueeze(x.as_py(), np.int64).reshape(width, -1) for x in group.column("counts")], axis=1)
        keys, place = np.unique(np.concatenate(keys), return_inverse=True)
        # exact below 2^53
        sums = np.stack([np.bincount(place, weights=x, minlength=len(keys)).astype(np.int64) for x in numbers])
        ends = np.cumsum(size)
        blobs = [_squeeze(np.ascontiguousarray(sums[:, place[b - n : b]]).reshape(-1)) for b, n in zip(ends, size)]
        figures = [0] * 4
        if kind == _WORD:
            figures = [int((keys != _START).sum()), int((sums[1] > 0).sum()), int(sums[1].sum()), int(sums[0].sum())]
        columns = [pa.array([x] + [0] * (len(size) - 1), pa.int64()) for x in figures]
        names = ["kind", "part", "block", "totals", "words", "target_words", "target", "background"]
        return pa.Table.from_arrays([*(group.column(c) for c in ("kind", "part", "block")), pa.array(blobs, pa.binary()), *columns], names=names)

    sent = rows.mapInArrow(send, "kind int, part int, block long, keys binary, counts binary")
    return sent.groupBy("kind", "part").applyInArrow(total, "kind int, part int, block long, totals binary, words long, target_words long, target long, background long")


def _occurrences(doc: np.ndarray, what: np.ndarray) -> np.ndarray:
    """How often each token's own document has the same thing."""
    if not len(what):
        return what
    _, place, n = np.unique(doc * (int(what.max()) + 1) + what, return_inverse=True, return_counts=True)
    return n[place]


def _token_losses(n: np.ndarray, context: np.ndarray, pair: np.ndarray, tokens: np.ndarray, types: int, words: int, scale: float, setting: Setting) -> np.ndarray:
    """-log of the interpolated probability of each token: counts of its word, context and bigram, and tokens of the model."""
    unigram = np.where(tokens > 0, (np.maximum(n - setting.discount, 0) + setting.discount * types / words) / np.maximum(tokens, 1), 1.0 / words)
    return -np.log((pair * scale + setting.prior * unigram) / (context * scale + setting.prior))


def score_blocks(blocks: DataFrame, totals: DataFrame, target_ids: DataFrame, setting: Setting) -> DataFrame:
    f = totals.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "target_words", "target", "background"))).first()
    words, target_words, target, background = int(f.words), int(f.target_words), int(f.target), int(f.background)
    scale = target / max(background, 1)
    hits = target_rows(blocks, target_ids).select("block", F.lit(-1).alias("kind"), F.col("at").cast("int").alias("part"), F.lit(None).cast("binary").alias("totals"))
    known = totals.select("block", "kind", "part", "totals").unionByName(hits)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.slice(0, 1).to_pylist()[0]
        counts = np.array(row["counts"], dtype=np.int64)
        t = Tokens.of(row["words"], row["codes"], counts)
        kind, part = right.column("kind").to_numpy(), right.column("part").to_numpy()
        blobs = right.column("totals")

        def of(k: int, width: int) -> np.ndarray:
            at = np.flatnonzero(kind == k)
            at = at[np.argsort(part[at])]
            return np.concatenate([np.empty((width, 0), dtype=np.int64), *(_unsqueeze(blobs[int(i)].as_py(), np.int64).reshape(width, -1) for i in at)], axis=1)

        word, pair = of(_WORD, 4), of(_PAIR, 2)
        flag = np.zeros(len(counts), dtype=np.int64)
        flag[part[kind == -1]] = 1
        less = _occurrences(t.doc, t.word), _occurrences(t.doc, t.context), _occurrences(t.doc, t.pair), counts[t.doc]
        bounds = np.r_[0, np.cumsum(counts)]
        mean = []
        for model, all_tokens, types, own, s in ((1, target, target_words, flag[t.doc], 1.0), (0, background, words, 1, scale)):
            loss = _token_losses(
                word[model][t.word] - own * less[0], word[2 + model][t.context] - own * less[1], pair[model][t.pair] - own * less[2], all_tokens - own * less[3], types, max(words, 1), s, setting
            )
            mean.append(tk.per_doc(loss, bounds) / np.maximum(counts, 1))
        columns = [pa.array(x, pa.float64(), mask=counts == 0) for x in (*mean, mean[0] - mean[1])]
        return pa.Table.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(counts), *columns], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    left = blocks.select("block", "ids", "counts", "words", "codes").groupBy("block")
    return left.cogroup(known.groupBy("block")).applyInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def score_corpus(docs: DataFrame, target_ids: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score for every row of docs, over all of its words."""
    blocks = written_by(token_blocks(docs, setting), "blocks", "block")
    tokens = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(1, min(shuffled(docs.sparkSession), tokens // setting.least_entries), -(-tokens // setting.range_entries))
    totals = written(gather_counts(blocks, target_ids, parts), "totals")
    return score_blocks(blocks, totals, target_ids, setting)
