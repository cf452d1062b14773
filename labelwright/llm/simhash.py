"""SimHash near-duplicates by anchor points of a covering code.

A text's fingerprint has a bit set where over half of the hashes of its word shingles have it. Two fingerprints link if
they differ in at most ``within`` bits; components of links are the classes.

The anchors are the codewords of a covering code over the fingerprint: two Golay codes of 23 bits side by side, 2^24
anchors. Both are perfect: every word has one codeword within the radius of 3, its home. If x and y differ in e1 and e2
bits of the two parts, y is within 3 + e1 and 3 + e2 of x's home. So every fingerprint is sent to all anchors that it
reaches with at most ``within`` bits beyond the radius, summed over the parts (61 of them on average for 2), and an anchor
compares those at home there with all that came: no link is lost. An anchor at which very many meet, as a large group of
near copies makes, is refined: the 18 bits left have a covering code of their own (two Hamming codes of 7 bits and 4
plain bits), and fingerprints go on to its 2^12 anchors with what they have left of ``within``. An anchor sends a forest of
its links, not the links. Within an anchor, few fingerprints are compared one by one, many are looked up by flipped bits.

Scale: texts stay where they are; fingerprints (8 bytes) are made distinct before they are sent. Tasks count their own
crowded anchors; the driver gets at most 2 / ``crowded_share`` anchors. Components are found by alternating stars. A
fingerprint that more than ``common_share`` of all documents have gets its component by broadcast: at most 1 /
``common_share`` such fingerprints exist. All others are shuffled.

A null or empty text, or one without words, has fingerprint zero, which is linked like any other; with fewer words than a
shingle has, the whole sequence is the shingle. A null doc_id takes part and is no component's least; a component without
any doc_id has a null id. Repeated rows get equal results. A bit set in just half of the hashes is 0. An empty table gives
an empty result. Only doc_id and text are read. A text is one task's work, in some thirty times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import discard, map_batches, written
from .components import _labels, components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SEED = 42


@dataclass(frozen=True)
class Setting:
    shingle: int = 3
    within: int = 2
    #: Anchors that get over this share of all that is sent, and over this number of rows, are refined.
    crowded_share: float = 1 / 20_000
    crowded_rows: int = 4096
    #: Fingerprints of more than this share of the documents are joined by broadcast.
    common_share: float = 1 / 10_000
    #: Pairs compared at once; anchors with more rows than ``scan`` look links up instead.
    pairs: int = 1 << 21
    scan: int = 30_000
    #: Shingle hashes held at once, and rows of a task compared at once.
    hashes: int = 1 << 16
    rows: int = 1 << 19


def fingerprint(text: bytes, setting: Setting = Setting()) -> int:
    """SimHash of a text over the XXH64 (seed 42) of its shingles."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    k = min(setting.shingle, len(words))
    spans = list(zip((end - size)[: len(words) - k + 1].tolist(), end[k - 1 :].tolist()))
    set_bits, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(spans), setting.hashes):
        h = np.array([digest(joined[a:b], _SEED) for a, b in spans[at : at + setting.hashes]], dtype=">u8")
        set_bits += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(spans)).tobytes(), "big")


def fingerprints(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """doc_id and fp, the 64 bits of the fingerprint as a long, of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for piece in tk.slices(batch, "text"):
            t = tk.texts_of(piece.column("text"))
            out += [fingerprint(t.data[a:b].tobytes(), setting) for a, b in zip(t.offsets[:-1].tolist(), t.offsets[1:].tolist())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(out, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, "doc_id long, fp long")


@dataclass(frozen=True)
class Code:
    """A perfect cyclic code: its length, its generator as bits, its covering radius."""

    length: int
    generator: int
    radius: int

    @property
    def check_bits(self) -> int:
        return self.generator.bit_length() - 1

    @property
    def anchor_bits(self) -> int:
        return self.length - self.check_bits

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        """Remainder of the words, read as polynomials, by the generator."""
        x = x.copy()
        for bit in range(self.length - 1, self.check_bits - 1, -1):
            x ^= np.where(x >> bit & 1, self.generator << (bit - self.check_bits), 0)
        return x

    @cache
    def errors(self, beyond: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each syndrome the words of that syndrome within radius + beyond, the lightest first.

        Returns the words; where each syndrome begins; and up to where its words take at most 0, 1.. bits beyond the radius.
        """
        some = [sum(1 << b for b in bits) for n in range(self.radius + beyond + 1) for bits in combinations(range(self.length), n)]
        word = np.array(some, dtype=np.int64)
        over = np.maximum(np.bitwise_count(word).astype(np.int64) - self.radius, 0)
        s = self.syndrome(word)
        order = np.lexsort((word, over, s))
        place = s[order] * (beyond + 1) + over[order]
        ends = np.searchsorted(place, np.arange((beyond + 1) << self.check_bits), side="right").reshape(-1, beyond + 1)
        return word[order], np.r_[0, ends[:-1, -1]], ends


# Generators of the Golay code of length 23 and the Hamming code of length 7.
GOLAY = Code(23, 0b110001110101, 3)
HAMMING = Code(7, 0b1011, 1)
#: Every word of 4 bits is an anchor.
PLAIN = Code(4, 1, 0)

COARSE = (GOLAY, GOLAY)
FINE = (HAMMING, HAMMING, PLAIN)
_FINE_FROM = sum(c.length for c in COARSE)
_FINE_BITS = sum(c.anchor_bits for c in FINE)


def reach(fp: np.ndarray, codes: tuple[Code, ...], shift: int, left: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All anchors that the bits of fp from shift on reach with at most ``left`` bits beyond the radii.

    Returns the index of the fingerprint, the anchor, and what remains of left; a fingerprint is home where all remains.
    """
    row, anchor = np.arange(len(fp)), np.zeros(len(fp), dtype=np.int64)
    for code in codes:
        word, begin, ends = code.errors(within)
        part = (fp >> np.uint64(shift)).astype(np.int64) & ((1 << code.length) - 1)
        shift += code.length
        s = code.syndrome(part)[row]
        first, n = begin[s], ends[s, left] - begin[s]
        again = np.repeat(np.arange(len(row)), n)
        at = first[again] + np.arange(len(again)) - (np.cumsum(n) - n)[again]
        row, error = row[again], word[at]
        left = left[again] - np.maximum(np.bitwise_count(error).astype(np.int64) - code.radius, 0)
        anchor = anchor[again] << code.anchor_bits | (part[row] ^ error) >> code.check_bits
    return row, anchor, left


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[np.ndarray]:
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        for at in range(0, len(fp), rows):
            yield fp[at : at + rows]


def crowded(prints: DataFrame, setting: Setting) -> np.ndarray:
    """Anchors that get over the share of all rows sent, and over the number.

    A task tells of its anchors with over half that share of its own rows. Of an anchor over the share of all rows, tasks
    that don't tell hold less than half, so those told of make up the other half.
    """
    share, within = setting.crowded_share, setting.within

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, n, total = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 0
        held: list[np.ndarray] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate([anchor, *held]), return_inverse=True)
            more = np.concatenate([n, np.ones(sum(map(len, held)), dtype=np.int64)])
            return keys, np.bincount(place, weights=more, minlength=len(keys)).astype(np.int64)

        for fp in _pieces(batches):
            held.append(reach(fp, COARSE, 0, np.full(len(fp), within), within)[1])
            total += len(held[-1])
            if sum(map(len, held)) >= 1 << 22:
                anchor, n = merged()
                held = []
        if total:
            anchor, n = merged()
            told = n > total * share / 2
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, anchor[told]]), pa.array(np.r_[total, n[told]])], names=["anchor", "n"])

    told = written(prints.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")), "anchors")
    total = told.where("anchor = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(setting.crowded_rows, total * share) / 2
    # at most 2 / share anchors
    out = np.array(sorted(r.anchor for r in told.where((F.col("anchor") >= 0) & (F.col("n") > least)).collect()), dtype=np.int64)
    discard(told)
    return out


def replicas(prints: DataFrame, refined: np.ndarray, setting: Setting) -> DataFrame:
    """cell and fp: every fingerprint at every anchor it reaches, or at the finer anchors of a refined one; the last bit of cell is 1 at home."""
    within = setting.within

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp in _pieces(batches):
            row, anchor, left = reach(fp, COARSE, 0, np.full(len(fp), within), within)
            fine = np.isin(anchor, refined)
            cell = anchor << (_FINE_BITS + 1)
            some, sub, rest = reach(fp[row[fine]], FINE, _FINE_FROM, left[fine], within)
            cell = np.concatenate([cell[~fine], cell[fine][some] | 1 << _FINE_BITS | sub])
            left, out = np.concatenate([left[~fine], rest]), fp[np.concatenate([row[~fine], row[fine][some]])]
            yield pa.RecordBatch.from_arrays([pa.array(cell << 1 | (left == within)), pa.array(out.view(np.int64))], names=["cell", "fp"])

    return prints.mapInArrow(run, "cell long, fp long")


def _flips(within: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for n in range(1, within + 1) for bits in combinations(range(64), n)], dtype=np.uint64)


def near_pairs(fp: np.ndarray, home: np.ndarray, first: np.ndarray, setting: Setting) -> tuple[np.ndarray, np.ndarray]:
    """Rows a < b of one cell, one of them at home, whose fingerprints are within reach. Cells are rows first[c]:first[c+1]."""
    size = np.diff(first)
    big = size > setting.scan
    at_home = np.flatnonzero(home & ~np.repeat(big, size))
    cell = np.repeat(np.arange(len(size)), size)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    n = size[cell[at_home]]
    ends, i = np.cumsum(n), 0
    while i < len(at_home):
        before = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + setting.pairs, side="right")))
        a = np.repeat(at_home[i:j], n[i:j])
        b = np.repeat(first[cell[at_home[i:j]]], n[i:j]) + np.arange(len(a)) - np.repeat(np.cumsum(n[i:j]) - n[i:j], n[i:j])
        # two at home meet once
        hit = np.flatnonzero((np.bitwise_count(fp[a] ^ fp[b]) <= setting.within) & ((a < b) | ~home[b]) & (a != b))
        found.append((a[hit], b[hit]))
        i = j
    flips = _flips(setting.within)
    for c in np.flatnonzero(big):
        mine = np.arange(first[c], first[c + 1])
        mine = mine[np.argsort(fp[mine])]
        known = fp[mine]
        for a in np.array_split(mine[home[mine]], max(1, int(home[mine].sum()) * len(flips) // setting.pairs)):
            want = fp[a][:, None] ^ flips
            at = np.minimum(np.searchsorted(known, want), len(known) - 1)
            x, y = np.nonzero(known[at] == want)
            found.append((a[x], mine[at[x, y]]))
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *(x for x, _ in found)]), np.concatenate([none, *(y for _, y in found)])


def links(sent: DataFrame, setting: Setting) -> DataFrame:
    """a, b: fingerprints joined at some anchor; of the links found there a forest that joins the same ones."""

    def forest(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        first = np.r_[0, np.flatnonzero(np.diff(cell >> 1)) + 1, len(cell)]
        a, b = near_pairs(fp, (cell & 1).astype(bool), first, setting)
        node, root = _labels(a, b)
        joined = node != root
        return pa.RecordBatch.from_arrays([pa.array(fp[x[joined]].view(np.int64)) for x in (node, root)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def taken(whole: bool) -> tuple[np.ndarray, np.ndarray]:
            cell = np.concatenate([x.column("cell").to_numpy() for x in held])
            fp = np.concatenate([x.column("fp").to_numpy() for x in held]).view(np.uint64)
            # the last cell may go on in the next batch
            stop = len(cell) if whole else int(np.searchsorted(cell >> 1, cell[-1] >> 1))
            held.clear()
            if stop < len(cell):
                held.append(pa.RecordBatch.from_arrays([pa.array(cell[stop:]), pa.array(fp[stop:].view(np.int64))], names=["cell", "fp"]))
            return cell[:stop], fp[:stop]

        limit = setting.rows
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= limit:
                cell, fp = taken(False)
                # a cell larger than the limit waits for twice as many rows
                limit = max(setting.rows, 2 * sum(x.num_rows for x in held))
                if len(cell):
                    yield forest(cell, fp)
        if held:
            yield forest(*taken(True))

    dealt = sent.repartition(F.shiftright("cell", 1)).sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (least doc_id of the component) for every row of docs."""
    prints = written(fingerprints(docs, setting), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    common = F.col("n") > F.lit(setting.common_share * (classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
    distinct = classes.select("fp")
    edges = written(links(replicas(distinct, crowded(distinct, setting), setting), setting), "links")
    node_root = written(components(edges), "components")
    # fingerprints without a link are their own component
    linked = node_root.select("node", "root").union(node_root.select(F.col("root"), F.col("root")).distinct())
    members = linked.join(classes, F.col("node") == F.col("fp")).select("node", "root", "least")
    ids = members.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("id"))
    known = members.join(ids, F.col("root") == F.col("of")).select("node", "id")
    named = classes.join(known, F.col("fp") == F.col("node"), "left")
    component = F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("id")).alias("component_id")
    named = written(named.select(F.col("fp").alias("class"), component, common.alias("common")), "named")
    # at most 1 / common_share rows
    often, rest = F.broadcast(named.where("common")), named.where("not common")
    met = prints.join(often, F.col("fp") == F.col("class")).unionByName(prints.join(often, F.col("fp") == F.col("class"), "left_anti").join(rest, F.col("fp") == F.col("class")))
    return met.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
