"""N-gram Jaccard join by a MinHash LSH forest.

Texts become sets of word 5-grams. Equal word sequences are one text from then on, a node. A signature is ``trees``
keys of ``depth`` levels, each level a byte of one min-hash. The keys of a tree, sorted, are a prefix trie: neighbours
share the longest prefixes. Matched prefixes are shortened level by level, from the full depth, until the measured
recall reaches the target: every 16th text is set against a copy of itself thinned to the threshold, and the levels at
which the two meet are counted. Texts that meet under a prefix are candidates; each joins the first text of its deepest
shared prefix, and that one the first of the next shorter prefix, so a trie of n texts gives fewer than n edges.

Exact verification goes by components of these edges. A component of one block (``block`` texts, ``block_words`` words)
is verified as a whole. In a larger one, which chains of look-alikes may have made, the edges are verified first;
texts are then compared inside components of true links, block by block, and else only where a prefix holds texts of
several such components, each pair under the first prefix it shares. Only counts leave a task.

Scale: signatures are made where texts are read; the trie holds 20 bytes a text and tree, range-partitioned by whole
keys, so a prefix shared by a third of all texts spans as many tasks as its rows need (tasks are stitched by one row
each); components are found without collecting; only texts with a candidate have their sets shuffled, once per block
they meet. A group of n different near copies needs n / block copies of each set and n^2 comparisons, which is what
counting its links exactly takes. A text is handled whole in one task, in some 60 times its bytes; a group's sets hold
8 bytes a word.

Texts of 1 to 4 words are one gram of all their words. A null or wordless text has no links and is a class of its own.
Repeated rows count as copies: n_links counts the other rows at similarity >= threshold, copies included. A class is
named by its least doc_id; where rows share a doc_id but not a class, all but one of the classes that this would name
alike get negative names of their own. A null doc_id is later than any other; a class of such rows alone is named null.
An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import WORD, map_batches, shuffled, written
from .components import components

LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Setting:
    gram: int = 5
    threshold: float = 0.8
    trees: int = 16
    depth: int = 8
    recall: float = 0.995
    block: int = 512
    block_words: int = 4_000_000
    #: One text in so many is a probe of recall; the expected recall counts as this many probes more.
    probe: int = 16
    prior_probes: int = 1000
    seed: int = 20

    def expected(self, level: int) -> float:
        """Share of pairs at the threshold that meet under some prefix of that many levels, as theory has it."""
        return 1 - (1 - self.threshold**level) ** self.trees

    def stop(self, reached: dict[int, int]) -> int:
        """The level at which shortening ends: the longest prefix with the target recall. reached: probes by their deepest level."""
        n = sum(reached.values()) + self.prior_probes
        for level in range(self.depth, 1, -1):
            hits = sum(c for deepest, c in reached.items() if deepest >= level)
            if hits + self.prior_probes * self.expected(level) >= self.recall * n:
                return level
        return 1


def shingles(t: tk.Texts, gram: int) -> tuple[tk.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words and word hashes, and the gram hashes with their documents; a shorter text is one gram."""
    w = tk.words_of(t)
    h = tk.hash_spans(t.data, w.start, w.end)
    starts, doc = tk.window_docs(w, gram)
    g = tk.ngram_hashes(h, gram)[starts] if len(starts) else np.empty(0, dtype=np.uint64)
    parts, docs = [g], [doc]
    for n in range(1, gram):
        own = np.flatnonzero(w.counts == n)
        if len(own):
            parts.append(tk.mix64(tk.ngram_hashes(h, n)[w.first[own]] + np.uint64(n)))
            docs.append(own)
    g, doc = np.concatenate(parts), np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    return w, h, g[order], doc[order]


def signatures(g: np.ndarray, doc: np.ndarray, setting: Setting) -> tuple[np.ndarray, np.ndarray]:
    """Documents with grams, and their keys: a row of ``trees`` 64-bit integers, first level in the top byte."""
    head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, dtype=np.int64)
    x = (g >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(setting.seed)
    a = rng.integers(0, 1 << 31, setting.trees * setting.depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, setting.trees * setting.depth, dtype=np.uint32)
    keys = np.zeros((len(head), setting.trees), dtype=np.uint64)
    if not len(head):
        return head, keys
    v = np.empty_like(x)
    for k in range(setting.trees * setting.depth):
        np.multiply(x, a[k], out=v)
        np.add(v, b[k], out=v)
        least = np.minimum.reduceat(v, head)
        level = ((least * np.uint32(0x9E3779B1)) ^ least) >> np.uint32(24)
        tree, at = divmod(k, setting.depth)
        keys[:, tree] |= level.astype(np.uint64) << np.uint64(56 - 8 * at)
    return doc[head], keys


def text_keys(w: tk.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each document's word sequence."""
    place = tk.mix64((np.arange(len(h)) - np.repeat(w.first[:-1], w.counts)).astype(np.uint64))
    out = []
    for salt in (0x1F123BB5, 0x7A646E4D):
        v = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(tk.mix64(h * np.uint64(2 * salt + 1) ^ place), out=v[1:])
        out.append((v[w.first[1:]] - v[w.first[:-1]]).view(np.int64))
    return out[0], out[1]


def thinned(g: np.ndarray, doc: np.ndarray, chosen: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For the chosen documents, as many of their distinct grams as leave the similarity just at the threshold."""
    parts, docs = [], []
    for d in chosen.tolist():
        lo, hi = np.searchsorted(doc, [d, d + 1])
        own = np.unique(g[lo:hi])
        some = own[np.argsort(tk.mix64(own + np.uint64(1)))[: int(np.ceil(threshold * len(own)))]]
        parts.append(some)
        docs.append(np.full(len(some), d))
    return np.concatenate(parts), np.concatenate(docs)


def deepest(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Levels of the longest prefix that two signatures (rows of keys) share in some tree."""
    out = np.zeros(len(a), dtype=np.int64)
    for level in range(1, depth + 1):
        out += ((a ^ b) >> np.uint64(64 - 8 * level) == 0).any(axis=1)
    return out


def signed(docs: DataFrame, setting: Setting) -> DataFrame:
    """doc_id, tx (the text), k1, k2 (its word sequence), n_words, keys (null without words) and probe for every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        k1s, k2s, sizes, keys, probes = [], [], [], [], []
        for piece in tk.slices(batch, "text"):
            t = tk.texts_of(piece.column("text"))
            w, h, g, doc = shingles(t, setting.gram)
            k1, k2 = text_keys(w, h)
            own, k = signatures(g, doc, setting)
            rows: list[bytes | None] = [None] * t.n
            for d, row in zip(own.tolist(), k):
                rows[d] = row.tobytes()
            probe: list[int | None] = [None] * t.n
            chosen = np.flatnonzero((k1[own].view(np.uint64) % np.uint64(setting.probe) == 0) & (w.counts[own] >= 50))
            if len(chosen):
                _, thin = signatures(*thinned(g, doc, own[chosen], setting.threshold), setting)
                for d, level in zip(own[chosen].tolist(), deepest(k[chosen], thin, setting.depth).tolist()):
                    probe[d] = level
            k1s.append(k1)
            k2s.append(k2)
            sizes.append(w.counts)
            keys += rows
            probes += probe
        columns = [batch.column("doc_id"), batch.column("tx"), *(pa.array(np.concatenate(x)) for x in (k1s, k2s, sizes)), pa.array(keys, pa.binary()), pa.array(probes, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "tx", "k1", "k2", "n_words", "keys", "probe"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(cast(text as string)) tx", "cast(text as string) text")
    return map_batches(rows, run, "doc_id long, tx long, k1 long, k2 long, n_words long, keys binary, probe int")


def measured_stop(rows: DataFrame, setting: Setting) -> int:
    return setting.stop({r.probe: r["count"] for r in rows.where("probe is not null").groupBy("probe").count().collect()})


def _exploded(texts: DataFrame, setting: Setting, shift: int = 0) -> DataFrame:
    """tree, key, node for every tree of a text; keys without their last ``shift`` bits, in the order of signed integers."""

    def explode(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), dtype=np.uint64).reshape(n, setting.trees)
        node = np.repeat(batch.column("node").to_numpy(), setting.trees)
        tree = np.tile(np.arange(setting.trees, dtype=np.int32), n)
        flat = keys.ravel() >> np.uint64(shift)
        return pa.RecordBatch.from_arrays([pa.array(tree), pa.array((flat ^ np.uint64(1 << 63)).view(np.int64)), pa.array(node)], names=["tree", "key", "node"])

    return map_batches(texts.select("node", "keys"), explode, "tree int, key long, node long")


def trie_edges(texts: DataFrame, setting: Setting, stop: int) -> DataFrame:
    """Candidate edges (a, b) from the sorted prefix tries, with prefixes of at least stop levels. texts: node, keys."""
    depth, spark = setting.depth, texts.sparkSession

    def levels(differ: np.ndarray) -> np.ndarray:
        shared = np.zeros(len(differ), dtype=np.int64)
        for level in range(1, depth + 1):
            shared += (differ >> np.uint64(64 - 8 * level)) == 0
        return shared

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # leaders[level]: first text of the open run that shares a prefix of that many levels
        leaders = [0] * (depth + 1)
        first = last = None

        def rows(a: list[int], b: list[int], ends: list[dict]) -> pa.RecordBatch:
            n = [None] * len(a)
            kind = pa.struct([("tree", pa.int32()), ("key", pa.int64()), ("node", pa.int64()), ("last_tree", pa.int32()), ("last_key", pa.int64()), ("leaders", pa.list_(pa.int64()))])
            none = [None] * len(ends)
            return pa.RecordBatch.from_arrays([pa.array(a + none, pa.int64()), pa.array(b + none, pa.int64()), pa.array(n + ends, kind)], names=["a", "b", "ends"])

        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column("tree").to_numpy()
            key = batch.column("key").to_numpy().view(np.uint64)
            node = batch.column("node").to_numpy()
            before_key, before_tree = np.r_[key[:1], key[:-1]], np.r_[tree[:1], tree[:-1]]
            if last is None:
                before_tree[0] = -1
                first = {"tree": int(tree[0]), "key": int(key[:1].view(np.int64)[0]), "node": int(node[0])}
            else:
                before_key[0], before_tree[0] = last[0], last[1]
            shared = levels(key ^ before_key)
            shared[tree != before_tree] = 0
            shared[shared < stop] = 0
            a, b = [], []
            previous = -2
            for i in np.flatnonzero(shared).tolist():
                if i != previous + 1:  # a run opens at the row before
                    if i > 0:
                        leaders = [int(node[i - 1])] * (depth + 1)
                    elif not last[3]:
                        leaders = [last[2]] * (depth + 1)
                level = int(shared[i])
                x = int(node[i])
                if x != leaders[level]:
                    a.append(x)
                    b.append(leaders[level])
                # shorter prefixes keep their leader; the first of a longer one joins the next shorter one's
                for deeper in range(level + 1, depth + 1):
                    leaders[deeper] = x
                previous = i
            last = (key[-1], tree[-1], int(node[-1]), bool(shared[-1]))
            yield rows(a, b, [])
        if last is not None:
            tail = leaders if last[3] else [last[2]] * (depth + 1)
            yield rows([], [], [{**first, "last_tree": int(last[1]), "last_key": int(np.array([last[0]]).view(np.int64)[0]), "leaders": tail}])

    ranged = _exploded(texts, setting).repartitionByRange(shuffled(spark), "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    found = written(ranged.mapInArrow(scan, "a long, b long, ends struct<tree: int, key: long, node: long, last_tree: int, last_key: long, leaders: array<long>>"), "trie")
    # one row a task: where a prefix goes on in the next task's range, its first text there joins the leader here
    ends = sorted((r.ends for r in found.where("ends is not null").select("ends").collect()), key=lambda e: (e.tree, e.key, e.node))
    stitches = []
    for here, there in zip(ends, ends[1:]):
        level = int(levels(np.array([(here.last_key ^ there.key) % (1 << 64)], dtype=np.uint64))[0])
        if here.last_tree == there.tree and level >= stop:
            stitches.append((there.node, here.leaders[level]))
    return found.where("ends is null").select("a", "b").union(spark.createDataFrame(stitches, "a long, b long")).distinct()


def _similar(sets: list[np.ndarray], threshold: float, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Boolean left x right: Jaccard of the sets of those indices at least threshold."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat)
    new = np.r_[True, flat[order][1:] != flat[order][:-1]]
    column = np.empty(len(flat), dtype=np.int64)
    column[order] = np.cumsum(new) - 1
    twice = np.bincount(column) > 1
    dense = np.cumsum(twice) - 1
    use = twice[column]
    doc, column = doc[use], dense[column[use]]
    width = int(twice.sum())
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    step = 4096
    for at in range(0, width, step):
        lo, hi = np.searchsorted(column, [at, at + step])
        x = np.zeros((len(sets), min(step, width - at)), dtype=np.float32)
        x[doc[lo:hi], column[lo:hi] - at] = 1
        both += x[left] @ x[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    return both >= threshold * union - 1e-6


def _labels(adjacent: np.ndarray) -> np.ndarray:
    """Component label of each node of a boolean adjacency matrix."""
    label = np.full(len(adjacent), -1)
    for i in range(len(adjacent)):
        if label[i] >= 0:
            continue
        front = np.array([i])
        label[i] = i
        while len(front):
            near = np.flatnonzero(adjacent[front].any(axis=0) & (label < 0))
            label[near] = i
            front = near
    return label


def verify(node: np.ndarray, weight: np.ndarray, side: np.ndarray, crossed: bool, sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (weighted) and local root of each text.

    crossed: two blocks, side 0 and 1, are set against each other; else one block against itself.
    """
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    links = np.zeros(len(node), dtype=np.int64)
    adjacent = np.zeros((len(node), len(node)), dtype=bool)
    if crossed:
        if len(left) and len(right):
            s = _similar(sets, threshold, left, right)
            links[left] = s.astype(np.float64) @ weight[right]
            links[right] = s.T.astype(np.float64) @ weight[left]
            adjacent[np.ix_(left, right)] = s
            adjacent[np.ix_(right, left)] = s.T
    else:
        adjacent = _similar(sets, threshold, left, left)
        np.fill_diagonal(adjacent, False)
        links = (adjacent.astype(np.float64) @ weight).astype(np.int64)
    label = _labels(adjacent)
    root = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(root, label, node)
    return links, root[label]


def _sets_of(group: pa.Table, lo: int, hi: int) -> list[np.ndarray]:
    grams = group.column("grams").combine_chunks()
    return [np.frombuffer(grams[i].as_buffer(), dtype=np.uint64) for i in range(lo, hi)]


def _once(group: pa.Table, keys: list[str]) -> pa.Table:
    """The rows sorted by keys and node, repeats of a node (from repeated rows) left out."""
    columns = [group.column(c).to_numpy() for c in [*keys, "node"]]
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return group.take(pa.array(order[new]))


def _cuts(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]) + 1, dtype=bool)
    new[1:-1] = False
    for c in columns:
        new[1:-1] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


_COUNTED = "node long, links long, root long"


def _in_blocks(sets: DataFrame, *key: str) -> DataFrame:
    """Every set once for each block of its group (key) it meets: p and q, the two blocks, and side, which of them is its own."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    out = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    out = out.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).withColumn("side", F.when(F.col("own") > F.col("other"), 1).otherwise(0))
    # small groups share a task's batch; a pair of blocks is one of its own
    few = F.pmod(F.xxhash64(*key), F.lit(8 * shuffled(sets.sparkSession)))
    return out.drop("own", "other").withColumn("grp", F.when(F.col("blocks") == 1, few).otherwise(F.xxhash64(*key, "p", "q")))


def _counted(sets: DataFrame, setting: Setting) -> DataFrame:
    """Links of each text inside its group (root), in parts by block, and its local root. sets: node, root, blocks, copies, grams."""

    def check(group: pa.Table) -> pa.Table:
        group = _once(group, ["root", "p", "q"])
        root, p, q, node, weight, side = (group.column(c).to_numpy() for c in ("root", "p", "q", "node", "copies", "side"))
        cut = _cuts(root, p, q)
        links, roots = np.zeros(len(node), dtype=np.int64), node.copy()
        for a, b in zip(cut[:-1], cut[1:]):
            if b - a > 1:
                links[a:b], roots[a:b] = verify(node[a:b], weight[a:b], side[a:b], bool(p[a] != q[a]), _sets_of(group, a, b), setting.threshold)
        return pa.table({"node": pa.array(node), "links": pa.array(links), "root": pa.array(roots)})

    return _in_blocks(sets, "root").select("node", "root", "copies", "grams", "p", "q", "side", "grp").groupBy("grp").applyInArrow(check, _COUNTED)


def _true_edges(edges: DataFrame, sets: DataFrame, setting: Setting) -> DataFrame:
    """The edges whose two texts are similar. Each leader meets its followers in chunks."""
    degree = edges.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / F.lit(setting.block)).alias("chunks")).select(F.col("b").alias("d_b"), "chunks")
    e = edges.join(degree, F.col("b") == F.col("d_b")).withColumn("chunk", F.pmod(F.xxhash64("a"), F.col("chunks")))
    grams = sets.select("node", "grams")
    followers = e.join(grams, F.col("a") == F.col("node")).select("b", "chunk", "node", "grams")
    leaders = e.select("b", "chunk").distinct().join(grams, F.col("b") == F.col("node")).select("b", "chunk", "node", "grams")

    def check(group: pa.Table) -> pa.Table:
        group = _once(group, ["b", "chunk"])
        b, chunk, node = (group.column(c).to_numpy() for c in ("b", "chunk", "node"))
        cut = _cuts(b, chunk)
        good = np.zeros(len(node), dtype=bool)
        for lo, hi in zip(cut[:-1], cut[1:]):
            sets = _sets_of(group, lo, hi)
            lead = np.flatnonzero(node[lo:hi] == b[lo])
            other = np.flatnonzero(node[lo:hi] != b[lo])
            if len(lead) and len(other):
                good[lo + other] = _similar(sets, setting.threshold, other, lead)[:, 0]
        return pa.table({"a": pa.array(node[good]), "b": pa.array(b[good])})

    both = followers.union(leaders).withColumn("grp", F.pmod(F.xxhash64("b", "chunk"), F.lit(64 * shuffled(sets.sparkSession))))
    return both.groupBy("grp").applyInArrow(check, "a long, b long")


def _across(members: DataFrame, sets: DataFrame, setting: Setting, stop: int) -> DataFrame:
    """Links between true components, found under the prefixes that hold several of them. sets: node, comp, copies, n_words, grams, keys."""
    shift = 64 - 8 * stop
    place = _exploded(members, setting, shift).join(sets.select(F.col("node").alias("s_node"), "comp", "n_words"), F.col("node") == F.col("s_node")).select("tree", "key", "node", "comp", "n_words")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(setting.block), F.sum("n_words") / F.lit(setting.block_words))).cast("int")
    mixed = place.groupBy("tree", "key").agg(blocks.alias("blocks"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select(F.col("tree").alias("m_tree"), F.col("key").alias("m_key"), "blocks")
    place = place.join(mixed, (F.col("tree") == F.col("m_tree")) & (F.col("key") == F.col("m_key"))).select("tree", "key", F.col("node").alias("p_node"), "blocks")
    rows = place.join(sets, F.col("p_node") == F.col("node")).select("tree", "key", "blocks", "node", "comp", "copies", "grams", "keys")

    def check(group: pa.Table) -> pa.Table:
        group = _once(group, ["tree", "key", "p", "q"])
        tree, key, p, q, node, comp, weight, side = (group.column(c).to_numpy() for c in ("tree", "key", "p", "q", "node", "comp", "copies", "side"))
        signature = np.frombuffer(b"".join(group.column("keys").to_pylist()), dtype=np.uint64).reshape(len(node), setting.trees) >> np.uint64(shift)
        cut = _cuts(tree, key, p, q)
        links, roots = np.zeros(len(node), dtype=np.int64), node.copy()
        for lo, hi in zip(cut[:-1], cut[1:]):
            own = np.arange(lo, hi)
            left, right = (own, own) if p[lo] == q[lo] else (own[side[own] == 0], own[side[own] == 1])
            new = comp[left][:, None] != comp[right][None]
            for earlier in range(int(tree[lo])):
                new &= signature[left, earlier][:, None] != signature[right, earlier][None]
            if not new.any():
                continue
            new &= _similar(_sets_of(group, lo, hi), setting.threshold, left - lo, right - lo)
            adjacent = np.zeros((hi - lo, hi - lo), dtype=bool)
            adjacent[np.ix_(left - lo, right - lo)] = new
            adjacent |= adjacent.T
            links[own] = (adjacent.astype(np.float64) @ weight[own]).astype(np.int64)
            label = _labels(adjacent)
            root = np.full(hi - lo, LAST)
            np.minimum.at(root, label, node[own])
            roots[own] = root[label]
        return pa.table({"node": pa.array(node), "links": pa.array(links), "root": pa.array(roots)})

    return _in_blocks(rows, "tree", "key").groupBy("grp").applyInArrow(check, _COUNTED)


def _blocked(members: DataFrame, setting: Setting) -> DataFrame:
    """members with blocks, the number their group (root) is cut into."""
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(setting.block), F.sum("n_words") / F.lit(setting.block_words))).cast("int")
    sizes = members.groupBy("root").agg(blocks.alias("blocks")).select(F.col("root").alias("s_root"), "blocks")
    return members.join(sizes, F.col("root") == F.col("s_root")).drop("s_root")


def _joined_up(found: DataFrame) -> DataFrame:
    """node, root for all nodes of components, roots included."""
    return found.select("node", "root").union(found.select(F.col("root").alias("node"), "root").distinct())


def _large(edges: DataFrame, sets: DataFrame, members: DataFrame, setting: Setting, stop: int) -> DataFrame:
    """Counted links in components of several blocks. sets: node, root, copies, n_words, keys, grams."""
    ids = members.select(F.col("node").alias("i_node"))
    true = written(_true_edges(edges.join(ids, F.col("a") == F.col("i_node")).select("a", "b"), sets, setting), "true-edges")
    comp = _joined_up(components(true)).select(F.col("node").alias("c_node"), F.col("root").alias("c_root"))
    sets = sets.drop("root", "blocks").join(comp, F.col("node") == F.col("c_node"), "left").withColumn("comp", F.coalesce("c_root", "node")).drop("c_node", "c_root")
    sets = written(sets, "comp-sets")
    inside = _counted(_blocked(sets.withColumnRenamed("comp", "root"), setting).select("node", "root", "blocks", "copies", "grams"), setting)
    across = _across(members, sets, setting, stop)
    known = sets.where("node <> comp").select("node", F.lit(0).cast("long").alias("links"), F.col("comp").alias("root"))
    return written(inside.union(across).union(known), "counted")


def _resolved(docs: DataFrame, setting: Setting) -> tuple[DataFrame, DataFrame]:
    """Signed rows, and every different text: k1, k2, copies, doc (least doc_id), worded, links, root (its class)."""
    rows = written(signed(docs, setting), "signatures")
    stop = measured_stop(rows, setting)
    doc_key = F.coalesce("doc_id", F.lit(LAST))
    texts = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min("keys").alias("keys"), F.min("n_words").alias("n_words"), F.min(F.struct(doc_key.alias("doc_key"), "tx")).alias("rep"))
    texts = written(texts.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "copies", "keys", "n_words", "rep.doc_key", "rep.tx"), "texts")
    edges = written(trie_edges(texts.where("keys is not null"), setting, stop), "edges")
    members = _joined_up(components(edges)).join(texts.select(F.col("node").alias("t_node"), "copies", "keys", "n_words", "doc_key", "tx"), F.col("node") == F.col("t_node")).drop("t_node")
    members = written(_blocked(members, setting), "members")
    large = members.where("blocks > 1").limit(1).count() > 0
    # members grow with the corpus: a shuffled join at every size
    m = members.select("node", "root", "blocks", "copies", "n_words", "keys" if large else F.lit(None).cast("binary").alias("keys"), F.col("doc_key").alias("m_key"), F.col("tx").alias("m_tx"))
    texted = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), F.xxhash64(F.col("text").cast("string")).alias("tx"), F.col("text").cast("string").alias("text"))
    picked = texted.join(m.hint("merge"), (F.col("key") == F.col("m_key")) & (F.col("tx") == F.col("m_tx"))).select("node", "root", "blocks", "copies", "n_words", "keys", "text")

    def to_sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = []
        for piece in tk.slices(batch, "text"):
            _, _, g, doc = shingles(tk.texts_of(piece.column("text")), setting.gram)
            cut = np.searchsorted(doc, np.arange(piece.num_rows + 1))
            sets += [np.unique(g[x:y]).tobytes() for x, y in zip(cut[:-1], cut[1:])]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "root", "blocks", "copies", "n_words", "keys")), pa.array(sets, pa.binary())], names=["node", "root", "blocks", "copies", "n_words", "keys", "grams"])

    sets = map_batches(picked, to_sets, "node long, root long, blocks int, copies long, n_words long, keys binary, grams binary")
    if large:
        sets = written(sets, "sets")
    counted = written(_counted(sets.where("blocks = 1").select("node", "root", "blocks", "copies", "grams"), setting), "checked").select("node", "links", "root", F.lit(False).alias("split"))
    if large:
        counted = counted.union(_large(edges, sets.where("blocks > 1"), members.where("blocks > 1"), setting, stop).select("node", "links", "root", F.lit(True)))
    whole = counted.where("not split").select("node", "links", "root")
    if large:
        parted = counted.where("split").groupBy("node").agg(F.sum("links").alias("links"))
        found = components(counted.where("split and node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("j_node"), F.col("root").alias("j_root"))
        whole = whole.union(parted.join(found, F.col("node") == F.col("j_node"), "left").select("node", "links", F.coalesce("j_root", "node").alias("root")))
    classed = whole.select(F.col("node").alias("c_node"), "links", F.col("root").alias("c_root"))
    named = texts.join(classed, F.col("node") == F.col("c_node"), "left")
    doc = F.when(F.col("doc_key") < LAST, F.col("doc_key")).alias("doc")
    return rows, named.select("k1", "k2", "copies", doc, F.col("keys").isNotNull().alias("worded"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("c_root", "node").alias("root"))


def classes(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """doc_id, class_id, n_links for every row of docs."""
    rows, named = _resolved(docs, setting)
    named = written(named, "classed")
    names = named.where("worded").groupBy("root").agg(F.min("doc").alias("doc"))
    rank = F.row_number().over(Window.partitionBy(F.coalesce("doc", -1 - F.col("root"))).orderBy("root"))
    names = names.select(F.col("root").alias("n_root"), F.when(rank == 1, F.col("doc")).otherwise(-1 - F.col("root")).alias("class"))
    named = named.join(names, F.col("root") == F.col("n_root"), "left").select(F.col("k1").alias("n_k1"), F.col("k2").alias("n_k2"), "copies", "worded", "links", "class")
    out = rows.select("doc_id", "k1", "k2").join(named, (F.col("k1") == F.col("n_k1")) & (F.col("k2") == F.col("n_k2")))
    return out.select("doc_id", F.when(F.col("worded"), F.col("class")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("worded"), F.col("links") + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"))


def keep_first(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """One row of docs for each class, the one with the least doc_id (null last), then the least hash of its text.

    Rows without a word all stay. Columns unchanged.
    """
    rows, named = _resolved(docs, setting)
    named = named.select(F.col("k1").alias("n_k1"), F.col("k2").alias("n_k2"), "root", "worded")
    placed = rows.select(F.coalesce("doc_id", F.lit(LAST)).alias("key"), "tx", "k1", "k2").join(named, (F.col("k1") == F.col("n_k1")) & (F.col("k2") == F.col("n_k2")))
    first = placed.where("worded").groupBy("root").agg(F.min(F.struct("key", "tx")).alias("first")).select("first.*")
    first = written(first.select(F.col("key").alias("f_key"), F.col("tx").alias("f_tx")), "first")
    text = F.col("text").cast("string")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(row, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), F.xxhash64(text).alias("tx"), F.coalesce(F.regexp_like(text, F.lit(WORD)), F.lit(False)).alias("worded"))
    kept = keyed.where("worded").join(first.hint("merge"), (F.col("key") == F.col("f_key")) & (F.col("tx") == F.col("f_tx")), "left_semi")
    repeated = rows.where("keys is not null").groupBy("doc_id", "tx").count().where("count > 1").limit(1).count() > 0
    if repeated:
        kept = kept.dropDuplicates(["key", "tx"])
    return kept.unionByName(keyed.where("not worded")).select("row.*")
