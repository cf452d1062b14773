"""The filter audit, SimHash near-duplicates and resampling against brute force; codes, hashes, chunks and edge cases."""

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import types as T

from labelwright.llm import filter_audit, resampling, simhash
from labelwright.llm import textkernel as tk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ("key", "part", "mask", "digest", "good", "toxic", "n", "of", "fp", "node", "root", "row", "owned", "weight", "able", "at", "rank")]
)


def prose(n, seed, vocabulary=300):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    base = [prose(60 + 5 * s, s) for s in range(8)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(20, base[0], "s0"), (21, base[0], None), (21, base[0], ""), (3, base[3], "s1"), (None, base[0], "s1"), (None, None, None), (None, prose(40, 77), "s2")]
    rows += [(30 + k, base[1].replace(" ", f" Q{k} ", 1 + k % 2), "s2") for k in range(4)] + [(40, base[2].upper(), "s0"), (41, base[2] + " #", "s1"), (42, base[2] + "\n|", "s1")]
    rows += [(50, "", "s0"), (51, " \t\n", "s0"), (52, "one", "s1"), (53, "one two", "s1"), (54, "ÉÀ é ß 中文 字 " * 12, "s9"), (55, "same " * 70, "s9"), (56, prose(30_000, 5, 9000), "s0")]
    rows += [(57, "x" * 5000 + " tail-" + "y" * 70 + " end", "s1"), (58, prose(30_000, 5, 9000), "s2")]
    return rows


LABELS = [(0, 1, 0), (1, 0, 1), (1, 1, 0), (20, 1, 1), (40, None, 1), (50, 0, None), (None, 1, 1), (999, 1, 1)]
LABEL_SCHEMA = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *["7"] * 17) for r in corpus()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def audited(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    fails = []
    for d, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t)}
        f["E"] = d is not None and first[t] < d
        fails.append((s or "", f, d is not None and d in good, d is not None and d in toxic))
    out = []
    for part in {x[0] for x in fails}:
        mine = [x for x in fails if x[0] == part]
        total, rows_of = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order, 1):
                removed = [x for x in left if x[1][c]]
                gone = [x for x in mine if not any(x is y for y in left)]
                left = [x for x in left if not x[1][c]]
                total[c] += len(removed)
                alone = sum(x[1][c] and sum(x[1].values()) == 1 for x in mine)
                rows_of.append((part, "".join(order), step, len(left), len(removed), sum(x[1][c] for x in gone), alone, sum(x[2] for x in removed), sum(x[3] for x in removed)))
        out += [(*r, total[r[1][r[2] - 1]]) for r in rows_of]
    return sorted(out)


def test_audit_is_the_brute_force(spark, docs):
    got = filter_audit.audit(docs, spark.createDataFrame(LABELS, LABEL_SCHEMA))
    assert sorted(map(tuple, got.collect())) == audited(corpus(), LABELS)


def test_audit_of_nothing_and_without_labels(spark, docs, nothing):
    none = spark.createDataFrame([], LABEL_SCHEMA)
    assert filter_audit.audit(nothing, none).count() == 0
    got = filter_audit.audit(docs, none).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()
    assert tuple(got) == (0, 0)


def test_distinct_words_are_right_when_hashes_collide(monkeypatch):
    texts = ["a b a c", "aa ab aa", "", "x", "é e é", "b a"]
    t = tk.texts_of(pa.array(texts))
    want = [len(set(WORD.findall(x))) for x in texts]
    assert filter_audit.distinct_words(t, tk.words_of(t)).tolist() == want
    monkeypatch.setattr(tk, "hash_spans", lambda data, start, end: np.zeros(len(start), dtype=np.uint64))
    monkeypatch.setattr(tk, "doc_keys", lambda h, doc: h)
    assert filter_audit.distinct_words(t, tk.words_of(t)).tolist() == want


def print_of(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints):
    """Least id of each row's component, by comparing all."""
    at = list(range(len(prints)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, (_, x) in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j][1]).bit_count() <= 2 and root(i) != root(j):
                at[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, f"{x:016x}", least.get(root(i))) for i, (d, x) in enumerate(prints)]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_simhash_is_the_brute_force(docs):
    want = linked([(d, print_of(t)) for d, t, _ in corpus()])
    assert ordered(simhash.near_duplicates(docs).collect()) == ordered(want)


def test_simhash_edges(spark, docs, nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert got[50].fingerprint == "0" * 16 and got[50].component_id == got[51].component_id == 50
    alone = spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")
    assert simhash.near_duplicates(alone).first().component_id is None


@pytest.mark.parametrize("code", [simhash.GOLAY, simhash.HAMMING, simhash.PLAIN])
def test_codes_are_perfect_and_reach_what_is_near(code):
    word, begin, ends = code.errors(2)
    # one word within the radius for every syndrome
    assert ((ends[:, 0] - begin) == 1).all() and len(begin) == 1 << code.check_bits
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << code.length, 200)
    for flips in (0, 1, 2):
        y = x.copy()
        for k in range(flips):
            y ^= 1 << ((x + 2 * k) % code.length)
        _, home, _ = simhash.reach(x.astype(np.uint64), (code,), 0, np.zeros(200, dtype=np.int64), 2)
        row, anchor, _ = simhash.reach(y.astype(np.uint64), (code,), 0, np.full(200, flips), 2)
        assert all(home[i] in anchor[row == i] for i in range(200))


def clustered(n, seed):
    """Fingerprints of which many lie a few bits from one of four, so that anchors are crowded."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)]
    out = [rng.getrandbits(64) for _ in range(n // 4)]
    for _ in range(n):
        x = rng.choice(centres)
        for _ in range(rng.randrange(7)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


@pytest.mark.parametrize("setting", [simhash.Setting(), simhash.Setting(crowded_rows=8, crowded_share=1e-4), simhash.Setting(crowded_rows=8, scan=10, pairs=64, rows=100)])
def test_no_link_is_lost_at_crowded_anchors(spark, monkeypatch, setting):
    prints = list(enumerate(clustered(600, 11)))
    table = spark.createDataFrame([(d, x - (1 << 64) if x >> 63 else x) for d, x in prints], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, setting: docs)
    if setting.crowded_rows == 8:
        assert len(simhash.crowded(table.select("fp").distinct(), setting))
    assert ordered(simhash.near_duplicates(table, setting).collect()) == ordered(linked(prints))


TARGET = [prose(200, 1), "A0 a1 é", None, "", prose(20_000, 5, 9000)]


def resampled(rows, target):
    def split(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    def runs(w):
        return [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    s, t = np.zeros(10_000, dtype=int), np.zeros(10_000, dtype=int)
    for _, x, _ in rows:
        np.add.at(s, runs(split(x)), 1)
    for x in target:
        np.add.at(t, runs(split(x)), 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s, t)]
    out = []
    for d, x, _ in rows:
        w = split(x)
        f = runs(w)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0]))
    drawn = able[: 25 * len(able) // 100]
    # rows alike in score and id are interchangeable
    return [(d, n, f, w, sc) for d, n, f, w, sc in out], [(x[0], x[4], k) for k, x in enumerate(drawn, 1)]


@pytest.mark.parametrize("size", [1 << 16, 300, 7])
def test_resampling_is_the_brute_force_whatever_the_chunks(spark, docs, size):
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")
    got = resampling.resample(docs, target, resampling.Setting(chunk_bytes=size)).collect()
    rows, drawn = resampled(corpus(), TARGET)
    assert ordered((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == ordered(rows)
    assert ordered((r.doc_id, r.score, r["rank"]) for r in got if r["rank"]) == ordered(drawn)


def test_resampling_of_nothing_and_to_nothing(spark, docs, nothing):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(nothing, none).count() == 0
    assert resampling.resample(docs, none).count() == len(corpus())


def test_features_of_three_words(spark):
    t = tk.texts_of(pa.array(["a B c d", "x"]))
    doc, bucket, words = resampling.features(t, np.array([3, 9]), resampling.Setting(n=3))
    assert words.tolist() == [2, 1]
    want = [(0, x) for x in ("a", "b", "a b", "b c", "a b c", "b c d")] + [(1, "x")]
    assert sorted(zip(doc.tolist(), bucket.tolist())) == sorted((d, zlib.crc32(f.encode()) % 10_000) for d, f in want)


def test_very_long_texts(spark):
    """20 MB of words, and a word of 8 MB, in each of the three."""
    big = prose(1 << 20, 3, 50_000) * 4
    table = spark.createDataFrame([(1, big, "s"), (2, "z" * (8 << 20), "s"), (3, big, "s")], "doc_id long, text string, source string").repartition(1).cache()
    assert len(big) > 20 << 20
    labels = spark.createDataFrame([], LABEL_SCHEMA)
    assert filter_audit.audit(table, labels).where("filter_order = 'EABCD' and step = 1").first().removed == 1
    assert [r.component_id for r in simhash.near_duplicates(table).orderBy("doc_id").collect()] == [1, 2, 1]
    rows = resampling.resample(table, spark.createDataFrame([("a1 b2",)], "text string")).orderBy("doc_id").collect()
    n = len(big.split())
    assert [r.n_features for r in rows] == [2 * n - 1, 1, 2 * n - 1] and rows[0].weight == rows[2].weight
