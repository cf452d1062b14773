"""A similarity join of names: pairs whose token-set ratio reaches a threshold, from exact candidate filters.

The ratio of two names looks at their sets of words only. With ``one`` and ``two`` the words of each name, the common ones
first, and ``base`` the common ones, it is the largest of like(one, two), like(base, one) and like(base, two), where like is
twice the longest common subsequence over the sum of lengths; with a common word, a name inside the other gives 100. A pair
above the threshold s therefore meets one of these, and each becomes a key on which both sides are hash-joined:

* like(one, two) >= s. The edits between the two strings then spoil at most ``spoilt`` of the letter pairs of a name, spaces
  at both ends of a word included: pairs lie within words, so the order of words does not matter. Two names that share all
  but so many pairs share one among their ``spoilt`` + 1 rarest ones (prefix filter). Lengths are within s / (2 - s) of each
  other, so keys hold a class of length too; a bitmap of pairs turns most others away before they are compared.
* like(base, one) >= s, or one name inside the other: most letters of a name stand in common words. So one of the rarest
  words that hold more letters than may be missing is common (prefix filter by weight), against all words of the other side.

Rarity is known for ``ranked`` letter pairs and words, the most frequent ones of the registry; all others count as rare and
go by hash. Any order that both sides share gives all pairs; this one keeps common keys out of the prefixes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EPS = 1e-9


def _indel(a: str, b: str) -> float:
    """100 x 2 LCS / (|a| + |b|), the longest common subsequence by bit vectors."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, s = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return 200.0 * (len(a) - s.bit_count()) / (len(a) + len(b))


def token_set_ratio(a: str | None, b: str | None) -> float:
    """Likeness of two texts as sets of words, 0 to 100, case-sensitive."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    both, dx, dy = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not dx or not dy):
        return 100.0
    base = " ".join(both)
    one, two = " ".join([*both, *dx]), " ".join([*both, *dy])
    scores = [_indel(one, two)]
    if both:
        scores += [_indel(base, one), _indel(base, two)]
    return max(scores)


@dataclass(frozen=True)
class Bounds:
    """What a threshold between 0 and 1 means for lengths, letter pairs and words."""

    threshold: float

    @property
    def shortest(self) -> float:
        """Least ratio of the shorter to the longer of two strings that are alike enough."""
        return self.threshold / (2 - self.threshold)

    def spoilt(self, length: int) -> int:
        """Most letter pairs of a string of this length that edits to a string alike enough spoil.

        A letter taken out spoils two pairs and a letter put in spoils one; their numbers follow from the lengths, and the
        sum is linear in the other length, so it is greatest at one of the two lengths allowed.
        """
        per = (1.5 * (1 - self.threshold) * (1 + r) + 0.5 * (1 - r) for r in (self.shortest, 1 / self.shortest))
        return math.floor(max(per) * length + _EPS)

    def missing(self, length: int) -> float:
        """Most letters of a name, spaces between words included, outside the common words."""
        return (1 - self.shortest) * length + _EPS

    def length_class(self, length: int) -> int:
        # lengths within the ratio are of one class, or of two that are next to each other
        return math.floor(math.log(max(length, 1)) / -math.log(min(self.shortest, 0.99)))


def canonical(text: str | None) -> str:
    """A name's distinct words, sorted: all that the ratio depends on."""
    return " ".join(sorted(set((text or "").split())))


def letter_pairs(words: list[str]) -> list[str]:
    """Letter pairs of the words, with the space before and after each; a repeated pair has its number."""
    seen: Counter[str] = Counter()
    out = []
    for w in words:
        padded = f" {w} "
        for i in range(len(w) + 1):
            pair = padded[i : i + 2]
            seen[pair] += 1
            out.append(f"{pair}{seen[pair]}" if seen[pair] > 1 else pair)
    return out


def _bitmap(pairs: list[str]) -> tuple[int, int]:
    bits = 0
    for p in pairs:
        bits |= 1 << crc32(p.encode()) % 128
    low, high = bits & (1 << 64) - 1, bits >> 64
    return low - (1 << 64) if low >> 63 else low, high - (1 << 64) if high >> 63 else high


@dataclass
class Ranks:
    """Places of the frequent letter pairs and words, the most frequent last; others come before them."""

    pairs: dict[str, int]
    words: dict[str, int]

    def ordered(self, keys: list[str], places: dict[str, int]) -> list[str]:
        return sorted(keys, key=lambda k: (places.get(k, -1), crc32(k.encode()), k))


def keys_of(text: str, bounds: Bounds, ranks: Ranks) -> tuple[list[str], list[str], list[str]]:
    """Of a canonical name: the rarest letter pairs, the rarest words, and all words."""
    words, length = text.split(), len(text)
    pairs = ranks.ordered(letter_pairs(words), ranks.pairs)
    rare, weight = [], 0
    for w in ranks.ordered(words, ranks.words):
        rare.append(w)
        weight += len(w) + 1
        if weight > bounds.missing(length) + 1:
            break
    return pairs[: bounds.spoilt(length) + 1], rare, words


def frequencies(names: DataFrame, ranked: int) -> Ranks:
    """The most frequent letter pairs and words of a column text of canonical names, ``ranked`` of each at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter[str] = Counter()
            for text in map(canonical, batch.column("text").to_pylist()):
                words = text.split()
                n.update("w" + w for w in words)
                n.update("p" + p for p in letter_pairs(words))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["key", "n"])

    counts = names.select("text").mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    places: dict[str, dict[str, int]] = {}
    for kind in "pw":
        # bounded by ranked
        top = counts.where(F.startswith("key", F.lit(kind))).orderBy(F.desc("n"), "key").limit(ranked)
        rows = [r.key[1:] for r in top.collect()]
        places[kind] = {k: len(rows) - i for i, k in enumerate(rows)}
    return Ranks(places["p"], places["w"])


def _keyed(names: DataFrame, bounds: Bounds, ranks: Ranks, left: bool) -> DataFrame:
    """key, text, length, low, high of every canonical name; keys tell what is joined on, and a class of length."""
    shared = names.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                # white space that only Python splits at is no other name
                own = canonical(text)
                pairs, rare, words = keys_of(own, bounds, ranks)
                size, (low, high) = bounds.length_class(len(own)), _bitmap(letter_pairs(words))
                sizes = (size,) if left else (size - 1, size, size + 1)
                keys = [f"p{s} {p}" for p in pairs for s in sizes]
                # a prefix on this side meets all words of the other
                keys += [("l" if left else "r") + w for w in rare] + [("r" if left else "l") + w for w in words]
                rows += [(k, text, len(own), low, high) for k in keys]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["key", "text", "length", "low", "high"]).astype({"length": "int32", "low": "int64", "high": "int64"}), preserve_index=False)

    return names.select("text").mapInArrow(run, "key string, text string, length int, low long, high long")


def candidates(left: DataFrame, right: DataFrame, threshold: float, ranked: int = 10_000) -> DataFrame:
    """a, b: canonical names (column text of either side) that may be alike enough; every pair that is, is among them."""
    bounds = Bounds(threshold)
    if not 0.7 <= threshold <= 1:
        raise ValueError("letter pairs tell names apart at thresholds of 0.7 and more")
    ranks = frequencies(right, ranked)
    a, b = _keyed(left, bounds, ranks, True), _keyed(right, bounds, ranks, False)
    b = b.select("key", *(F.col(c).alias(f"b_{c}") for c in ("text", "length", "low", "high")))
    met = a.join(b.hint("merge"), "key")
    # an unshared pair of letters sets one bit at most
    differ = F.bit_count(F.col("low").bitwiseXOR(F.col("b_low"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("b_high")))
    longest, shortest = F.greatest("length", "b_length"), F.least("length", "b_length")
    per = bounds.spoilt(1_000_000) / 1_000_000 + 1e-6
    close = (shortest >= F.lit(bounds.shortest) * longest - 1e-6) & (differ <= F.lit(per) * (F.col("length") + F.col("b_length")) + 2e-6)
    return met.where(~F.startswith("key", F.lit("p")) | close).select(F.col("text").alias("a"), F.col("b_text").alias("b")).distinct()


def alike(left: DataFrame, right: DataFrame, threshold: float, ranked: int = 10_000) -> DataFrame:
    """a, b, score (0 to 100): the pairs of canonical names whose token-set ratio reaches the threshold."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([token_set_ratio(p, q) for p, q in zip(x, y)], dtype="float64")

    pairs = candidates(left, right, threshold, ranked)
    return pairs.withColumn("score", ratio("a", "b")).where(F.col("score") >= 100 * threshold)


def with_canonical(rows: DataFrame, name: str) -> DataFrame:
    """rows with text, the canonical form of a name; without rows whose name has no word."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.trim(name), r"(?U)\s+"), lambda w: w != "")))
    return rows.withColumn("text", F.array_join(words, " ")).where("text <> ''")
