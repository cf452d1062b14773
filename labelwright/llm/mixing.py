"""Mixing sources to target weights along a time-varying curriculum.

Every source has a piecewise-linear weight over training progress 0..1. The integral of the weight sets the source's
share of the token budget (water-filled: no source gives more than ``max_epochs`` times its size). Within a source the
documents stand in a fixed pseudo-random order, so each owns an interval of the source's token stream, epoch after
epoch; the source's cumulative demand over progress, inverted at the start of that interval, gives the progress at which
the document is due. The demand of all sources up to there, as a share of the whole, is its training position: where in
the stream of taken tokens it stands, whatever the weights sum to. Documents are then range-sorted by position.

Scale: sizes are counted where the texts are read; only (id, source, size) is shuffled. A source's running sum is
taken per hash bucket and put together from the bucket totals, so a source with a third of all rows is spread over
``buckets`` tasks. One row per source reaches the driver; there are as many as weights were configured.

A source whose weight integrates to 0 gives nothing: target 0, no words taken. A null text has size 0 and is never taken. A null source is a source of its own, last in the order. Ties in the order
(repeated rows) stand in order of size, and rows that agree in that too are interchangeable. An empty table gives an
empty mix. Texts of any length are counted by a regular expression, without building their words. Only doc_id, text and source are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

#: Sources that a mix may have; their totals are collected to the driver.
MAX_SOURCES = 100_000


@dataclass(frozen=True)
class Schedule:
    """A weight over progress: (progress, weight) knots from 0 to 1, linear between them."""

    knots: tuple[tuple[float, float], ...]

    def integral(self) -> float:
        return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(self.knots, self.knots[1:]))


def constant(weight: float) -> Schedule:
    return Schedule(((0.0, weight), (1.0, weight)))


def ramp(weight: float, start: float, end: float) -> Schedule:
    """From start to end, with mean weight; start and end are factors with mean 1."""
    return Schedule(((0.0, weight * start), (1.0, weight * end)))


def water_fill(sizes: list[int], weights: list[float], budget: float, max_epochs: float) -> list[float]:
    """Shares of the budget by weight; what is above max_epochs times a size is reshared until nothing is. No weight, no share."""
    caps = [max_epochs * s for s in sizes]
    order = sorted((i for i in range(len(sizes)) if weights[i] > 0), key=lambda i: caps[i] / weights[i])
    left, weight = budget, float(sum(weights))
    out, full = [0.0] * len(sizes), 0
    for i in order:
        if caps[i] * weight > left * weights[i]:
            break
        out[i], full = caps[i], full + 1
        left, weight = left - caps[i], weight - weights[i]
    for i in order[full:]:
        out[i] = min(caps[i], left * weights[i] / weight)
    return out


def _inverse(share: Column, knots: Column) -> Column:
    """Progress at which a source has given this share of its tokens; knots: its (t, w, share before) segments."""
    segment = F.element_at(F.filter(knots, lambda k: k["before"] <= share), -1)
    width, slope = segment["t1"] - segment["t0"], segment["w1"] - segment["w0"]
    need = (share - segment["before"]) * segment["total"]
    # w0 x + slope x^2 / (2 width) = need
    root = F.sqrt(F.greatest(F.lit(0.0), segment["w0"] * segment["w0"] + 2 * slope * need / width))
    return F.least(F.lit(1.0), segment["t0"] + F.when(root + segment["w0"] <= 0, 0.0).otherwise(2 * need / (segment["w0"] + root)))


def _segments(s: Schedule) -> list[tuple[float, float, float, float, float, float]]:
    total, before, out = s.integral(), 0.0, []
    for (t0, w0), (t1, w1) in zip(s.knots, s.knots[1:]):
        out.append((t0, t1, w0, w1, before / total if total else 0.0, total))
        before += (t1 - t0) * (w0 + w1) / 2
    return out


def cumulative(targets: list[float], schedules: list[Schedule]) -> list[tuple[float, float, float, float]]:
    """Demand of all sources over progress x, as a share of the whole: (x0, d0, v, c) segments, d0 + v (x - x0) + c (x - x0)^2."""
    whole = sum(targets) or 1.0
    at = sorted({t for s in schedules for t, _ in s.knots} | {0.0, 1.0})
    out, d = [], 0.0
    giving = [(target, s) for target, s in zip(targets, schedules) if s.integral() > 0]
    for x0, x1 in zip(at, at[1:]):
        v = c = 0.0
        for target, s in giving:
            for (t0, w0), (t1, w1) in zip(s.knots, s.knots[1:]):
                if t0 <= x0 and x1 <= t1:
                    slope, scale = (w1 - w0) / (t1 - t0), target / s.integral() / whole
                    v, c = v + scale * (w0 + slope * (x0 - t0)), c + scale * slope / 2
        out.append((x0, d, v, c))
        d += v * (x1 - x0) + c * (x1 - x0) ** 2
    return out


def _demand(progress: Column, segments: list[tuple[float, float, float, float]]) -> Column:
    out = F.lit(0.0)
    for x0, d0, v, c in segments:
        x = progress - F.lit(x0)
        out = F.when(progress >= x0, F.lit(d0) + F.lit(v) * x + F.lit(c) * x * x).otherwise(out)
    return F.least(F.lit(1.0), out)


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id"),
        F.col("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def mix(docs: DataFrame, schedule: Callable[[int], Schedule], budget: float = 1.5, max_epochs: float = 2.0, buckets: int = 4096) -> DataFrame:
    """One row per document with what the mix takes of it.

    docs: doc_id, source, text. schedule(k) is the schedule of the k-th source in code point order, null last; budget is
    in multiples of all words. Adds source_size, target (words of the source), taken (words
    of this document, over all epochs) and positions (share of the stream of taken tokens before each copy, in order; the
    last copy may be cut where the budget of its source ends). Rows come range-sorted by their first position, untaken ones last.
    """
    spark = docs.sparkSession
    # the texts are read once; what follows works on the sizes
    rows = written(sized(docs), "sizes").withColumn("ord", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    # buckets follow the order: runs of its first 32 bits
    rows = rows.withColumn("bucket", F.shiftright(F.conv(F.substring("ord", 1, 8), 16, 10).cast("long") * F.lit(buckets), 32))
    totals = rows.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    schedules = [schedule(k) for k in range(len(totals))]
    sizes = [r.n for r in totals]
    targets = water_fill(sizes, [s.integral() for s in schedules], budget * sum(sizes), max_epochs)
    plan = spark.createDataFrame(
        [(r.source, r.n, t, _segments(s)) for r, t, s in zip(totals, targets, schedules)],
        "plan_source string, source_size long, target double, knots array<struct<t0: double, t1: double, w0: double, w1: double, before: double, total: double>>",
    )
    # bounded by MAX_SOURCES x buckets rows of three numbers; joined without a hint, so its size decides how
    before = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    up_to = Window.partitionBy("source").orderBy("bucket")
    before = before.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), (F.sum("n").over(up_to) - F.col("n")).alias("earlier"))
    inside = Window.partitionBy("source", "bucket").orderBy("ord", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("at", F.sum("size").over(inside) - F.col("size"))
    rows = rows.join(before, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    rows = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("plan_source")))  # at most MAX_SOURCES rows
    tokens, n = F.round("target").cast("long"), F.greatest(F.col("source_size"), F.lit(1))
    rows = rows.withColumn("at", F.col("at") + F.col("earlier"))
    epochs, rest = F.floor(tokens / n).cast("long"), tokens % n
    part = F.least(F.greatest(rest - F.col("at"), F.lit(0)), F.col("size"))
    rows = rows.withColumn("taken", epochs * F.col("size") + part)
    copies = F.when(F.col("taken") > 0, F.sequence(F.lit(0), F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    segments = cumulative(targets, schedules)
    place = lambda k: _demand(_inverse(F.least(F.lit(1.0), (F.col("at") + k * F.col("source_size")) / F.greatest(F.col("target"), F.lit(1.0))), F.col("knots")), segments)
    rows = rows.withColumn("positions", F.transform(copies, place))
    # untaken documents follow the others, spread by their order
    rank = F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0) + F.col("bucket") / F.lit(buckets))
    rows = rows.withColumn("rank", rank)
    return rows.repartitionByRange("rank", "ord").sortWithinPartitions("rank", "ord").select("doc_id", "source", "size", "source_size", "target", "taken", "positions")


def take_copies(docs: DataFrame, schedule: Callable[[int], Schedule], budget: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """The mix itself: a row of docs, columns unchanged, for each copy taken, range-sorted by training position.

    Documents stay whole: the copy that is cut at the end of its source's budget is taken if at least half of it is
    due. Rows alike in doc_id, source and size share one decision.
    """
    mixed = mix(docs, schedule, budget, max_epochs).where("taken > 0")
    due = mixed.groupBy("doc_id", "source", "size").agg(F.max(F.struct("taken", "positions")).alias("due"))
    due = due.select(F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("size").alias("__mix_size"), "due")
    due = due.select("__mix_id", "__mix_source", "__mix_size", F.posexplode("due.positions").alias("__mix_copy", "__mix_position"), F.col("due.taken").alias("__mix_taken"))
    due = due.where(2 * (F.col("__mix_taken") - F.col("__mix_copy") * F.col("__mix_size")) >= F.col("__mix_size"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.withColumn("__mix_words", size)
    same = F.col("doc_id").eqNullSafe(F.col("__mix_id")) & F.col("source").eqNullSafe(F.col("__mix_source")) & (F.col("__mix_words") == F.col("__mix_size"))
    rows = rows.join(due.hint("merge"), same)
    return rows.repartitionByRange("__mix_position").sortWithinPartitions("__mix_position").select(*(F.col(f"`{c}`") for c in docs.columns))


def curriculum(k: int) -> Schedule:
    """Mean weights 3, 1, 2, repeating: the heavy sources fade, the light ones grow, the others stay level."""
    return (ramp(3.0, 4 / 3, 2 / 3), ramp(1.0, 0.5, 1.5), constant(2.0))[k % 3]
