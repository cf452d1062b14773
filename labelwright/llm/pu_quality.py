"""Quality classifier by positive-unlabelled learning.

A text becomes some thirty measurements (case, marks, repetition, word shapes), each expanded into hinges at quantiles
of the training sample, so the linear model is additive and piecewise linear. It is trained by minimising the
non-negative unbiased risk of positive-unlabelled learning with logistic loss, from trusted positives, unlabelled
documents and a class prior. The prior is estimated from those two alone: a classifier of positives against unlabelled
texts is cross-fitted, and the prior is the least ratio of unlabelled to positive texts above a score, at the score
where its upper confidence bound is least (best bin estimation, Garg et al., 2021). Negative labels are not read.

Training uses about ``Sample.positives`` positives and ``Sample.unlabelled`` unlabelled documents, chosen by hash, which
bounds what reaches the driver also where ids repeat; everything else covers all rows. Held-out accuracy moves by less
than the labels tell when the unlabelled sample grows (README). Scoring is row by row, without a shuffle, so skew and
copies play no part. A text is handled whole in one task, in some thirty times its bytes.

A null or empty text is scored like any other, from measurements that are all zero. Repeated rows get equal scores, so
ties in the score are ties of the measurements. Rows of labels whose label is null are left out; a doc_id with several
labels counts as positive if one of them is. With no positive labels the score is 0.5 throughout. An empty table gives
an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import below, hashed_share, id_bucket, keep_rows, map_batches, written


@dataclass(frozen=True)
class Sample:
    """Bounds of what training gathers, in rows."""

    positives: int = 8_000
    unlabelled: int = 12_000


def _set(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _LOWER, _DIGIT = _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _set("abcdefghijklmnopqrstuvwxyz"), _set("0123456789")
_MARKS = {"symbol": _set("#*$%&<>"), "pipe": _set("|"), "shout": _set("!"), "stop": _set("."), "comma": _set(","), "other": _set("?;:\"'()[]{}@/\\=+_~^`-")}
_OPEN = np.arange(256) >= 128


def features(t: tk.Texts) -> np.ndarray:
    """One row of measurements per text."""
    w = tk.words_of(t)
    n = np.maximum(w.counts, 1).astype(np.float64)
    data, off = t.data, t.offsets
    size = np.maximum(np.diff(off), 1).astype(np.float64)
    count = lambda mask: tk.per_doc(mask.astype(np.int64), off)
    over = lambda mask: tk.per_doc(mask.astype(np.int64), w.first) / n
    upper, lower = _UPPER[data], _LOWER[data]
    letters = count(upper) + count(lower)
    cols = [np.log1p(w.counts), size / n, count(upper) / np.maximum(letters, 1), count(_DIGIT[data]) / size, count(_OPEN[data]) / size]
    cols += [count(m[data]) / n for m in _MARKS.values()]
    cols += [count(data == 10) / n]
    cols += [count((data < 32) & ~tk.SPACE[data]) / size]
    length = w.end - w.start
    run_upper = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(upper, out=run_upper[1:])
    n_upper = run_upper[w.end] - run_upper[w.start]
    first, last = data[w.start], data[w.end - 1]
    cols += [over(length <= 2), over(length <= 3), over(length >= 12), over(length >= 20), over(length >= 40)]
    cols += [over((n_upper >= 2) & (2 * n_upper > length)), over(_UPPER[first]), over(_MARKS["symbol"][last]), over(_MARKS["shout"][last]), over((last == 46) | (last == 44))]
    h = tk.hash_spans(data, w.start, w.end)
    doc = w.doc()
    if len(h):
        next_same = np.zeros(len(h), dtype=bool)
        next_same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        _, later = tk.repeated(tk.doc_keys(h, doc))
        again = np.bincount(doc[later], minlength=t.n) / n
        starts, wdoc = tk.window_docs(w, 4)
        twice, _ = tk.repeated(tk.doc_keys(tk.ngram_hashes(h, 4)[starts], wdoc)) if len(starts) else (starts, starts)
        cover = tk.covered(starts[twice], 4, len(h)) if len(twice) else np.zeros(len(h), dtype=bool)
        cols += [over(next_same), again, again / np.sqrt(n), over(cover)]
    else:
        cols += [np.zeros(t.n)] * 4
    lines = tk.words_of(t, tk.LINE_END)
    ldoc = lines.doc()
    _, later = tk.repeated(tk.doc_keys(tk.hash_spans(data, lines.start, lines.end), ldoc))
    cols += [np.bincount(ldoc[later], minlength=t.n) / np.maximum(lines.counts, 1), n / np.maximum(lines.counts, 1)]
    return np.column_stack([c.astype(np.float64) for c in cols])


def batch_features(batch: pa.RecordBatch) -> np.ndarray:
    return np.concatenate([features(tk.texts_of(p.column("text"))) for p in tk.slices(batch, "text")])


@dataclass
class Model:
    knots: np.ndarray  # measurement x hinge
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x[:, :, None] - self.knots[None], 0.0).reshape(len(x), -1)
        return (np.concatenate([x, z], axis=1) - self.mean) / self.scale

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for i in range(0, len(x), 4096):
            out[i : i + 4096] = self.expand(x[i : i + 4096]) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def nnpu_fit(z_pos: np.ndarray, z_unl: np.ndarray, prior: float, steps: int = 400, rate: float = 0.04, decay: float = 1e-4, beta: float = 0.0) -> tuple[np.ndarray, float]:
    """Linear model minimising prior R_p+ + max(-beta, R_u- - prior R_p-) with logistic loss, by Adam on full batches.

    Where the bracket is below -beta, the step descends its negative instead (Kiryo et al., 2017).
    """
    z_pos, z_unl = z_pos.astype(np.float32), z_unl.astype(np.float32)
    w, b = np.zeros(z_pos.shape[1], dtype=np.float32), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda a: 1 / (1 + np.exp(-np.clip(a, -30, 30)))
    for k in range(1, steps + 1):
        ap, au = z_pos @ w + np.float32(b), z_unl @ w + np.float32(b)
        sp, su = sigmoid(ap), sigmoid(au)
        # losses: softplus(-a) for label +1, softplus(a) for label -1
        negative = np.logaddexp(0, au).mean() - prior * np.logaddexp(0, ap).mean()
        g_neg = np.append(z_unl.T @ su, su.sum()) / len(au) - prior * np.append(z_pos.T @ sp, sp.sum()) / len(ap)
        g_pos = -prior * np.append(z_pos.T @ (1 - sp), (1 - sp).sum()) / len(ap)
        g = -g_neg if negative < -beta else g_pos + g_neg
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - step[-1]
    return w.astype(np.float64), float(b)


def fit(x_pos: np.ndarray, x_unl: np.ndarray, prior: float | None, hinges: int = 8) -> Model:
    base = np.concatenate([x_pos, x_unl]) if len(x_pos) + len(x_unl) else np.zeros((1, x_pos.shape[1]))
    knots = np.quantile(base, (np.arange(hinges) + 0.5) / hinges, axis=0).T
    top = base.max(axis=0)
    knots = np.concatenate([knots, (knots[:, -1:] + top[:, None]) / 2], axis=1)
    model = Model(knots, np.zeros(1), np.ones(1), np.zeros(1), 0.0, prior or 0.5)
    if not len(x_pos) or not len(x_unl):
        model.weight = np.zeros(base.shape[1] * (1 + knots.shape[1]))
        return model
    model.mean, model.scale = 0.0, 1.0
    z = model.expand(base)
    model.mean, model.scale = z.mean(axis=0), np.maximum(z.std(axis=0), 1e-6)
    z_pos, z_unl = model.expand(x_pos), model.expand(x_unl)
    if prior is None:
        prior = class_prior(z_pos, z_unl)
    model.prior = min(max(prior, 0.01), 0.99)
    model.weight, model.bias = nnpu_fit(z_pos, z_unl, model.prior)
    return model


def _logistic(z: np.ndarray, y: np.ndarray, steps: int = 120, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam on full batches."""
    w, b = np.zeros(z.shape[1], dtype=np.float32), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for k in range(1, steps + 1):
        r = (1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30))) - y).astype(np.float32)
        g = np.append(z.T @ r / len(y) + 1e-3 * w, r.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - step[-1]
    return w, float(b)


def class_prior(z_pos: np.ndarray, z_unl: np.ndarray, folds: int = 3, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, from rows of features of both."""
    z_pos, z_unl = z_pos.astype(np.float32), z_unl.astype(np.float32)
    s_pos, s_unl = np.empty(len(z_pos)), np.empty(len(z_unl))
    for k in range(folds):
        p, u = np.arange(len(z_pos)) % folds == k, np.arange(len(z_unl)) % folds == k
        if p.all() or u.all():
            return 0.5
        both = np.concatenate([z_pos[~p], z_unl[~u]])
        w, b = _logistic(both, np.concatenate([np.ones((~p).sum()), np.zeros((~u).sum())]))
        s_pos[p], s_unl[u] = z_pos[p] @ w + b, z_unl[u] @ w + b
    s_pos, s_unl = np.sort(s_pos), np.sort(s_unl)
    above_pos = 1 - np.searchsorted(s_pos, s_pos) / len(s_pos)
    above_unl = 1 - np.searchsorted(s_unl, s_pos) / len(s_unl)
    margin = np.sqrt(np.log(4 / delta) / (2 * len(s_pos))) + np.sqrt(np.log(4 / delta) / (2 * len(s_unl)))
    at = int(np.argmin((above_unl + margin) / above_pos))
    return float(np.clip(above_unl[at] / above_pos[at], 0.02, 0.98))


def train(docs: DataFrame, labels: DataFrame, held_out: Column, sample: Sample = Sample()) -> Model:
    """docs: doc_id, text; labels: doc_id, label (1: positive). held_out: condition on doc_id of rows never learnt from.

    What reaches the driver is bounded by sample, whatever the tables hold.
    """
    positives = labels.where((F.col("label") == 1) & F.col("doc_id").isNotNull() & ~held_out).select(F.col("doc_id").cast("long").alias("c_id")).distinct()
    # bounded by sample.positives, so it can be broadcast
    positives = hashed_share(positives, sample.positives, 11, "c_id")
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    share = sample.unlabelled / max(rows.count(), 1)
    open_ = F.lit(True) if share >= 1 else below(share, 12, "doc_id", "text")
    role = F.when(F.col("c_id").isNotNull(), 1).otherwise(0) + F.when(open_, 2).otherwise(0)
    picked = rows.join(F.broadcast(positives), F.col("doc_id") == F.col("c_id"), "left").withColumn("role", role).where("role > 0").select("doc_id", F.xxhash64("text").alias("text_key"), "text", "role")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch_features(batch)
        values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_key", "role")), values], names=["doc_id", "text_key", "role", "x"])

    # repeated ids may make more rows of the sample; they are bounded again
    got = written(map_batches(picked, run, "doc_id long, text_key long, role int, x array<double>"), "quality-sample")
    got = hashed_share(got, sample.positives + sample.unlabelled, 13, "doc_id", "text_key").toPandas()
    got = got.drop_duplicates(["doc_id", "text_key"]).sort_values(["doc_id", "text_key"], kind="stable")
    width = features(tk.texts_of(pa.array([""], pa.string()))).shape[1]
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(len(got), width)
    role = got["role"].to_numpy()
    return fit(x[(role & 1) > 0], x[(role & 2) > 0], None)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(batch_features(batch)))], names=["doc_id", "score"])

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Rows of docs scored at least threshold, columns unchanged."""
    return keep_rows(docs, lambda batch: pa.array(model.score(batch_features(batch)) >= threshold) if batch.num_rows else pa.array([], pa.bool_()))


def held_out_third(doc_id: str = "doc_id") -> Column:
    return F.coalesce(id_bucket(F.col(doc_id), 3) == 1, F.lit(False))
