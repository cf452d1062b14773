"""Toxicity by weak supervision.

Many weak voters each fire or abstain on a document: the words of a fixed lexicon, words and word beginnings that go
with the training labels (labels choose them, and nothing more), and patterns (capitals, exclamation, masked letters,
insults that are dense, shouted, or aimed at a person). A generative label model, fitted by expectation maximisation to
the votes alone, has as parameters the rates at which each voter fires under both classes, and correlations: under
each class a voter's rate depends on whether the voter it is most bound to has fired, along the tree of greatest mutual
information given the class. Its posterior labels train a linear classifier on the same words and patterns, whose slope
and shift are then calibrated on the training labels; it scores every document.

Training uses about ``Setting.labelled`` labelled documents, chosen by hash, which bounds what reaches the driver also
where ids repeat; what is learnt comes from them, with at most ``Setting.features`` features and ``Setting.voters``
voters. Scoring is row by row, without a shuffle, so skew and copies play no part. A text is handled whole in one task,
in some thirty times its bytes.

A null or empty text fires no voter and gets the score of such texts. Null labels are left out; several labels for one
doc_id are all used. With labels of one class, or none, the lexicon alone votes. Repeated rows get equal scores, and
ties in the score are texts with equal votes; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import hashed_share, id_bucket, keep_rows, map_batches, written

# A lexicon of insults.
LEXICON = (
    "idiot idiots stupid moron morons dumb loser losers scum trash garbage filth filthy vermin worthless pathetic "
    "disgusting clown clowns jerk fool fools imbecile cretin dimwit degenerate scumbag lowlife parasite retard "
    "idiota imbécil estúpido estúpida basura dummkopf idioten abschaum dumm widerlich imbécile débile ordure connard"
).split()
# Words for the person spoken to.
PERSON = "you your yours you're du dich dein deine ihr tu te vous toi votre tú usted ustedes eres".split()
#: Bytes of the word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class Setting:
    labelled: int = 12_000
    features: int = 1024
    voters: int = 256
    #: Least toxic documents that a mined feature occurs in, and least lower bound of its precision.
    support: int = 5
    precision: float = 0.55
    rounds: int = 15


def _word_hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), dtype=np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return tk.hash_spans(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)


LEXICON_HASHES, PERSON_HASHES = _word_hashes(LEXICON), _word_hashes(PERSON)


def token_features(t: tk.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes and documents, one of each for every word and every beginning shorter than its word."""
    w = tk.words_of(t)
    has, start, end = tk.cores(t, w)
    doc = w.doc()[has]
    low = tk.lowered(t.data)
    out, docs = [tk.hash_spans(low, start, end)], [doc]
    for k in PREFIXES:
        longer = end - start > k
        h = tk.hash_spans(low, start[longer], start[longer] + k)
        out.append(tk.mix64(h + np.uint64(k)))
        docs.append(doc[longer])
    return np.concatenate(out), np.concatenate(docs)


def _among(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which hashes are in a short list."""
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[words >> np.uint64(48)] = True
    out = maybe[h >> np.uint64(48)]
    near = np.flatnonzero(out)
    out[near] = np.isin(h[near], words)
    return out


def patterns(t: tk.Texts) -> np.ndarray:
    """Pattern voters by document."""
    data, size = t.data, np.maximum(np.diff(t.offsets), 1)
    count = lambda mask: tk.per_doc(mask.astype(np.int64), t.offsets)
    near = lambda mask, k: np.r_[mask[k:], np.zeros(min(k, len(mask)), dtype=bool)]
    capital, mark = (data >= 65) & (data <= 90), data == 33
    letter = capital | ((data >= 97) & (data <= 122))
    masked = letter & near((data == 42) | (data == 64), 1) & (near(letter, 2) | near((data == 42) & near(letter, 1), 2))
    w = tk.words_of(t)
    has, start, end = tk.cores(t, w)
    h, doc = tk.hash_spans(tk.lowered(data), start, end), w.doc()[has]
    insult, person = _among(h, LEXICON_HASHES), _among(h, PERSON_HASHES)
    aimed = np.zeros(len(h), dtype=bool)
    for k in (1, 2, 3, 4):
        aimed[k:] |= insult[k:] & person[:-k] & (doc[k:] == doc[:-k])
    loud = insult & capital[start] & capital[np.maximum(end - 1, start)] if len(h) else insult
    per = lambda mask: np.bincount(doc[mask], minlength=t.n)
    n, insults = np.maximum(np.bincount(doc, minlength=t.n), 1), per(insult)
    return np.column_stack([
        count(capital) > 0.5 * size, count(mark) > 0.02 * size, count(mark & near(mark, 1) & near(mark, 2)) > 0, count(mark & near(data == 63, 1)) > 0, count(masked) > 0,
        insults >= 1, insults >= 2, insults > 0.01 * n, per(loud) > 0, per(aimed) > 0,
    ])


N_PATTERNS = 10


@dataclass
class Lookup:
    """Sorted feature hashes, with a bit table in front."""

    hashes: np.ndarray
    maybe: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray) -> Lookup:
        maybe = np.zeros(1 << 20, dtype=bool)
        maybe[hashes >> np.uint64(44)] = True
        return cls(hashes, maybe)

    def presence(self, t: tk.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, feature index) pairs of a slice."""
        h, doc = token_features(t)
        near = np.flatnonzero(self.maybe[h >> np.uint64(44)])
        h, doc = h[near], doc[near]
        if not len(self.hashes) or not len(h):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        pair = np.unique(doc[hit] * np.int64(len(self.hashes)) + at[hit])
        return pair // len(self.hashes), pair % len(self.hashes)


@dataclass
class LabelModel:
    """P(votes | class) along a tree of voters: each fires at a rate that depends on the class and on its parent's vote."""

    parent: np.ndarray  # of each voter; -1 at the root
    rate: np.ndarray  # voter x class x parent's vote: P(fire)
    fires: np.ndarray  # class x voter: P(fire) whatever the parent does
    correlation: np.ndarray  # class x voter: with the parent's vote, given the class
    prior: float

    def logit(self, votes: np.ndarray) -> np.ndarray:
        """Log odds of class 1 given the votes."""
        ratio = np.log(self.rate[:, 1] / self.rate[:, 0])
        silent = np.log((1 - self.rate[:, 1]) / (1 - self.rate[:, 0]))
        above = np.where(self.parent >= 0, votes[:, self.parent], 0)
        out = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for vote, table in ((1, ratio), (0, silent)):
            for up in (1, 0):
                out += ((votes == vote) & (above == up)) @ table[:, up]
        return out


def _tree(both: np.ndarray, single: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Parents along the tree of greatest mutual information given the class. both: class x voter x voter, votes of both; single: class x voter."""
    m = single.shape[1]
    gain = np.zeros((m, m))
    for y in (0, 1):
        p11, a = both[y] / mass[y], single[y] / mass[y]
        cells = (p11, a[:, None] - p11, a[None] - p11, 1 - a[:, None] - a[None] + p11)
        means = (a[:, None] * a[None], a[:, None] * (1 - a[None]), (1 - a[:, None]) * a[None], (1 - a[:, None]) * (1 - a[None]))
        for c, e in zip(cells, means):
            c = np.maximum(c, 0)
            gain += mass[y] * np.where(c > 1e-12, c * np.log(np.maximum(c, 1e-12) / np.maximum(e, 1e-12)), 0)
    parent = np.full(m, -1)
    best, link, out = gain[0].copy(), np.zeros(m, dtype=np.int64), np.ones(m, dtype=bool)
    out[0] = False
    for _ in range(m - 1):
        i = int(np.argmax(np.where(out, best, -np.inf)))
        parent[i], out[i] = link[i], False
        closer = gain[i] > best
        best[closer], link[closer] = gain[i][closer], i
    return parent


def fit_label_model(votes: np.ndarray, start: np.ndarray, rounds: int, shrink: float = 2.0) -> tuple[LabelModel, np.ndarray]:
    """EM over 0/1 votes from starting posteriors, without any label. Returns the model and the posteriors.

    Rates given the parent's vote are shrunk to the voter's own by ``shrink`` rows; no voter is taken to speak for class 0.
    """
    n, m = votes.shape
    q, model = np.clip(start, 0.02, 0.98), None
    for _ in range(rounds):
        share = np.stack([1 - q, q])
        mass = share.sum(axis=1)
        single = share @ votes
        fires = np.clip((single + 0.1) / (mass[:, None] + 1.0), 1e-4, 1 - 1e-4)
        fires[1] = np.maximum(fires[1], fires[0])
        both = np.stack([(votes * s[:, None]).T @ votes for s in share])
        parent = _tree(both, single, np.maximum(mass, 1e-9))
        up = np.maximum(parent, 0)
        with_up = both[:, np.arange(m), up]
        seen = np.stack([mass[:, None] - single[:, up], single[:, up]], axis=2)  # class x voter x parent's vote
        fired = np.stack([single - with_up, with_up], axis=2)
        rate = (fired + shrink * fires[:, :, None]) / (seen + shrink)
        rate[:, parent < 0] = fires[:, parent < 0, None]
        rate = np.clip(np.maximum(rate, 0), 1e-4, 1 - 1e-4)
        a, b = single / np.maximum(mass, 1e-9)[:, None], single[:, up] / np.maximum(mass, 1e-9)[:, None]
        spread = np.sqrt(np.maximum(a * (1 - a) * b * (1 - b), 1e-12))
        correlation = np.where(parent < 0, 0.0, (with_up / np.maximum(mass, 1e-9)[:, None] - a * b) / spread)
        model = LabelModel(parent, rate.transpose(1, 0, 2), fires, correlation, float(np.clip(q.mean(), 0.005, 0.995)))
        q = 1 / (1 + np.exp(-np.clip(model.logit(votes), -30, 30)))
    return model, q


@dataclass
class Classifier:
    lookup: Lookup
    weight: np.ndarray
    pattern_weight: np.ndarray
    bias: float

    def score(self, t: tk.Texts) -> np.ndarray:
        doc, feature = self.lookup.presence(t)
        z = np.bincount(doc, weights=self.weight[feature], minlength=t.n) + patterns(t) @ self.pattern_weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score_batch(self, batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([self.score(tk.texts_of(p.column("text"))) for p in tk.slices(batch, "text")]) if batch.num_rows else np.empty(0)


def _fit_linear(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.1, decay: float = 2e-5) -> tuple[np.ndarray, float]:
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        r = (p - y).astype(np.float32)
        g = np.append(x.T @ r / len(y) + decay * w, r.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        s = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = (w - s[:-1]).astype(np.float32), b - s[-1]
    return w, float(b)


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic of z that fits 0/1 labels, by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - y) * z).mean() + 1e-3 * (a - 1), (p - y).mean()])
        h = np.array([[(s * z * z).mean() + 1e-2, (s * z).mean()], [(s * z).mean(), s.mean() + 1e-4]])
        a, b = np.array([a, b]) - 0.7 * np.linalg.solve(h, g)
    return float(max(a, 0.05)), float(b)


def train(docs: DataFrame, labels: DataFrame, held_out: Column, setting: Setting = Setting()) -> Classifier:
    """docs: doc_id, text; labels: doc_id, label (1: toxic). held_out: condition on doc_id of rows never learnt from."""
    known = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out).select(F.col("doc_id").cast("long").alias("c_id"), F.col("label").cast("int").alias("label")).distinct()
    # bounded by setting.labelled, so it can be broadcast
    chosen = hashed_share(known, setting.labelled, 3, "c_id")
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("c_id")).select("doc_id", "text", "label")
    # repeated ids may make more rows of it; equal texts teach once, and the rest is bounded again
    sample = written(sample, "toxicity-sample").withColumn("text_key", F.xxhash64("text")).dropDuplicates(["text_key", "label"])
    sample = written(hashed_share(sample, 2 * setting.labelled, 4, "doc_id", "text_key"), "toxicity-sample")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, hits, seen = [], [], []
        label = np.nan_to_num(batch.column("label").to_numpy(zero_copy_only=False)).astype(np.int64)
        at = 0
        for piece in tk.slices(batch, "text"):
            h, doc = token_features(tk.texts_of(piece.column("text")))
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.empty(0, dtype=bool)
            h, doc = h[new], doc[new]
            head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, dtype=np.int64)
            hashes.append(h[head])
            hits.append(np.add.reduceat(label[at + doc], head) if len(h) else head)
            seen.append(np.diff(np.r_[head, len(h)]))
            at += piece.num_rows
        h, p, n = np.concatenate(hashes), np.concatenate(hits), np.concatenate(seen)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(p.astype(np.int64)), pa.array(n.astype(np.int64))], names=["feature", "hits", "seen"])

    counts = map_batches(sample, count, "feature long, hits long, seen long")
    totals = sample.agg(F.sum("label"), F.count(F.lit(1))).first()
    base = float(totals[0] or 0) / max(totals[1], 1)
    counts = counts.groupBy("feature").agg(F.sum("hits").alias("hits"), F.sum("seen").alias("seen"))
    p, n = F.col("hits") / F.col("seen"), F.col("seen")
    bound = (p + 1.92 / n - 1.96 * F.sqrt(p * (1 - p) / n + 0.96 / (n * n))) / (1 + 3.84 / n)
    mined = counts.where((F.col("hits") >= setting.support) & (bound > max(setting.precision, (1 + base) / 2 if base > 0.3 else 0.0))).orderBy(F.desc("hits"), "feature").limit(setting.features).collect()
    hashes = np.unique(np.concatenate([LEXICON_HASHES, np.array([r.feature for r in mined], dtype=np.int64).view(np.uint64)]))
    lookup = Lookup.of(hashes)

    def present(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, pats = [], []
        for piece in tk.slices(batch, "text"):
            t = tk.texts_of(piece.column("text"))
            doc, feature = lookup.presence(t)
            found += np.split(feature, np.searchsorted(doc, np.arange(1, t.n)))
            pats.append(patterns(t))
        pats = np.concatenate(pats)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array([x.tolist() for x in found], pa.list_(pa.int64())), pa.array([x.tolist() for x in pats], pa.list_(pa.bool_()))],
            names=["doc_id", "label", "features", "patterns"],
        )

    got = map_batches(sample, present, "doc_id long, label int, features array<long>, patterns array<boolean>").toPandas().sort_values(["doc_id", "label"], kind="stable")
    n, y = len(got), got["label"].to_numpy(dtype=np.float64)
    x = np.zeros((n, len(hashes) + N_PATTERNS), dtype=np.float32)
    for k, (f, pat) in enumerate(zip(got["features"], got["patterns"])):
        x[k, np.asarray(f, dtype=np.int64)] = 1
        x[k, len(hashes) :] = pat
    lexical = np.isin(hashes, LEXICON_HASHES)
    if n == 0 or y.sum() == 0 or y.sum() == n:
        return Classifier(lookup, np.where(lexical, 4.0, 0.0), np.zeros(N_PATTERNS), -3.0)
    # voters: the lexicon, the patterns, and the mined features with most hits
    support = x[:, : len(hashes)].T @ y.astype(np.float32)
    voters = np.flatnonzero((support > 0) & (lexical | (np.argsort(np.argsort(-support)) < setting.voters)))
    votes = np.concatenate([x[:, voters], x[:, len(hashes) :]], axis=1).astype(np.float64)
    # EM starts from the votes of the words, all of which were chosen to speak for class 1
    start = np.where(votes[:, : len(voters)].any(axis=1), 0.9, 0.05)
    _, q = fit_label_model(votes, start, setting.rounds)
    w, b = _fit_linear(x, q)
    slope, shift = _calibrate(x @ w + b, y)
    w, b = w * slope, b * slope + shift
    return Classifier(lookup, w[: len(hashes)].astype(np.float64), w[len(hashes) :].astype(np.float64), float(b))


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, score for every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score_batch(batch))], names=["doc_id", "score"])

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, "doc_id long, score double")


def keep_civil(docs: DataFrame, model: Classifier, threshold: float = 0.3) -> DataFrame:
    """Rows of docs scored below threshold, columns unchanged."""
    return keep_rows(docs, lambda batch: pa.array(model.score_batch(batch) < threshold))


def held_out_quarter(doc_id: str = "doc_id") -> Column:
    return F.coalesce(id_bucket(F.col(doc_id), 4) == 2, F.lit(False))
