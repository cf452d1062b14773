"""Quality rules by repetition coverage.

For every text, rolling 64-bit hashes of its word n-grams of several lengths are sorted within the document; the
characters of the words inside n-grams found twice or more, and inside lines seen before, are set against the
characters of all words. A document is kept if it passes the base rules and no share is above its limit.

Rows are scored one by one, without a shuffle: skew, copies and clashing columns play no part. A null or empty text
has no words, so it fails the base rules; repeated rows get equal results; a share equal to its limit passes; an empty
table gives an empty result. A text is handled whole in one task, in some thirty times its bytes.
Equality of n-grams is equality of 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkernel as tk
from .common import map_batches

# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


@dataclass(frozen=True)
class Limits:
    """Largest share of word characters allowed inside repeated n-grams of each length, and inside repeated lines."""

    min_words: int = 10
    base_percent: int = 20
    ngrams: tuple[tuple[int, float], ...] = ((5, 0.20), (6, 0.19), (7, 0.18), (8, 0.17), (9, 0.16), (10, 0.15))
    lines: float = 0.30


def measure(t: tk.Texts, limits: Limits) -> dict[str, np.ndarray]:
    w = tk.words_of(t)
    lead = np.zeros(len(t.data) + 1, dtype=np.int64)
    np.cumsum((t.data & 0xC0) != 0x80, out=lead[1:])
    chars = lead[w.end] - lead[w.start]
    out = {
        "n_words": w.counts.astype(np.int64),
        "word_chars": tk.per_doc(chars, w.first),
        "n_symbols": tk.per_doc(_SYMBOL[t.data].astype(np.int64), t.offsets),
    }

    lines = tk.words_of(t, tk.LINE_END)
    first, last = np.searchsorted(w.start, lines.start), np.searchsorted(w.start, lines.end)
    full = last > first
    doc = lines.doc()[full]
    _, later = tk.repeated(tk.doc_keys(tk.hash_spans(t.data, lines.start, lines.end)[full], doc))
    out["n_dup_lines"] = np.bincount(doc[later], minlength=t.n)
    running = np.zeros(len(chars) + 1, dtype=np.int64)
    np.cumsum(chars, out=running[1:])
    in_lines = (running[last] - running[first])[full]
    out["dup_line_chars"] = np.bincount(doc[later], weights=in_lines[later], minlength=t.n).astype(np.int64)

    h = tk.hash_spans(t.data, w.start, w.end)
    # an n-gram can only repeat where the shorter one that begins it repeats
    found = None
    for n, _ in sorted(limits.ngrams):
        starts, doc = tk.window_docs(w, n)
        if found is not None:
            inside = np.isin(starts, found, assume_unique=True) if len(found) else np.zeros(len(starts), dtype=bool)
            starts, doc = starts[inside], doc[inside]
        twice, _ = tk.repeated(tk.doc_keys(tk.ngram_hashes(h, n)[starts], doc)) if len(starts) else (starts, starts)
        found = np.sort(starts[twice])
        cover = tk.covered(found, n, len(h)) if len(found) else np.zeros(len(h), dtype=bool)
        out[f"dup_{n}gram_words"] = tk.per_doc(cover.astype(np.int64), w.first)
        out[f"dup_{n}gram_chars"] = tk.per_doc(np.where(cover, chars, 0), w.first)
    return out


def verdicts(m: dict[str, np.ndarray], limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    n_repeat = m[f"dup_{min(n for n, _ in limits.ngrams)}gram_words"]
    failed = (m["n_words"] < limits.min_words) | (100 * n_repeat > limits.base_percent * m["n_words"])
    ok = m["dup_line_chars"] <= limits.lines * m["word_chars"]
    for n, share in limits.ngrams:
        ok &= m[f"dup_{n}gram_chars"] <= share * m["word_chars"]
    return failed, ~failed & ok


def repetition_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per row of docs (doc_id, text): counts, characters in repeats, base_failed, kept."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = ["dup_line_chars", *(f"dup_{n}gram_chars" for n, _ in limits.ngrams)]
    smallest = min(n for n, _ in limits.ngrams)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for piece in tk.slices(batch, "text"):
            m = measure(tk.texts_of(piece.column("text")), limits)
            m["n_repeat_words"] = m[f"dup_{smallest}gram_words"]
            failed, kept = verdicts(m, limits)
            parts.append([m[c] for c in names] + [failed, kept] + [m[c] for c in more])
        columns = [pa.array(np.concatenate(x)) for x in zip(*parts)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *names, "base_failed", "kept", *more])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in names) + ", base_failed boolean, kept boolean, " + ", ".join(f"{c} long" for c in more)
    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, schema)
