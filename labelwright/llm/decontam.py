"""Benchmark decontamination by template canonicalisation.

Words lose the marks at their ends and their case; numbers, names (capitalised words) and units become typed
placeholders. Windows of such templates are hash-joined between benchmark and documents. For every document and item
the matched windows are laid along their alignments: an item leaks if enough of its tokens are covered and the slots
are consistent, that is, one benchmark value always stands for one document value. So a passage is caught whether
copied or asked again with other names and figures. Windows also match word for word, whatever their tokens: an item dense
in numbers and names has no template to tell it by, only its words.

Scale: a benchmark of at most ``block_chars`` characters is one sorted index of windows, broadcast: documents are read
once and never shuffled, and only leaks leave the tasks. A larger benchmark is a table of windows, made by Spark and
joined with those of the documents by their hash. A bitmap of fixed size (``2 ** filter_bits`` bits, false positives only)
holds the benchmark's windows, so few windows of documents are shuffled; they travel once per different text, with the
values of their tokens, so neither side is read again to judge the slots. Item windows are laid in ``salt`` copies against
the documents' parts, so a passage that a third of all documents share is no single task.

Where one benchmark value stands for two document values equally often, either may count (a tie); the share that agrees
is the same. A text is handled whole in one task, in some forty times its bytes. An empty table of documents or items
gives an empty result. A null or empty text leaks nothing; null items are skipped, and so are items without a token. Items with fewer than
``min_tokens`` tokens, too short for a template, leak only word for word and whole. Repeated rows are reported once each. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import discard, keep_rows, written

# Words that are numbers, and words that are units after a number.
NUMBER_WORDS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
UNITS = (
    "mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound "
    "pounds oz ounce ounces ton tons tonne tonnes ml cl l litre litres liter liters gallon gallons s sec second seconds "
    "min minute minutes h hr hour hours day days week weeks month months year years cent cents dollar dollars euro euros "
    "percent degree degrees c f k hz khz mhz ghz w kw kwh v j kj cal kcal n pa kpa mph kmh kb mb gb tb"
).split()

LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3


@dataclass(frozen=True)
class Rules:
    window: int = 8
    #: Least literal tokens in a window, as a share.
    literal: float = 0.5
    #: Least share of an item's tokens covered by matched windows.
    coverage: float = 0.5
    #: Least share of slots that agree with one consistent replacement.
    consistent: float = 0.8
    min_tokens: int = 5
    #: Largest benchmark that is broadcast as an index; a larger one is joined.
    block_chars: int = 4_000_000
    filter_bits: int = 27
    salt: int = 16
    #: Most leaking texts that are broadcast to drop their documents.
    broadcast_rows: int = 100_000


def _hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), dtype=np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return np.sort(tk.hash_spans(data, np.concatenate([[0], ends[:-1]]), ends))


_NUMBER_HASHES, _UNIT_HASHES = _hashes(NUMBER_WORDS), _hashes(UNITS)


def _within(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return table[at] == h


@dataclass
class Templates:
    """Canonical tokens of a slice: template hash, value hash and slot type; document d has first[d]:first[d+1]."""

    token: np.ndarray
    value: np.ndarray
    slot: np.ndarray
    first: np.ndarray


def canonical(t: tk.Texts) -> Templates:
    w = tk.words_of(t)
    has, start, end = tk.cores(t, w)
    low = tk.lowered(t.data)
    value = tk.hash_spans(low, start, end)
    lead = t.data[start] if len(start) else np.empty(0, dtype=np.uint8)
    second = t.data[np.minimum(start + 1, len(t.data) - 1)] if len(start) else lead
    upper = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    number = ((lead >= 48) & (lead <= 57)) | _within(value, _NUMBER_HASHES)
    first = np.searchsorted(has, w.first)
    after_number = np.zeros(len(has), dtype=bool)
    after_number[1:] = number[:-1]
    after_number[first[:-1][first[:-1] < len(has)]] = False
    slot = np.where(number, NUMBER, np.where(after_number & _within(value, _UNIT_HASHES), UNIT, np.where(upper, NAME, LITERAL))).astype(np.int8)
    token = np.where(slot == LITERAL, value, slot.astype(np.uint64))
    return Templates(token, value, slot, first)


@dataclass
class Index:
    """A benchmark block: sorted window hashes by window length and whether of exact words, and the tokens of its items."""

    lengths: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray, np.ndarray]]  # hash, item, start
    ids: np.ndarray
    items: Templates
    maybe: dict[tuple[int, bool], np.ndarray]


def _windows(t: Templates, n: int, exact: bool, docs: np.ndarray | None, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and start within it of each n-token window: of its words, or of its template if it has enough literals."""
    span = tk.Words(t.token, t.token, t.first)
    starts, doc = tk.window_docs(span, n)
    if docs is not None:
        own = docs[doc]
        starts, doc = starts[own], doc[own]
    if not exact:
        literal = np.zeros(len(t.slot) + 1, dtype=np.int64)
        np.cumsum(t.slot == LITERAL, out=literal[1:])
        good = literal[starts + n] - literal[starts] >= rules.literal * n
        starts, doc = starts[good], doc[good]
    return tk.ngram_hashes(t.value if exact else t.token, n)[starts] if len(starts) else np.empty(0, dtype=np.uint64), doc, starts - t.first[doc]


def build_index(ids: list[int], texts: list[str], rules: Rules) -> Index:
    items = canonical(tk.texts_of(pa.array(texts, pa.large_string())))
    sizes = np.diff(items.first)
    lengths, maybe = {}, {}
    for exact, least in ((False, rules.min_tokens), (True, 1)):
        for n in sorted({int(min(rules.window, s)) for s in sizes if s >= least}):
            h, item, start = _windows(items, n, exact, (np.minimum(sizes, rules.window) == n) & (sizes >= least), rules)
            order = np.argsort(h, kind="stable")
            lengths[n, exact] = h[order], item[order], start[order]
            maybe[n, exact] = np.zeros(1 << 20, dtype=bool)
            maybe[n, exact][h >> np.uint64(44)] = True
    return Index(lengths, np.array(ids, dtype=np.int64), items, maybe)


def _consistent(value_a: np.ndarray, value_b: np.ndarray, kind: np.ndarray) -> float:
    """Share of slots that follow the commonest replacement of their benchmark value; names also the other way."""
    if not len(kind):
        return 1.0
    agree = np.zeros(len(kind), dtype=bool)
    for k in np.unique(kind):
        own = np.flatnonzero(kind == k)
        votes: dict[int, dict[int, int]] = {}
        for a, b in zip(value_a[own].tolist(), value_b[own].tolist()):
            votes.setdefault(a, {}).setdefault(b, 0)
            votes[a][b] += 1
        best = {a: max(v, key=lambda b: (v[b], b == a)) for a, v in votes.items()}
        taken: dict[int, int] = {}
        for a, b in best.items():
            taken.setdefault(b, a if b not in best or best.get(b) != b else b)
        for i in own:
            a, b = int(value_a[i]), int(value_b[i])
            agree[i] = best[a] == b and (k != NAME or taken[b] == a)
    return float(agree.mean())


def match(index: Index, t: Templates, rules: Rules) -> list[tuple[int, int, int, int, int, float, bool]]:
    """(document, item, tokens, covered, slots, consistent share, all values equal) of the leaks in a slice."""
    hits = []
    for (n, exact), (h, item, start) in index.lengths.items():
        g, doc, at = _windows(t, n, exact, None, rules)
        near = np.flatnonzero(index.maybe[n, exact][g >> np.uint64(44)])
        g, doc, at = g[near], doc[near], at[near]
        lo, hi = np.searchsorted(h, g), np.searchsorted(h, g, side="right")
        times = hi - lo
        if times.sum():
            which = np.repeat(np.arange(len(g)), times)
            place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)
            hits.append(np.column_stack([doc[which], item[place], at[which] - start[place], start[place], np.full(len(which), n), np.full(len(which), exact)]))
    if not hits:
        return []
    rows = np.concatenate(hits)
    rows = rows[np.lexsort(rows.T[::-1])]
    pair = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1), True])
    out = []
    for lo, hi in zip(pair[:-1], pair[1:]):
        d, i = int(rows[lo, 0]), int(rows[lo, 1])
        own = slice(int(index.items.first[i]), int(index.items.first[i + 1]))
        found = _leak(rows[lo:hi, 2:], index.items.value[own], index.items.slot[own], lambda place, d=d: t.value[t.first[d] + place], rules)
        if found:
            out.append((d, i, *found))
    return out


_NOWHERE = np.iinfo(np.int64).min
Leak = tuple[int, int, int, float, bool]


def _leak(rows: np.ndarray, value: np.ndarray, slot: np.ndarray, there: Callable[[np.ndarray], np.ndarray], rules: Rules) -> Leak | None:
    """What the matched windows of one document and item make of it, if it is a leak.

    rows are (shift, start, tokens, of exact words), sorted; value and slot are the item's, there gives the document's values.
    """
    # a window found by its template and by its words counts once; templates alone decide where words would spoil them
    some = rows[np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]]
    for part in (some, rows[rows[:, 3] == 0]):
        if len(part) and (found := _aligned(part, value, slot, there, rules)):
            return found
    return None


def _aligned(rows: np.ndarray, value: np.ndarray, slot: np.ndarray, there: Callable[[np.ndarray], np.ndarray], rules: Rules) -> Leak | None:
    # the alignment of each token of the item: the one with most windows wins
    shift = np.full(len(value), _NOWHERE)
    shifts, votes = np.unique(rows[:, 0], return_counts=True)
    for s in shifts[np.argsort(votes, kind="stable")]:
        own = rows[rows[:, 0] == s]
        shift[tk.covered(own[:, 1], int(own[0, 2]), len(value))] = s
    cover = np.flatnonzero(shift != _NOWHERE)
    if len(cover) < rules.coverage * len(value):
        return None
    slots = slot[cover] != LITERAL
    a, b = value[cover][slots], there(cover + shift[cover])[slots]
    share = _consistent(a, b, slot[cover][slots])
    return (len(value), len(cover), int(slots.sum()), share, bool((a == b).all())) if share >= rules.consistent else None


_SCHEMA = "doc_id long, item_id long, n_tokens long, n_covered long, n_slots long, consistency double, verbatim boolean"


_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_TYPES = [{"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[x.split()[1]] for x in _SCHEMA.split(", ")]


def _items(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.where("item_id is not null and text is not null").distinct()


def _index(items: DataFrame, rules: Rules) -> Index | None:
    """The whole benchmark as one index on the driver, None if it is too large for that."""
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) > rules.block_chars:
        return None
    rows = items.orderBy("item_id", "text").collect()
    return build_index([r.item_id for r in rows], [r.text for r in rows], rules)


def leaks(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document and benchmark item that it holds: how much is covered, and whether word for word."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    items = _items(benchmark)
    index = _index(items, rules)
    if index is None:
        found = leaking_texts(rows, items, rules)
        return _meet(rows.select("doc_id", text_key("text").alias("key")), found, "key", "inner", rules).select(*_NAMES)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for piece in tk.slices(batch, "text"):
                own = piece.column("doc_id").to_pylist()
                found += [(own[d], int(shared.value.ids[i]), *x) for d, i, *x in match(shared.value, canonical(tk.texts_of(piece.column("text"))), rules)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 7, _TYPES)], names=_NAMES)

    return rows.mapInArrow(run, _SCHEMA)


def keep_clean(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Rows of docs that hold no benchmark item, columns unchanged."""
    items = _items(benchmark)
    index = _index(items, rules)
    if index is None:
        found = leaking_texts(docs.select(F.col("text").cast("string").alias("text")), items, rules)
        name = "text_key"
        while name in {c.lower() for c in docs.columns}:
            name += "_"
        own = docs.withColumn(name, text_key("text"))
        return _meet(own, found.select(F.col("key").alias(name)).distinct(), name, "left_anti", rules).drop(name, name + "_salt")
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def clean(batch: pa.RecordBatch) -> pa.Array:
        mask, at = np.ones(batch.num_rows, dtype=bool), 0
        for piece in tk.slices(batch, "text"):
            for d, *_ in match(shared.value, canonical(tk.texts_of(piece.column("text"))), rules):
                mask[at + d] = False
            at += piece.num_rows
        return pa.array(mask)

    return keep_rows(docs, clean)


# A benchmark beyond one index: windows of both sides meet in a join.


def text_key(text: str) -> Column:
    """What tells a text from any other: its SHA-256; null for a null text."""
    return F.unhex(F.sha2(F.col(text).cast("string").cast("binary"), 256))


def _salts(rules: Rules) -> Column:
    return F.explode(F.expr(f"sequence(0L, {rules.salt - 1}L)"))


def _meet(rows: DataFrame, found: DataFrame, key: str, how: str, rules: Rules) -> DataFrame:
    """Join with the texts that leak: broadcast where they are counted to be few, else copied to the salts of a key's rows."""
    if found.count() <= rules.broadcast_rows:
        return rows.join(F.broadcast(found), key, how)
    salt = key + "_salt"
    spread = F.pmod(F.xxhash64(key, *(c for c in rows.columns if c in ("doc_id", "source"))), F.lit(rules.salt))
    copies = found.withColumn(salt, _salts(rules))
    return rows.withColumn(salt, spread).join(copies, [key, salt], how)


def _bytes(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _rows_of(t: Templates, n: int, exact: bool, own: tuple[np.ndarray, np.ndarray, np.ndarray], names: dict[str, pa.Array]) -> dict[str, pa.Array]:
    """Columns of some windows: who holds them (names, by document), their length, hash, place and the values of their tokens."""
    h, doc, start = own
    tokens = (t.first[doc] + start)[:, None] + np.arange(n)
    out = {c: a.take(pa.array(doc)) for c, a in names.items()}
    out |= {"n": pa.array(np.full(len(h), n, dtype=np.int32)), "exact": pa.array(np.full(len(h), exact)), "h": pa.array(h.view(np.int64)), "start": pa.array(start.astype(np.int64))}
    return out | {"value": _bytes(t.value[tokens]), "slot": _bytes(t.slot[tokens])}


_WINDOW = "n int, exact boolean, h long, start long, value binary"


def _item_windows(items: DataFrame, rules: Rules) -> DataFrame:
    shift = np.uint64(64 - rules.filter_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tk.slices(batch, "text"):
                t = canonical(tk.texts_of(piece.column("text")))
                sizes = np.diff(t.first)
                names = {"item_id": piece.column("item_id"), "item": piece.column("item"), "size": pa.array(sizes.astype(np.int64))}
                for exact, least in ((False, rules.min_tokens), (True, 1)):
                    for n in np.unique(np.minimum(sizes[sizes >= least], rules.window)).tolist():
                        own = _windows(t, n, exact, (np.minimum(sizes, rules.window) == n) & (sizes >= least), rules)
                        if len(own[0]):
                            yield pa.RecordBatch.from_pydict(_rows_of(t, n, exact, own, names) | {"cell": pa.array((own[0] >> shift).view(np.int64))})

    return items.withColumn("item", text_key("text")).mapInArrow(run, f"item_id long, item binary, size long, {_WINDOW}, slot binary, cell long")


def _bitmap(windows: DataFrame, rules: Rules) -> np.ndarray:
    """One bit for each leading part of a hash that some window has: at most 2 ** (filter_bits - 6) rows come to the driver."""
    cells = windows.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(max(1, 1 << (rules.filter_bits - 6)), dtype=np.int64)
    out[cells["word"].to_numpy()] = cells["bits"].to_numpy()
    return out.view(np.uint64)


def leaking_texts(docs: DataFrame, items: DataFrame, rules: Rules) -> DataFrame:
    """key (of a text) and the item that it holds, with what leaks() tells of the two."""
    table = written(_item_windows(items, rules), "item-windows")
    kinds = sorted((r.n, r.exact) for r in table.select("n", "exact").distinct().collect())
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(table, rules))
    shift = np.uint64(64 - rules.filter_bits)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tk.slices(batch, "text"):
                t = canonical(tk.texts_of(piece.column("text")))
                for n, exact in kinds:
                    h, doc, start = _windows(t, n, exact, None, rules)
                    cell = h >> shift
                    near = np.flatnonzero((bits.value[cell >> np.uint64(6)] >> (cell & np.uint64(63))) & np.uint64(1))
                    if len(near):
                        got = _rows_of(t, n, exact, (h[near], doc[near], start[near]), {"key": piece.column("key")})
                        del got["slot"]
                        yield pa.RecordBatch.from_pydict(got)

    own = docs.where("text is not null").select(text_key("text").alias("key"), "text").mapInArrow(windows, f"key binary, {_WINDOW}").distinct()
    own = own.select("key", "n", "exact", "h", F.col("start").alias("at"), F.col("value").alias("there"), F.pmod(F.xxhash64("key"), F.lit(rules.salt)).alias("salt"))
    copies = table.drop("cell").withColumn("salt", _salts(rules))
    hits = own.join(copies, ["n", "exact", "h", "salt"]).drop("h", "salt")
    hits = hits.repartition("key", "item_id", "item").sortWithinPartitions("key", "item_id", "item")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []
        for batch in batches:
            first = _group_starts(batch)
            if left and len(first) and not _same(left[-1], batch):
                yield _judged(left, rules)
                left = []
            # rows of the last group may go on in the next batch
            if len(first) > 1:
                yield _judged([*left, batch.slice(0, int(first[-1]))], rules)
                left, batch = [], batch.slice(int(first[-1]))
            left += [batch] if batch.num_rows else []
        if left:
            yield _judged(left, rules)

    found = written(hits.mapInArrow(judge, f"key binary, {_SCHEMA.split(', ', 1)[1]}"), "leaking-texts")
    discard(table)
    return found


_GROUP = ("key", "item_id", "item")


def _group_starts(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Where a text and item begin that differ from those of the row before."""
    n = rows.num_rows
    new = np.ones(n, dtype=bool)
    if n > 1:
        new[1:] = False
        for c in _GROUP:
            new[1:] |= pc.not_equal(rows.column(c).slice(1), rows.column(c).slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _same(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
    return all(a.column(c)[a.num_rows - 1] == b.column(c)[0] for c in _GROUP)


def _judged(batches: list[pa.RecordBatch], rules: Rules) -> pa.RecordBatch:
    """The leaks among whole groups of hits."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    number = {c: rows.column(c).to_numpy().astype(np.int64) for c in ("n", "exact", "start", "at", "size")}
    blob = {c: rows.column(c).to_pylist() for c in ("value", "there", "slot")}
    first = [*_group_starts(rows).tolist(), rows.num_rows]
    found, names = [], []
    for lo, hi in zip(first[:-1], first[1:]):
        n, size, start, at = int(number["n"][lo]), int(number["size"][lo]), number["start"][lo:hi], number["at"][lo:hi]
        value, slot = np.zeros(size, dtype=np.uint64), np.full(size, LITERAL, dtype=np.int8)
        place = start[:, None] + np.arange(n)
        value[place] = np.frombuffer(b"".join(blob["value"][lo:hi]), dtype=np.uint64).reshape(-1, n)
        slot[place] = np.frombuffer(b"".join(blob["slot"][lo:hi]), dtype=np.int8).reshape(-1, n)
        spots, where = np.unique(at[:, None] + np.arange(n), return_index=True)
        values = np.frombuffer(b"".join(blob["there"][lo:hi]), dtype=np.uint64)[where]
        own = np.column_stack([at - start, start, np.full(hi - lo, n), number["exact"][lo:hi]])
        own = own[np.lexsort(own.T[::-1])]
        leak = _leak(own, value, slot, lambda p, spots=spots, values=values: values[np.searchsorted(spots, p)], rules)
        if leak:
            found.append(leak)
            names.append(lo)
    keys = rows.select(["key", "item_id"]).take(pa.array(names, pa.int64())).combine_chunks()
    columns = [keys.column("key"), keys.column("item_id"), *(pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 5, _TYPES[2:]))]
    out = pa.table(columns, names=["key", *_NAMES[1:]]).combine_chunks().to_batches()
    return out[0] if out else pa.RecordBatch.from_arrays([pa.array([], c.type) for c in columns], names=["key", *_NAMES[1:]])
