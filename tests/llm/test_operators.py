"""Each training-data operator against brute force, and on nulls, empty and long texts, repeats, empty tables, clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelwright.llm import components, decontam, html_extract, lm_score, lsh_forest, mixing, pu_quality, queries, repetition, sharding, superkmer, toxicity
from labelwright.llm import textkernel as tk

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("size", "score", "shard", "slot", "row", "node", "keys", "host", "bucket", "taken")),
    ]
)


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    base = [words(60, s) for s in range(12)]
    passage = words(55, 99)
    rows = [(i, t, "src%d" % (i % 3)) for i, t in enumerate(base)]
    rows += [(20, base[0], "src0"), (21, base[0], None), (22, base[1].replace("a1", "zz", 1) + " tail", "src1")]
    rows += [(23, base[2] + "\n" + passage, "src2"), (24, passage + " " + base[3], "src0"), (25, None, "src0"), (26, "", "src1"), (27, " \n\t ", "src1")]
    rows += [(28, "one two three", "src9"), (29, "é€ Ünïcode wörds " * 9, "src9"), (30, words(9000, 5, 50_000), "src0"), (31, "same line\nsame line\nother", "src1"), (32, "x " * 40, "src1")]
    rows += [(5, base[5], "src2"), (33, base[4], "src1"), (None, base[6], "src0"), (34, base[7].upper(), "src0")]
    return [(i, t, "en", s, len(t or ""), *["7"] * 10) for i, t, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return (text or "").encode().split()


def test_words_and_hashes_match_python():
    texts = ["a b  c", "", None, " lead trail ", "é€ x y\x0bz", "q" * 50 + " q"]
    t = tk.texts_of(pa.array(texts, pa.string()))
    w = tk.words_of(t)
    got = [[bytes(t.data[a:b]) for a, b in zip(w.start[w.first[d] : w.first[d + 1]], w.end[w.first[d] : w.first[d + 1]])] for d in range(len(texts))]
    assert got == [split(x) for x in texts]
    h = tk.hash_spans(t.data, w.start, w.end)
    flat = [x for d in got for x in d]
    assert len(set(h.tolist())) == len(set(flat))
    for n in (1, 2, 3, 5, 20):
        seq = np.array([1, 2, 3] * 12, dtype=np.uint64)
        g = tk.ngram_hashes(seq, n)
        grams = [tuple(seq[i : i + n].tolist()) for i in range(len(seq) - n + 1)]
        assert len(g) == len(grams) and len(set(zip(grams, g.tolist()))) == len(set(grams)) == len(set(g.tolist()))


def test_long_spans_hash_as_short_ones():
    data = np.frombuffer(("ab " * 900_000 + "zz").encode(), dtype=np.uint8)
    t = tk.Texts(data, np.array([0, len(data)]))
    w = tk.words_of(t)
    assert len(set(tk.hash_spans(data, w.start, w.end).tolist())) == 2


# --- 1


def test_mixing(docs, nothing, spark):
    rows = mixing.mix(docs, mixing.curriculum).collect()
    assert len(rows) == len(corpus())
    sizes = defaultdict(int)
    for _, t, _, s, *_ in corpus():
        sizes[s] += len(split(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, total = {}, 1.5 * sum(sizes.values())
    free = set(order)
    while True:
        share = (total - sum(target.values())) / sum(weights[s] for s in free)
        over = [s for s in free if share * weights[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            free.discard(s)
    target |= {s: share * weights[s] for s in free}
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert len(r.positions) == (-(-r.taken // r.size) if r.size else 0)
        assert all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 1
    first = [r.positions[0] for r in rows if r.positions]
    assert first == sorted(first)
    assert rows == mixing.mix(docs.repartition(5), mixing.curriculum).collect() or sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5), mixing.curriculum).collect()))
    assert mixing.mix(nothing, mixing.curriculum).collect() == []


def test_mixing_positions_against_numeric_inversion(docs):
    """Each copy's progress by bisection of its source's integral, its position from the demand of all sources up to there."""
    plans = [mixing.Schedule(((0.0, 1.0), (0.3, 5.0), (0.6, 0.0), (1.0, 2.0))), mixing.ramp(1.0, 0.5, 1.5), mixing.constant(2.0), mixing.Schedule(((0.0, 4.0), (0.5, 1.0), (1.0, 1.0)))]
    schedule = lambda k: plans[k % 4]
    rows = mixing.mix(docs, schedule).collect()
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    target = {r.source: r.target for r in rows}

    def spent(s, x, steps=4000):
        knots = np.array(schedule(sources.index(s)).knots)
        grid = np.linspace(0, x, steps + 1)
        return float(np.trapezoid(np.interp(grid, knots[:, 0], knots[:, 1]), grid))

    before, whole, tried = defaultdict(int), sum(target.values()), 0
    for r in sorted(rows, key=lambda r: hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest()):
        at, before[r.source] = before[r.source], before[r.source] + r.size
        alone = sum(x.doc_id == r.doc_id for x in rows) == 1
        for k, position in enumerate(r.positions if alone else []):
            share = min(1.0, (at + k * r.source_size) / r.target)
            lo, hi, total = 0.0, 1.0, spent(r.source, 1.0)
            for _ in range(30):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if spent(r.source, mid) < share * total else (lo, mid)
            want = sum(target[s] * spent(s, lo) / spent(s, 1.0) for s in sources) / whole
            assert position == pytest.approx(want, abs=2e-3)
            tried += 1
    assert tried > 30


def test_schedules_and_shares():
    s = mixing.ramp(3.0, 4 / 3, 2 / 3)
    assert s.integral() == pytest.approx(3.0)
    assert mixing.water_fill([10, 100], [1.0, 1.0], 60.0, 2.0) == [20.0, 40.0]
    assert mixing.water_fill([1, 1], [1.0, 3.0], 100.0, 2.0) == [2.0, 2.0]


def test_mix_copies_keep_columns(docs, nothing):
    out = mixing.take_copies(docs, mixing.curriculum)
    assert out.columns == docs.columns
    taken = {(r.doc_id, r.source, r["size"]): r for r in mixing.mix(docs, mixing.curriculum).collect()}
    n = Counter((r.doc_id, r.source) for r in out.collect())
    for (i, s, size), r in taken.items():
        if size and Counter((x[0], x[3]) for x in corpus())[(i, s)] == 1:
            assert n[(i, s)] == int(r.taken / size + 0.5)
    assert mixing.take_copies(nothing, mixing.curriculum).collect() == []


# --- 2

ITEMS = [
    (1, "Anna has 12 apples and gives 5 of them to Bruno before walking 3 km to the market to buy some fresh bread"),
    (2, "the quick brown fox jumps over a lazy dog while seven silent owls keep watching from the old tree"),
    (3, "too short"), (4, None),
]


def test_decontamination(docs, nothing, spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    leaks = [
        (100, words(30, 1) + " " + ITEMS[0][1] + " " + words(30, 2)),
        (101, "Clara has 40 apples and gives 9 of them to David before walking 8 miles to the market to buy some fresh bread"),
        (102, words(50, 3) + "\n" + ITEMS[1][1].upper().lower()),
        (103, "Clara has apples and fresh bread"),
        (104, words(20, 4)),
    ]
    more = spark.createDataFrame([(i, t, "en", "s", len(t), *["7"] * 10) for i, t in leaks], SCHEMA)
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(docs.unionByName(more), bench).collect()}
    assert set(got) == {(100, 1), (101, 1), (102, 2)}
    assert got[100, 1].verbatim and not got[101, 1].verbatim and got[101, 1].n_slots >= 5
    small = decontam.Rules(block_chars=60)
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(more, bench, small).collect()} == set(got)
    kept = decontam.keep_clean(more, bench)
    assert kept.columns == more.columns and {r.doc_id for r in kept.collect()} == {103, 104}
    assert decontam.leaks(nothing, bench).collect() == [] and decontam.leaks(docs, bench.where("item_id > 9")).collect() == []


def test_slots_must_be_consistent():
    a, b = np.array([1, 1, 2]), np.array([7, 7, 8])
    names = np.full(3, decontam.NAME)
    assert decontam._consistent(a, b, names) == 1.0
    assert decontam._consistent(a, np.array([7, 9, 8]), names) < 1.0
    assert decontam._consistent(np.array([1, 2]), np.array([7, 7]), names[:2]) < 1.0


# --- 3, 7


def test_toxicity(spark, sf, nothing):
    rows = {r.doc_id: r for r in queries.op3_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for i, r in rows.items():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    right = [rows[i].predicted == t for i, t in labels.items()]
    assert np.mean(right) > 0.93


def test_toxicity_edges(docs, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, label int")
    model = toxicity.train(docs, none, toxicity.held_out_quarter())
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got[25] == got[26] and len(got) == len({x[0] for x in corpus()})
    lexical = spark.createDataFrame([(1, "you are an idiot and a moron"), (2, "a fine day")], "doc_id long, text string")
    assert [r.score > 0.3 for r in toxicity.score(lexical, model).orderBy("doc_id").collect()] == [True, False]
    assert toxicity.score(nothing, model).collect() == [] and toxicity.keep_civil(docs, model).columns == docs.columns


def test_quality(spark, sf):
    rows = {r.doc_id: r for r in queries.op7_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for i, r in rows.items():
        assert r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert np.mean([rows[i].predicted == q for i, q in labels.items()]) > 0.9


def test_quality_edges(docs, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, label int")
    model = pu_quality.train(docs, none, pu_quality.held_out_third())
    assert {r.score for r in pu_quality.score(docs, model).collect()} == {0.5}
    only = spark.createDataFrame([(i, 1) for i in range(12)] + [(3, None), (None, 1)], "doc_id long, label int")
    model = pu_quality.train(docs, only, pu_quality.held_out_third())
    assert 0 < model.prior < 1
    assert pu_quality.score(nothing, model).collect() == [] and pu_quality.keep_good(nothing, model).collect() == []
    assert pu_quality.keep_good(docs, model).columns == docs.columns


def test_nnpu_risk_stays_non_negative():
    rng = np.random.default_rng(1)
    pos, neg = rng.normal(1, 1, (3000, 3)), rng.normal(-1, 1, (3000, 3))
    unl = np.concatenate([rng.normal(1, 1, (2100, 3)), rng.normal(-1, 1, (900, 3))])
    w, b = pu_quality.nnpu_fit(pos, unl, 0.7)
    assert ((pos @ w + b > 0).mean() > 0.9) and ((neg @ w + b < 0).mean() > 0.85)


# --- 4


def test_lm_scores(docs, nothing, spark):
    target = spark.createDataFrame([(i,) for i in (0, 1, 2, 2, 99)], "doc_id long")
    s = lm_score.Setting(vocabulary=50, block_words=200)
    vocabulary, lt, lb = lm_score.train(docs, target, s)
    got = {(r.doc_id): r for r in lm_score.score(docs, vocabulary, lt, lb).collect() if r.doc_id is not None}
    texts = {x[0]: x[1] for x in corpus() if x[0] is not None}
    assert got[25].score is None and got[26].n_tokens == 0

    def ids(text):
        t = tk.texts_of(pa.array([text], pa.string()))
        w, h, shape = lm_score.word_hashes(t)
        return vocabulary.ids(h, shape).tolist()

    def table(rows):
        n = np.zeros((vocabulary.size, vocabulary.size))
        for text in rows:
            seq = ids(text)
            for a, b in zip([vocabulary.size - 1, *seq], seq):
                n[a, b] += 1
        return n

    every, own = table([x[1] for x in corpus() if x[1]]), table([texts[i] for i in (0, 1, 2)])
    want = lm_score.losses(own, 1.0, s.prior), lm_score.losses(every, own.sum() / every.sum(), s.prior)
    for i in (0, 9, 28, 30):
        seq = ids(texts[i])
        loss = [np.mean([m[a, b] for a, b in zip([vocabulary.size - 1, *seq], seq)]) for m in want]
        assert got[i].target_loss == pytest.approx(loss[0], rel=1e-4) and got[i].score == pytest.approx(loss[0] - loss[1], abs=1e-4)
    assert got[0].score < got[9].score
    assert np.exp(-lt).sum(axis=1) == pytest.approx(np.ones(vocabulary.size), abs=0.02)
    assert lm_score.score_corpus(nothing, target, s).collect() == []


# --- 5

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a < b) "</p>"</script></head><body class="has-sidebar"><header>Site</header><nav><ul><li>Menu</ul></nav>
<div class="ad">Buy</div><article><h1>Head &amp; more</h1><p>One<br>two &eacute;&#233;<p><b>Three</b> four<ul><li>x<li>y</ul><div class="share-box">Share</div></article>
<div id="cookie-notice">Cookies</div><aside>Side</aside><form><p>Ask</p></form><section class="comments"><p>Nice!</p></section><footer>&copy; me</footer></body></html>"""


def test_html_text(spark):
    got = html_extract.text_of(html_extract.parse(PAGE), set())
    assert got == "Head & more\n\nOne two éé\n\nThree four\n\nx\n\ny"
    for odd in ("", "<", "<p", "a<b c", "</p>x", "<!-- open", "<p>" * 3000 + "deep", "<table><tr><td>1<td>2<tr><td>3"):
        html_extract.text_of(html_extract.parse(odd), set())
    assert html_extract.text_of(html_extract.parse("<table><tr><td>1<td>2<tr><td>3"), set()) == "1\n\n2\n\n3"


def test_html_templates(spark):
    rows = [(i, f"http://Host{i % 2}.org/x", f"<body><p>Welcome to our site</p><p>own text {i}</p></body>") for i in range(60)]
    rows += [(60, None, None), (61, "http://lone.org/", "<p>Welcome to our site</p>"), (62, "nonsense", "plain")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    assert got[0].text == "own text 0" and got[60].text == "" and got[60].n_chars == 0 and got[61].text == "Welcome to our site" and got[62].text == "plain"
    salted = {r.page_id: r.text for r in html_extract.extract(pages, html_extract.Rules(broadcast_rows=0), salts=3).collect()}
    assert salted == {i: r.text for i, r in got.items()}
    assert html_extract.extract(pages.limit(0)).collect() == []


# --- 6


def brute_repetition(text):
    w = [x.decode() for x in split(text)]
    marked = set()
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            marked |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in repetition.SYMBOLS), len(lines) - len(set(lines)), len(marked)


def test_repetition(docs, nothing):
    got = defaultdict(list)
    for r in repetition.repetition_rules(docs).collect():
        got[r.doc_id].append(r)
    for x in corpus():
        for r in got[x[0]]:
            want = brute_repetition(x[1])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.kept and r.base_failed)
    assert got[0][0].kept and not got[32][0].kept
    assert repetition.repetition_rules(nothing).collect() == []


# --- 8


def brute_dedup(rows, width):
    first = {}
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = []
    for i, t in rows:
        w = split(t)
        gone = set()
        for k in range(len(w) - width + 1):
            if (i, k) > first[tuple(w[k : k + width])]:
                gone |= set(range(k, k + width))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("block,crowded", [(24 << 20, 20_000), (2000, 2), (1, 1)])
def test_substring_dedup(docs, spark, block, crowded):
    rows = [(superkmer.LAST if x[0] is None else x[0], x[1]) for x in corpus()]
    rng = random.Random(4)
    common = words(30, 77)
    rows += [(200 + k, words(rng.randrange(40), k) + " " + common + " " + words(rng.randrange(40), 300 + k)) for k in range(30)]
    rows += [(300, "z " * 100), (301, "z " * 30)]
    table = spark.createDataFrame([(None if i == superkmer.LAST else i, t) for i, t in rows], "doc_id long, text string")
    s = superkmer.Setting(block_bytes=block, crowded=crowded)
    got = sorted((superkmer.LAST if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in superkmer.dedup(table, s).collect())
    assert got == brute_dedup(rows, 20)


def test_substring_dedup_edges(docs, nothing):
    assert superkmer.dedup(nothing).collect() == []
    assert superkmer.dedup(docs).count() == len(corpus())


def test_substring_dedup_of_repeated_rows(spark):
    """5,000 equal rows: each has the ranges once."""
    one = words(300, 60) + " " + words(300, 60)
    rows = [(7, one)] * 5000 + [(8, words(300, 60) + " own tail")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ranges = superkmer.removed_ranges(table).collect()
    assert sorted(r.doc_key for r in ranges) == [7, 8] and max(len(r.ranges) for r in ranges) < 100
    got = {(r.doc_id, r.n_words, r.n_removed) for r in superkmer.dedup(table).collect()}
    assert got == {(7, 600, 300), (8, 302, 300)}


def test_crowded_minimisers(spark):
    table = spark.createDataFrame([(k, words(12, k) + " same three words " + words(12, 900 + k)) for k in range(300)], "doc_id long, text string")
    rows = superkmer._keyed(table).repartition(40)
    few, size = superkmer._count_minimisers(rows, superkmer.Setting(crowded=250))
    many, _ = superkmer._count_minimisers(rows, superkmer.Setting(crowded=2))
    bounded, _ = superkmer._count_minimisers(rows, superkmer.Setting(crowded=2, crowded_keys=10))
    assert len(few) <= 4 and len(many) > len(few) and len(bounded) <= 10 and size == sum(len(r.text.encode()) for r in table.collect())


def test_equal_hashes_are_told_apart_by_bytes():
    raw = b"aabbaa"
    group = superkmer._same(raw, np.array([0, 2, 4]), np.array([2, 4, 6]), np.array([1, 1, 1]))
    assert group[0] == group[2] != group[1]


# --- 9


def test_sharding(docs, nothing):
    out = sharding.shard(docs, 4).collect()
    assert len(out) == len(corpus())
    texts = defaultdict(set)
    for r in out:
        if r.text_crc32 is not None:
            texts[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in texts.values())
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = {r.doc_id: r for r in out}
    assert by_id[25]["size"] == 8 and by_id[25].text_crc32 is None and by_id[26].text_crc32 == 0
    assert by_id[29].text_crc32 == zlib.crc32(("é€ Ünïcode wörds " * 9).encode()) and by_id[29]["size"] == len(("é€ Ünïcode wörds " * 9).encode()) + 8
    placed = sharding.place(docs, 4)
    assert set(docs.columns) <= set(placed.columns) and placed.count() == len(corpus())
    assert sharding.shard(nothing, 4).collect() == [] and sharding.place(nothing, 4).collect() == []


def test_a_group_beyond_a_shard_is_split(spark):
    rows = [(i, "same text every time") for i in range(900)] + [(1000 + i, words(20, i)) for i in range(900)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    load = Counter()
    for r in out:
        load[r.shard] += r["size"]
    assert len(load) == 8 and max(load.values()) < 1.1 * min(load.values())


# --- 10


def brute_jaccard(rows, t=0.8):
    sets = []
    for i, text in rows:
        w = split(text)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                parent[y] = x
    return sorted((i, find(i), links[k]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("block", [512, 3])
def test_jaccard_join(docs, spark, block):
    rows = [(x[0], x[1]) for x in corpus() if x[0] is not None]
    base = words(120, 500).split()
    for k in range(25):
        copy = list(base)
        copy[(5 * k) % 120] = f"new{k}"
        rows.append((400 + k, " ".join(copy)))
    rows += [(450, "one two three"), (451, "one two")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in lsh_forest.classes(table, lsh_forest.Setting(block=block)).collect())
    assert got == brute_jaccard(rows)


def test_jaccard_edges(docs, nothing):
    got = lsh_forest.classes(docs).collect()
    assert len(got) == len(corpus()) and [(r.class_id, r.n_links) for r in got if r.doc_id is None] == [(6, 1)]
    kept = lsh_forest.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert None not in ids and 20 not in ids and 0 in ids and ids.count(5) == 1 and {25, 26, 27} <= set(ids)
    assert lsh_forest.classes(nothing).collect() == [] and lsh_forest.keep_first(nothing).collect() == []


def test_jaccard_shortens_prefixes_to_the_measured_recall():
    s = lsh_forest.Setting()
    assert s.stop({}) == 5 and s.expected(5) >= s.recall > s.expected(6)
    assert s.stop({4: 200, 8: 9_800}) == 4 and s.stop({7: 1_000_000}) == 7
    t = tk.texts_of(pa.array([words(400, k, 5000) for k in range(400)]))
    _, _, g, doc = lsh_forest.shingles(t, 5)
    own, keys = lsh_forest.signatures(g, doc, s)
    thin_g, thin_doc = lsh_forest.thinned(g, doc, own, s.threshold)
    assert [len(x) for x in np.split(thin_g, np.flatnonzero(np.diff(thin_doc)) + 1)] == [317] * 400  # of 396 grams
    reached = lsh_forest.deepest(keys, lsh_forest.signatures(thin_g, thin_doc, s)[1], s.depth)
    for level in (5, 6, 8):
        assert abs((reached >= level).mean() - s.expected(level)) < 0.05


@pytest.mark.parametrize("block", [512, 4])
def test_jaccard_chains_and_shared_ids(spark, block):
    long = words(800, 900, 50_000).split()
    chain = [(k, " ".join(long[10 * k : 10 * k + 120])) for k in range(60)]
    setting = lsh_forest.Setting(block=block)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in lsh_forest.classes(spark.createDataFrame(chain, "doc_id long, text string"), setting).collect())
    assert got == brute_jaccard(chain) and {c for _, c, _ in got} == {0}
    one, two = words(100, 901).split(), words(100, 902).split()
    near = lambda x, k: " ".join([*x[:k], "new", *x[k + 1 :]])
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, near(one, 40)), (3, near(two, 10)), (4, near(two, 99))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_links, r.class_id) for r in lsh_forest.classes(table, setting).collect()]
    assert sorted(x[:2] for x in got) == [(1, 1), (1, 2), (2, 1), (3, 2), (4, 2)]
    assert len({c for _, _, c in got}) == 2 and 1 in {c for _, _, c in got}
    kept = sorted(tuple(r) for r in lsh_forest.keep_first(table, setting).collect())
    assert len(kept) == 2 and kept == sorted(rows[:2])


def test_jaccard_prefix_over_several_tasks(spark):
    """Equal keys of many texts are dealt over all tasks, and stitched."""
    rows = [(k, np.arange(1, 17, dtype=np.uint64).tobytes()) for k in range(500)]
    setting = lsh_forest.Setting()
    edges = lsh_forest.trie_edges(spark.createDataFrame(rows, "node long, keys binary"), setting, 5)
    assert edges.count() <= 499 * setting.trees
    assert {r.root for r in components.components(edges).collect()} == {0}


@pytest.mark.parametrize("task_edges", [0, 500_000])
def test_components(spark, task_edges):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 140), rng.randrange(100, 140)) for _ in range(30)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), task_edges).collect()}
    assert all(got[k] == 0 for k in range(1, 61)) and 0 not in got
    parent = {}
    find = lambda x: x if parent.get(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {x: find(x) for e in edges for x in e if find(x) != x}


def test_repeated_rows_of_one_document_split_over_shards(spark):
    rows = [(7, "the same text again and again")] * 2000 + [(100 + k, words(6, k)) for k in range(2000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard(table, 24).collect()
    assert len(got) == len(rows)
    total = defaultdict(int)
    for r in got:
        total[r.shard] += r.size
    mean = sum(total.values()) / 24
    assert len(total) == 24 and max(total.values()) <= 1.05 * mean and min(total.values()) >= 0.95 * mean
    for s in total:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_columns_of_the_documents_outlive_the_shard_stage(spark):
    table = spark.createDataFrame([(1, "a b", "kept", "own")], "doc_id long, text string, size string, docs_size string")
    row = sharding.place(table, 2).first().asDict()
    assert (row["docs_docs_size"], row["docs_size"], row["size"]) == ("kept", "own", 11)


def test_a_source_without_weight_gives_nothing(spark):
    table = spark.createDataFrame([(k, words(10, k), f"s{k % 3}") for k in range(30)], "doc_id long, text string, source string")
    for weights in ((0.0, 1.0, 2.0), (0.0, 0.0, 0.0)):
        got = mixing.mix(table, lambda k: mixing.constant(weights[k])).collect()
        by = defaultdict(int)
        for r in got:
            by[r.source] += r.taken
        assert len(got) == 30 and by["s0"] == 0
        assert (by["s1"], by["s2"]) == ((200, 200) if any(weights) else (0, 0))
    assert mixing.water_fill([10, 0, 5], [1.0, 0.0, 1.0], 12.0, 2.0) == [6.0, 0.0, 6.0]
