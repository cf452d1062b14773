"""Decontamination against plain Python, by the broadcast index and by the join."""

import random
import re
from collections import Counter

import pytest

from labelwright.llm import decontam
from labelwright.llm.common import table

INDEXED = decontam.Rules()
JOINED = decontam.Rules(block_chars=0, filter_bits=12, salt=3)
UNREACHED = decontam.Rules(block_chars=0, broadcast_rows=0, salt=2)
NAMES = "Anna Bruno Carla David Emil Frida Gustav Hanna Ida Jonas".split()


def tokens(text):
    """(kind, value) of each word: n number, u unit after a number, c capitalised, l literal."""
    out = []
    for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        core = re.sub(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+$", "", word)
        if not core:
            continue
        low = core.lower()
        number = core[0] in "0123456789" or low in decontam.NUMBER_WORDS
        kind = "n" if number else "u" if out and out[-1][0] == "n" and low in decontam.UNITS else "c" if core[0].isupper() else "l"
        out.append((kind, low))
    return out


def agreeing(pairs):
    """Share of (kind, item value, document value) that follow one replacement."""
    if not pairs:
        return 1.0
    right = 0
    for kind in {k for k, _, _ in pairs}:
        own = [(a, b) for k, a, b in pairs if k == kind]
        told = {a: max(c := Counter(b for x, b in own if x == a), key=lambda b, a=a, c=c: (c[b], b == a)) for a in dict(own)}
        owner = {}
        for a, b in told.items():
            owner.setdefault(b, b if told.get(b) == b else a)
        right += sum(told[a] == b and (kind != "c" or owner[b] == a) for a, b in own)
    return right / len(pairs)


def brute_pair(doc, item, r):
    size = len(item)
    n = min(size, r.window)
    shape = lambda ts: [v if k == "l" else k.upper() * 2 for k, v in ts]
    matched = {True: set(), False: set()}
    for s in range(size - n + 1):
        for d in range(len(doc) - n + 1):
            a, b = item[s : s + n], doc[d : d + n]
            if [v for _, v in a] == [v for _, v in b]:
                matched[True].add((s, d))
            if size >= r.min_tokens and shape(a) == shape(b) and sum(k == "l" for k, _ in a) >= r.literal * n:
                matched[False].add((s, d))
    for found in (matched[True] | matched[False], matched[False]):
        votes = Counter(d - s for s, d in found)
        at = {}
        for shift in sorted(votes, key=lambda x: (votes[x], x)):
            at |= {s + i: shift for s, d in found if d - s == shift for i in range(n)}
        if not at or len(at) < r.coverage * size:
            continue
        slots = [(item[i][0], item[i][1], doc[i + at[i]][1]) for i in sorted(at) if item[i][0] != "l"]
        if (share := agreeing(slots)) >= r.consistent:
            return size, len(at), len(slots), round(share, 9), all(a == b for _, a, b in slots)
    return None


def brute(docs, items, r):
    read = {i: tokens(t) for i, t in items if t is not None}
    out = {}
    for d, text in docs:
        doc = tokens(text)
        out |= {(d, i): found for i, item in read.items() if item and (found := brute_pair(doc, item, r))}
    return out


def question(rng):
    """A question of words, numbers with units and names; few forms, so that items share windows."""
    form = random.Random(rng.randrange(12))
    out = []
    for _ in range(form.choice([3, 6, 9, 14, 24])):
        kind = form.random()
        if kind < 0.15:
            out += [str(rng.randrange(2, 9)), form.choice(["km", "apples", "kg"])]
        elif kind < 0.3:
            out.append(rng.choice(NAMES[:5]))
        else:
            out.append(form.choice("the of walks buys gives market bread then has before some".split()))
    return " ".join(out)


def cases():
    rng = random.Random(5)
    items = [(i, question(rng)) for i in range(40)] + [(90, None), (91, ""), (92, "?!"), (93, "12 + 15"), (94, "Zoé has 3 km"), (90, items_text := "Anna Bruno Carla David Emil Frida"), (95, items_text)]
    docs = [(100 + d, " ".join(x for _ in range(rng.randrange(1, 4)) for x in (question(rng), "and", "so"))) for d in range(60)]
    docs += [(1, None), (2, ""), (3, " \n "), (4, items_text + " again"), (5, "what is 12 + 15 here"), (6, "zoÉ has 4 km"), (100, docs[0][1]), (None, items_text)]
    return docs, items


@pytest.mark.parametrize("rules", [INDEXED, JOINED, UNREACHED], ids=["indexed", "joined", "unreached"])
def test_leaks_are_the_brute_force(spark, rules):
    docs, items = cases()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string").repartition(3)
    want = brute(docs, items, rules)
    got = decontam.leaks(frame, bench, rules).collect()
    assert {(r.doc_id, r.item_id): (r.n_tokens, r.n_covered, r.n_slots, round(r.consistency, 9), r.verbatim) for r in got} == want
    assert len(got) == len(want) + sum(d == 100 for d, _ in want)
    assert any(not v[4] for v in want.values()) and any(v[4] for v in want.values()) and len(want) > 50
    leaking = {d for d, _ in want}
    kept = decontam.keep_clean(frame.selectExpr("doc_id", "text", "1 key", "2 Text_Key", "3 n"), bench, rules)
    assert kept.columns == ["doc_id", "text", "key", "Text_Key", "n"]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(d or 0 for d, _ in docs if d not in leaking)


def test_the_tables_by_the_join(spark, sf):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    indexed = sorted(tuple(r) for r in decontam.leaks(docs, bench).collect())
    assert indexed and indexed == sorted(tuple(r) for r in decontam.leaks(docs, bench, decontam.Rules(block_chars=100)).collect())
    assert decontam.keep_clean(docs, bench, decontam.Rules(block_chars=100)).count() == docs.count() - len({r[0] for r in indexed})


def test_joined_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "some words that are an item here")], "item_id long, text string")
    assert decontam.leaks(none, bench, JOINED).collect() == [] and decontam.keep_clean(none, bench, JOINED).collect() == []
    assert decontam.leaks(none, bench.where("item_id > 1"), JOINED).collect() == []
