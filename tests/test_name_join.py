"""The similarity join of names against comparing all pairs, and how few pairs it compares."""

import random

import pytest

from labelwright.operators import name_join as N
from labelwright.operators.resolution import fuzzy_match


def registry(n, seed):
    rng = random.Random(seed)
    syllables = ["so", "di", "um", "cal", "ci", "ma", "gne", "ben", "zo", "ate", "phos", "pha", "te", "car", "bo", "na", "a", "é", "x"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    return sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(n)})


def spoilt(names, seed):
    """Names with words turned round, left out or added, and letters changed."""
    rng = random.Random(seed)
    out = []
    for name in names:
        words = name.split()
        rng.shuffle(words)
        if rng.random() < 0.3:
            words = words[1:] or words
        if rng.random() < 0.3:
            words.append(rng.choice(("extra", "a", "so")))
        text = list(" ".join(words))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(text))
            text[at : at + rng.randrange(2)] = rng.choice(("", "q", "e", "ss"))
        out.append("".join(text))
    return [x for x in out if x.split()]


@pytest.mark.parametrize("threshold, ranked", [(0.9, 10_000), (0.9, 3), (0.75, 50), (1.0, 50)])
def test_no_pair_is_missed(spark, threshold, ranked):
    known = sorted({N.canonical(x) for x in registry(250, 1)})
    names = sorted({N.canonical(x) for x in spoilt(registry(250, 1), 2)})
    want = {(a, b, round(s, 9)) for a in names for b in known if (s := N.token_set_ratio(a, b)) >= 100 * threshold}
    left, right = (spark.createDataFrame([(x,) for x in rows], "text string") for rows in (names, known))
    got = {(r.a, r.b, round(r.score, 9)) for r in N.alike(left, right, threshold, ranked).collect()}
    assert got == want and len(want) > 100


def test_few_pairs_are_compared(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    known = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(3)) for _ in range(2000)]
    names = [x.replace(x[3], "", 1) for x in known]
    left, right = (spark.createDataFrame([(N.canonical(x),) for x in rows], "text string") for rows in (names, known))
    pairs = N.candidates(left, right, 0.9).count()
    assert len(known) <= pairs < len(names) * len(known) / 100


def test_bounds_hold_for_every_edit():
    rng = random.Random(7)
    for threshold in (0.75, 0.9):
        bounds = N.Bounds(threshold)
        for _ in range(3000):
            one = N.canonical(" ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 4))))
            two = N.canonical("".join(c for c in one if rng.random() > 0.08).strip() or "a")
            a, b = set(N.letter_pairs(one.split())), set(N.letter_pairs(two.split()))
            if N._indel(one, two) >= 100 * threshold:
                assert len(a - b) <= bounds.spoilt(len(one)) and len(b - a) <= bounds.spoilt(len(two))


def test_fuzzy_names_of_nothing_and_without_words(spark):
    names = spark.createDataFrame([("acid",), (" ",), ("",), (None,), ("acid",)], "name string")
    known = spark.createDataFrame([(2, "b", "acid"), (1, "a", "acid  acid"), (3, "c", None), (4, "d", " ")], "row_ord long, ins string, name string")
    assert [tuple(r) for r in fuzzy_match(names, known).collect()] == [("acid", "a", 100.0)]
    assert fuzzy_match(names.where("false"), known).count() == 0 and fuzzy_match(names, known.where("false")).count() == 0
    with pytest.raises(ValueError):
        fuzzy_match(names, known, 50.0)
