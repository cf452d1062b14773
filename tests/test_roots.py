"""Roots by pointer doubling: chains, stars, missing parents and cycles against a climb in plain Python."""

import random

from labelwright.operators import scoping


def climbed(rows):
    parent = {(label, item): up for label, item, up in rows}
    out = {}
    for label, item in parent:
        at, depth, seen = item, 0, set()
        while (up := parent.get((label, at))) is not None and at not in seen:
            seen.add(at)
            at, depth = up, depth + 1
        out[label, item] = (None, None) if at in seen else (at, depth)
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, "label_id long, item_id int, parent_item_id int")
    return {(r.label_id, r.item_id): (r.root_item_id, r.depth) for r in scoping.with_roots(df).collect()}


def test_random_trees_cycles_and_missing_parents(spark):
    rng = random.Random(3)
    rows = [(label, k, rng.choice([None, rng.randrange(1, k + 3), 900])) for label in range(40) for k in range(1, rng.randrange(2, 30))]
    rows += [(99, 1, 1), (98, 1, 2), (98, 2, 1), (98, 3, 2), (97, 5, None)]
    want = climbed(rows)
    assert found(spark, rows) == want
    assert (None, None) in want.values() and max(d or 0 for _, d in want.values()) > 4


def test_a_chain_of_ten_thousand_and_a_star(spark):
    chain = [(1, k, k - 1 or None) for k in range(1, 10_001)]
    star = [(2, k, None if k == 1 else 1) for k in range(1, 3000)]
    got = found(spark, chain + star)
    assert got[1, 10_000] == (1, 9999) and got[1, 1] == (1, 0)
    assert all(got[2, k] == (1, 1) for k in range(2, 3000))


def test_components_and_nothing(spark):
    rows = [(1, 1, None), (1, 2, 1), (1, 3, 2), (1, 4, None)]
    df = spark.createDataFrame(rows, "label_id long, item_id int, parent_item_id int")
    got = {r.item_id: (r.is_compound, r.component) for r in scoping.with_components(df).collect()}
    assert got == {1: (True, 1), 2: (True, 1), 3: (False, 1), 4: (False, None)}
    assert scoping.with_components(df.where("false")).count() == 0
