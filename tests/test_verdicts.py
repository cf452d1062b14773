"""Rows of the permission table and verdicts, on hand-built rows."""

import pytest
from pyspark.sql import functions as F

from labelwright.operators import provisions as P
from labelwright.operators import verdicts as V

PERMIT = "row_ord string, canonical_id string, additive_name string, food_category_raw string, status string, max_level_mg_kg double, max_level_basis string, conditions string, note_codes array<string>, source_url string"


def permit(o, cid, category="12.2.2 Name", status="permitted", level=None, basis="gmp", conditions=None, notes=(), url="u"):
    return (f"{o:03d}", cid, "Test", category, status, level, basis, conditions, list(notes), url)


def table(spark, *rows):
    return P.clean(spark.createDataFrame(list(rows), PERMIT))


def judge(spark, permits, items, tops=("12.2.2",), confirmed=False):
    resolved = spark.createDataFrame(
        [(1, k, c, ins, eu) for k, (c, ins, eu) in enumerate(items)], "label_id long, item_id int, classification string, canonical_ins string, eu_canonical_id string"
    )
    cands = spark.createDataFrame([(1, k + 1, c) for k, c in enumerate(tops)], "label_id long, rank int, fcs_code string")
    sure = spark.createDataFrame([(1,)], "label_id long") if confirmed else None
    return {r.item_id: r for r in V.evaluate(resolved, cands, permits, sure).collect()}


@pytest.mark.parametrize(
    "row,verdict",
    [
        (permit(1, "330"), "permitted_qs"),
        (permit(1, "330", level=100.0), "permitted_with_limit"),
        (permit(1, "330", conditions="only tuna"), "permitted_with_conditions"),
        (permit(1, "330", conditions="&nbsp;  "), "permitted_qs"),
        (permit(1, "330", "12.2.2. Name"), "permitted_qs"),
    ],
)
def test_one_row(spark, row, verdict):
    assert judge(spark, table(spark, row), [("additive", "330", "330")])[0].headline == verdict


def test_absence_prohibition_and_identity(spark):
    permits = table(spark, permit(1, "330", "1 Other"), permit(2, "171", None, "prohibited"), permit(3, "500"))
    got = judge(
        spark, permits,
        [("additive", "330", "330"), ("additive", "999", "999"), ("additive", "171", "171"), ("additive", "171a", "171a"), ("additive", "500(ii)", "500(ii)"),
         ("additive", "143", None), ("unknown", None, None), ("flavouring", None, None), ("additive", None, None)],
    )
    assert [got[k].headline for k in range(9)] == [
        "not_permitted_in_category", "not_authorised_eu", "not_authorised_eu", "not_authorised_eu", "permitted_qs", "not_authorised_eu", "unresolved", "out_of_scope", "unresolved",
    ]
    assert got[2].flags == ["prohibited"] and got[3].flags == ["prohibited", "widened_to_parent_for_lookup"]
    assert got[4].flags == ["category_unconfirmed", "widened_to_parent_for_lookup"] and got[5].flags == ["not_in_eu_list"]
    assert got[7].flags == ["governing_regulation: Reg 1334/2008"]


def test_without_category(spark):
    permits = table(spark, permit(1, "330"), permit(2, "171", None, "prohibited"))
    got = judge(spark, permits, [("additive", "330", "330"), ("additive", "171", "171"), ("additive", "9", "9")], tops=())
    assert [got[k].headline for k in range(3)] == ["category_unknown", "not_authorised_eu", "not_authorised_eu"]


def test_merge_conflict_and_duplicates(spark):
    permits = table(
        spark, permit(1, "330", level=50.0, basis="mg/kg", conditions="b", notes=["n1", "n2"]), permit(2, "330", level=20.0, basis="mg/l", conditions="a", notes=["n2", "n3"]),
        permit(3, "330", level=50.0, basis="other", conditions="b"), permit(4, "331", level=9.0), permit(5, "331", status="prohibited"),
    )
    rows = {r.canonical_id: r for r in P.select_rows(permits, "canonical_id", "fcs_code").collect()}
    r = rows["330"]
    assert (r.n_rows, r.max_level_mg_kg, r.max_level_basis, r.conditions, r.note_codes, r.flags) == (2, 20.0, "mg/l", "1) b\n\n2) a", ["n1", "n2", "n3"], ["multiple_provisions_apply: 2"])
    assert rows["331"].status == "prohibited" and rows["331"].flags == ["conflicting_rows"]
    got = judge(spark, permits, [("additive", "331", "331")])
    assert got[0].headline == "not_authorised_eu" and "prohibited" in got[0].flags


def test_conflict_is_not_blocking_until_confirmed(spark):
    permits = table(spark, permit(1, "330", "7.2 Wares"), permit(2, "331", "1 Other"))
    got = judge(spark, permits, [("additive", "330", "330"), ("additive", "331", "331")], tops=("12.2.2", "7.2"))
    assert got[0].category_conflict and got[0].verdict_certainty == "category_dependent" and not got[1].category_conflict
    rows = V.evaluate(*_one(spark, permits))
    assert rows.count() == 2
    roll = V.roll_up(rows).first()
    assert roll.blocking == [1] and roll.category_conflict == [0] and roll.review_required == [0]
    b = V.count_buckets(rows).first()
    assert (b.n_blocked, b.n_review, b.n_permitted, b.n_other) == (1, 1, 0, 0)
    sure = judge(spark, permits, [("additive", "330", "330")], tops=("12.2.2",), confirmed=True)
    assert sure[0].flags[0] == "category_confirmed_by_user" and sure[0].verdict_certainty == "certain" and sure[0].headline == "not_permitted_in_category"


def _one(spark, permits):
    resolved = spark.createDataFrame([(1, 0, "additive", "330", "330"), (1, 1, "additive", "331", "331")], "label_id long, item_id int, classification string, canonical_ins string, eu_canonical_id string")
    return resolved, spark.createDataFrame([(1, 1, "12.2.2"), (1, 2, "7.2")], "label_id long, rank int, fcs_code string"), permits


def test_order_of_input_does_not_matter(spark):
    permits = table(spark, *(permit(k, "330", level=float(k % 3) or None, conditions=f"c{k % 4}") for k in range(12)))
    a = P.select_rows(permits, "canonical_id", "fcs_code").collect()
    assert a == P.select_rows(permits.orderBy(F.rand(3)).repartition(7), "canonical_id", "fcs_code").collect()
