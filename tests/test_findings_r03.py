"""The findings of round 3: the same results, with what is shuffled in proportion to the input."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelwright import plans
from labelwright.operators import evals, report, retrieval, tfidf, vector_index, verdicts
from labelwright.plans.verdict_queries import item_verdicts
from labelwright.sources import html_tables


def exchanges(df):
    """The columns by which the rows of a plan are dealt out, one text an exchange."""
    return re.findall(r"(?:hash|range)partitioning\(([^\n]*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def test_division_over_many_categories(spark):
    """150 categories are several words; a query of substances that are permitted nowhere has no row."""
    permitted = {(f"s{s}", f"c{c}") for s in range(12) for c in range(150) if (c * 7 + s * s) % (3 + s % 4) > 0}
    permits = spark.createDataFrame([(s, c, "permitted") for s, c in permitted] + [("s99", "c1", "prohibited"), ("s1", "", "permitted")], "canonical_id string, fcs_code string, status string")
    asked = {q: {f"s{(q * k) % 14}" for k in range(1 + q % 4)} | ({"s99"} if q % 3 else set()) for q in range(40)}
    asked[40] = {"s99"}
    queries = spark.createDataFrame([(q, s) for q, own in asked.items() for s in own] * 2 + [(None, "s1"), (3, None)], "query_id long, canonical_id string")
    got = retrieval.permitted_in(queries, permits)
    known = {s for s, _ in permitted}
    want = {(q, c) for q, own in asked.items() if own & known for c in {c for _, c in permitted} if all((s, c) in permitted for s in own & known)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert not [x for x in exchanges(got) if "query_id" in x and "fcs_code" in x]


def test_claims_of_many_rows_in_one_pass(spark):
    """three patterns a row, no nested functions over the tokens; a long run of digits or blanks is gone through once."""
    claims = report.unsupported_claims(F.col("x"), F.lit("-"))
    rows = [("1" * 100_000 + " " * 100_000 + "E330(IV) 7.5mg/kg", ["330(IV)", "7.5"]), ("E330(ii)_ E101( ii ) e 150D, 1.2.3.4.5 2.03.123", ["330", "101( ii )", "150D", "1.2.3.4", "2.03"]), (".5 mg/kg, 0.5 MG /KG;é330 E330é", ["0.5", "0.5"])]
    df = spark.createDataFrame([(x,) for x, _ in rows], "x string").select(claims.alias("y"))
    assert "lambda i" not in df._jdf.queryExecution().optimizedPlan().toString() and [r.y for r in df.collect()] == [y for _, y in rows]


def test_verdicts_do_not_spread_items_over_categories(spark, sf):
    """Items are dealt out by label only; what the law says of an id reaches them as one small table."""
    rows = item_verdicts(spark, sf)
    dealt = exchanges(rows)
    assert dealt and not [x for x in dealt if "item_id" in x or "fcs_code" in x or "eu_canonical_id" in x]


@pytest.mark.parametrize("name", ["ag12_label_roll_up", "ag13_summary", "snk2_csv_projection", "tv6_item_verdict", "ext_rollup_verdicts", "snk4_report_sections", "ag14_count_buckets", "tk14_category_sensitivity", "tk15_diverging_candidates"])
def test_items_are_dealt_once(spark, sf, monkeypatch, name):
    """The lines are dealt out once, by label and before texts are made of them; what is dealt by label beside them is the candidates."""
    asked, laws = [], verdicts.laws
    monkeypatch.setattr(verdicts, "laws", lambda ids, *rest: asked.append(ids) or laws(ids, *rest))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = [x.split("#")[0] for x in exchanges(plans.QUERIES[name](spark, sf))]
        assert dealt.count("l_orderkey") == 1 and dealt.count("label_id") == 1
        assert "Window" not in asked[0].select("eu_canonical_id")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_verdict_of_widened_absent_and_null_candidates(spark):
    permits = spark.createDataFrame(
        [("1", "330", "1 A", "1", "permitted", 5.0, "mg/kg", None, [], "u"), ("2", "330a", "2 B", "2", "prohibited", None, "gmp", None, [], "u"), ("3", "44", "1 A", "1", "permitted", None, "gmp", "c", [], None)],
        "row_ord string, canonical_id string, food_category_raw string, fcs_code string, status string, max_level_mg_kg double, max_level_basis string, conditions string, note_codes array<string>, source_url string",
    )
    resolved = spark.createDataFrame([(1, 1, "additive", "330(i)", "330(i)"), (1, 2, "additive", "44", "44"), (1, 3, "additive", "9", "9"), (1, 4, "additive", "330a", "330a"), (1, 5, "additive", "7", None)], "label_id long, item_id int, classification string, canonical_ins string, eu_canonical_id string")
    tops = spark.createDataFrame([(1, 1, "1"), (1, 2, "3"), (1, 3, None)], "label_id long, rank int, fcs_code string")
    got = {r.item_id: (r.headline, r.category_sensitive, r.flags, [(x.rank, x.verdict, x.level) for x in r.by_category or []]) for r in verdicts.evaluate(resolved, tops, permits).collect()}
    assert got == {
        1: ("permitted_with_limit", True, ["category_unconfirmed", "widened_to_parent_for_lookup"], [(1, "permitted_with_limit", 5.0), (2, "not_permitted_in_category", None)]),
        2: ("permitted_with_conditions", True, ["category_unconfirmed", "uncitable_verdict"], [(1, "permitted_with_conditions", None), (2, "not_permitted_in_category", None)]),
        3: ("not_authorised_eu", False, ["category_unconfirmed"], [(1, "not_authorised_eu", None), (2, "not_authorised_eu", None)]),
        4: ("not_authorised_eu", False, ["prohibited"], []),
        5: ("not_authorised_eu", False, ["not_in_eu_list"], []),
    }


def test_lines_of_evidence_are_joined_last(spark, sf):
    """the join that brings the lines is the outermost exchange, so rows that carry them are not shuffled."""
    dealt = exchanges(plans.QUERIES["tv10_item_evidence"](spark, sf))
    assert dealt[0].startswith("of#") and "within#" in dealt[0]


def test_multisets_are_counted_without_a_join(spark):
    """no sort-merge join; a null key has nothing in common with another."""
    side = lambda rows: spark.createDataFrame(rows, "label_id long, code string")
    got = evals.multiset_scores(side([(1, "a"), (1, "a"), (1, None), (2, "b")]), side([(1, "a"), (1, None), (3, "c")]), "label_id", "code")
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in got.collect()} == {(1, 3, 2, 1, 1 / 3, 0.5), (2, 1, 0, 0, 0.0, 1.0), (3, 0, 1, 0, 1.0, 0.0)}


def test_group_pages_are_read_once(spark, sf):
    """F8: a page's provisions carry its members, so nothing is joined by page again."""
    plan = plans.QUERIES["src14_group_rules"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Relation [l_orderkey") == 1


def test_long_cells_and_open_elements(spark):
    """F8: a cell of many tags and letters is read whole; an element without an end is none; names are case-insensitive."""
    long = "<i>a</i> " * 200_000 + "b" * 1_000_000
    page = lambda x: f'<TABLE id="additives"><tr><td></td><TD>{x}</td><td></td></tr><tr><td>1</td><td>open</tr></table><p>The <b>provisions</b> that follow limit the total content.</p><table class="t" id="allowances"><tr><td></td><td></td><td>05.3</td><td>w</td><td>gmp</td><td></td></tr></table>'
    got = html_tables.group_provisions(spark.createDataFrame([(1, page(long)), (2, page("x\t<br/>y")), (3, None)], "page_id long, html string")).collect()
    assert sorted((r.page_id, len(r.member), r.code, r.max_level_basis, r.conditions) for r in got) == [(p, n, "05.3", "gmp", "The provisions that follow limit the total content.") for p, n in ((1, 1_400_000), (2, 3))]


def test_steps_of_a_search_are_bounded(spark, tmp_path, monkeypatch):
    """however many cells a query goes on to, a step makes no more numbers than the bound, or one query's."""
    rng = np.random.default_rng(3)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 8)))], "doc_ord long, embedding array<double>")
    index = vector_index.open_index(corpus, f"file://{tmp_path}/index")
    probes = corpus.where("doc_ord % 3 = 0").withColumnRenamed("doc_ord", "query_id")
    want = sorted(tuple(r) for r in vector_index.search(index, probes, 3, n_probe=2, exact=True).collect())
    made = vector_index._lists

    def bounded(m):
        assert m.size <= 2048, "more numbers than a step may have"
        return made(m)

    monkeypatch.setattr(vector_index, "STEP", 2048, raising=False)
    monkeypatch.setattr(vector_index, "_lists", bounded)
    assert sorted(tuple(r) for r in vector_index.search(index, probes, 3, n_probe=2, exact=True).collect()) == want and len(want) == 900


def test_postings_are_not_shuffled(spark):
    """frequent tokens meet their idf by broadcast; with fewer of these, rarer ones meet it by shuffle, to the same weights."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % (3 + 2 * k)}" for k in range(1, 9)) + f" only{i} some{i // 2}") for i in range(60)], "doc_id long, text string").repartition(3)
    want, all_ = None, [tfidf.build(docs, common) for common in (500_000, 20, 1)]
    for index, lengths in zip(all_, (1_000_000, 1_000_000, 0)):
        rows = sorted((r.doc_id, r.token, round(r.weight, 9)) for r in tfidf.weights(index, lengths).collect())
        want = want or rows
        assert rows == want and len({r[1] for r in rows}) > 90
    assert [x.rest_single for x in all_] == [True, False, False] and all_[1].frequent.count() <= 22
    assert exchanges(tfidf.weights(all_[0])) == []
