"""Queries that SQL cannot express, and operators on hand-built rows, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelwright import plans
from labelwright.operators import corpus, declarations, report, resolution


def test_tk4_mmr_diverse(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids = [r.vec_id for r in rows]
    v = np.array([r.embedding for r in rows], dtype=np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = []
    for q, unit in zip(ids, v):
        if q % 20:
            continue
        score = np.round(v @ unit, 12)
        pool = sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[:20]
        left, chosen = sorted(pool), []
        while len(chosen) < 10:
            worth = [0.5 * score[i] - 0.5 * max((float(v[i] @ v[j]) for j in chosen), default=0.0) for i in left]
            chosen.append(left.pop(int(np.argmax(np.round(worth, 12)))))
        want += [(q, k + 1, ids[i]) for k, i in enumerate(chosen)]
    assert sorted((r.query_id, r.pick, r.doc_ord) for r in plans.QUERIES["tk4_mmr_diverse"](spark, sf).collect()) == sorted(want)


def test_jn4_fuzzy_names(spark):
    names = spark.createDataFrame([("acid citric",), ("citric acd",), ("sugar",), ("citric acid",)], "name string")
    known = spark.createDataFrame([(1, "330", "citric acid"), (2, "331", "citric acid"), (3, "500", "sodium salts")], "row_ord long, ins string, name string")
    got = {r.name: (r.ins, round(r.score, 3)) for r in resolution.fuzzy_match(names, known).collect()}
    assert got == {"acid citric": ("330", 100.0), "citric acid": ("330", 100.0), "citric acd": ("330", 95.238)}


def brute_items(text):
    """Names and depths of a declaration without codes or classes, by counting brackets."""
    out, depth, name = [], 0, ""
    for c in text + ",":
        if c in "(,)":
            if name.strip():
                out.append((name.strip(), depth))
            name, depth = "", depth + (c == "(") - (c == ")")
        else:
            name += c
    return out


def test_tv1_declarations(spark, sf):
    for text in ("water, sugar", "cake (flour, egg), salt", "a (b (c, d), e (f)), g", "x (y (z))"):
        items = declarations.parse_declaration(text).items
        assert [(i[5], i[2]) for i in items] == brute_items(text)
    flat = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text and not set(r.text) & set("()[]:")]
    got = {}
    for r in plans.QUERIES["tv1_declarations"](spark, sf).where("item_id is not null").select("label_id", "item_id", "verbatim").collect():
        got.setdefault(r.label_id, []).append((r.item_id, r.verbatim))
    assert flat
    for i, text in flat:
        assert [x for _, x in sorted(got.get(i, []))] == [p.strip() for p in text.split(",") if p.strip()]


def test_declarations_of_any_depth():
    n = 3000
    items = declarations.parse_declaration("a (" * n + "b" + ")" * n).items
    assert len(items) == n + 1 and items[-1][2] == n and items[-1][3] == n - 1
    assert declarations.parse_declaration("(" * 2000 + ")" * 2000).items
    assert declarations.headed("Acid [330] ") == ("Acid ", "330") and declarations.headed("(x)") is None and declarations.headed("a) (b)") is None and declarations.headed("a ()") == ("a ", "")
    assert declarations.prefixed("Colour: E100") == ("Colour", "E100") and declarations.prefixed("a (b: c)") is None and declarations.prefixed(": x") is None


def test_report_claims_end_where_their_words_end(spark):
    rows = [("E12345 at 10 mg/kg in 12.2.1", "x"), ("E330 and E 150d(ii), E330x9", "E 150d(ii)"), ("110mg/kgs or 5 mg / kg", "5")]
    df = spark.createDataFrame(rows, "text string, source string")
    got = [r[0] for r in df.select(report.unsupported_claims(F.col("text"), F.col("source"))).collect()]
    assert got == [["10", "12.2.1"], ["330"], []]


def test_jn5_by_name(spark):
    permits = spark.createDataFrame([("1", "470a", "Sodium salts of fatty acids"), ("2", "470b", "Magnesium salts of fatty acids"), ("3", "4700", "Sodium salts"), ("4", "330", "Citric acid")], "row_ord string, canonical_id string, additive_name string")
    rows = [("470(i)", "Sodium salts of acids"), ("470(ii)", "magnesium salts"), ("470(iii)", "Magnesium salts of fatty acids"), ("330", "x"), ("331(i)", "Sodium salts"), ("472a", None)]
    resolved = spark.createDataFrame([(*r, "additive") for r in rows], "ins string, codex_name string, classification string")
    got = {r.ins: (r.eu_canonical_id, r.eu_flag, r.eu_cap) for r in resolution.crosswalk(resolved, permits).collect()}
    assert got["470(i)"] == ("470a", "crosswalk_by_name", 0.75) and got["470(iii)"] == ("470b", "crosswalk_by_name", 0.75)
    assert got["330"] == ("330", None, None) and got["331(i)"] == (None, "not_in_eu_list", None) and got["472a"] == (None, "not_in_eu_list", None)
    assert got["470(ii)"][1] == "crosswalk_by_name"


def test_ancestors_of_four_levels(spark):
    rows = [("1", "Dairy", "This category covers milk. Such as cream."), ("1.2", "Cheese", None), ("1.2.3", "Ripened", "Hard."), ("1.2.3.1", "Grated", "Includes all other cheese. E.g. blue."), ("10", "Eggs", "x")]
    tree = spark.createDataFrame(rows, "code string, name string, description string")
    docs = {m: {r.code: r.document for r in corpus.documents(tree, m).collect()} for m in ("name-only", "full", "strip-framing", "name-plus-examples")}
    assert docs["full"]["1.2.3.1"] == "1.2.3.1 -- Grated -- Includes all other cheese. E.g. blue. -- Ripened -- Hard. -- Cheese -- Dairy -- This category covers milk. Such as cream."
    assert docs["strip-framing"]["1.2.3.1"] == "1.2.3.1 -- Grated -- cheese. E.g. blue. -- Ripened -- Hard. -- Cheese -- Dairy -- milk. Such as cream."
    assert docs["name-plus-examples"]["1"] == "1 -- Dairy -- Such as cream." and docs["name-plus-examples"]["1.2"] == "1.2 -- Cheese" and docs["name-only"]["10"] == "10 -- Eggs"
    assert corpus.documents(tree, "full", inherit=False).where("code = '1.2'").first().document == "1.2 -- Cheese"
    with pytest.raises(ValueError):
        corpus.documents(tree, "enriched")


def test_declarations_as_table_functions(spark):
    labels = [(1, "cake (flour, egg), salt"), (2, None), (3, ""), (4, "x (y"), (5, "Colour: E100, E322")]
    frame = spark.createDataFrame(labels, "label_id long, text string")
    declarations.register(spark)
    for name, flat in (("parse_declarations", False), ("parse_additive_lists", True)):
        got = spark.sql(f"SELECT * FROM {name}(TABLE(SELECT label_id, text FROM {{l}}))", l=frame)
        want = declarations.parse(frame, flat)
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.where("label_id in (2, 3)").count() == 0
    assert [(r.label_id, r.item_id, r.verbatim) for r in declarations.parse(frame).where("item_id is null").collect()] == [(4, None, "x (y")]
