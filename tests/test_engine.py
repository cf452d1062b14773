"""Declarations, identity, scoping, advisory lanes, page tables and streams, on small inputs."""

import datetime as dt

from pyspark.sql import functions as F

from labelwright.functions import normalise as N
from labelwright.functions import text as X
from labelwright.operators import advisory as A
from labelwright.operators import declarations as D
from labelwright.operators import name_join
from labelwright.operators import resolution as R
from labelwright.operators import scoping as S
from labelwright.sources import html_tables as H
from labelwright.sources import readers, word_clouds
from labelwright.streaming import once_per_key, upsert_latest, windowed_counts


def tree(text):
    p = D.parse_declaration(text)
    return [(i[2], i[3], i[5], i[6], i[7], i[8], i[9]) for i in p.items], p.unparsed


def test_declarations():
    assert tree("Sugar, Citric Acid (INS 330)") == ([(0, None, "Sugar", None, "none", None, "none"), (0, None, "Citric Acid", None, "none", "INS 330", "INS")], [])
    assert tree("Emulsifiers (322, E471 and INS 472e)")[0] == [
        (0, None, None, "Emulsifiers", "group_heading", "322", "bare"), (0, None, None, "Emulsifiers", "group_heading", "E471", "E"),
        (0, None, None, "Emulsifiers", "group_heading", "INS 472e", "INS"),
    ]
    assert tree("Preservative: Sodium Benzoate (INS 211)")[0] == [(0, None, "Sodium Benzoate", "Preservative", "explicit_prefix", "INS 211", "INS")]
    items, _ = tree("Seasoning [Salt, Spice (Chilli, Pepper)], Water")
    assert [(d, p, n) for d, p, n, *_ in items] == [(0, None, "Seasoning"), (1, 0, "Salt"), (1, 0, "Spice"), (2, 2, "Chilli"), (2, 2, "Pepper"), (0, None, "Water")]
    assert tree("Chocolate (Cocoa, Milk") == ([], ["Chocolate (Cocoa, Milk"])
    assert tree(None) == ([], []) and len(D.parse_additive_list("E322, Agar, x(").items) == 2


def test_declaration_rows(spark):
    labels = spark.createDataFrame([(1, "Sugar, Salt (x, y)"), (2, None), (3, "a)")], "label_id long, text string")
    rows = D.parse(labels).orderBy("label_id", "item_id").collect()
    assert [(r.label_id, r.item_id, r.verbatim) for r in rows] == [(1, 0, "Sugar"), (1, 1, "Salt (x, y)"), (1, 2, "x"), (1, 3, "y"), (3, None, "a)")]


def test_normalisers(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert [value(N.normalise_code(F.lit(x))) for x in ("INS 322", "E 322", "160b(i)")] == ["322", "322", "160b(i)"]
    assert [value(N.lineage(F.lit(x))) for x in ("160b(i)", "500(ii)", "472e", "322")] == [["160b(i)", "160b", "160"], ["500(ii)", "500"], ["472e", "472"], ["322"]]
    assert [value(N.parent_ins(F.lit(x))) for x in ("160a(i)", "150a", "322")] == ["160a", "150", None]
    assert value(N.unwrap_paragraph(F.lit("<p>Beta&nbsp;carotene</p>"))) == "Beta carotene"
    assert value(X.is_balanced(F.lit("a(b)c)"))) is False and value(X.split_top_level(F.lit("a, b (c, d),, e"))) == ["a", "b (c, d)", "e"]
    assert value(X.rfc2822_date(F.lit("Mon, 02 Jan 2026 10:00:00 GMT"))) == dt.date(2026, 1, 2) and value(X.rfc2822_date(F.lit("soon"))) is None


def test_token_set_ratio():
    assert R.token_set_ratio("a b", "b a c") == 100.0 and R.token_set_ratio("", "x") == 0.0
    assert name_join._indel("abcd", "abxd") == 75.0 and R.token_set_ratio("SUGAR", "sugar") < 50


def test_resolution_order(spark):
    sub = spark.createDataFrame([(1, "330", "Citric acid", ["Acidity regulator"]), (2, "471", "Glycerides", ["Emulsifier"]), (3, "1101(ii)", "Papain", []), (4, "472c", "Citem", [])], "row_ord long, ins string, name string, functional_classes array<string>")
    terms = sub.select("row_ord", "ins", F.col("name").alias("term"))
    none = terms.limit(0)
    tiers = R.lookups(terms, none, none, spark.createDataFrame([("sugar",), ("citric acid",)], "term string"), spark.createDataFrame([("lecithin",)], "term string"))
    items = spark.createDataFrame(
        [(1, 0, None, "INS 330", None, None), (1, 1, None, "E471a", None, None), (1, 2, None, None, " CITRIC  acid", None), (1, 3, None, None, "Sugar", None), (1, 4, None, None, "Sugar", "Colour"),
         (1, 5, None, None, "Lecithin", None), (1, 6, None, None, "Vanilla flavouring", None), (1, 7, None, None, "Mix", None), (1, 8, 7, "1101(ii)", None, None), (1, 9, None, None, "citem", None)],
        "label_id long, item_id int, parent_item_id int, declared_code string, name_as_declared string, declared_role string",
    )
    permits = spark.createDataFrame([("330",), ("471",)], "canonical_id string")
    got = {r.item_id: (r.ins, r.classification, r.method, r.confidence) for r in R.resolve_items(items, sub, tiers, permits).collect()}
    assert got[0] == ("330", "additive", "code_exact", 0.98) and got[1] == ("471", "additive", "code_parent", 0.90)
    assert got[2] == ("330", "additive", "codex_name", 0.98) and got[3] == (None, "food_ingredient", "food_lexicon", 0.95)
    assert got[4][1] == "ambiguous" and got[5][1] == "ambiguous" and got[6][1] == "flavouring" and got[7] == (None, "compound", "structural", 0.95)
    assert got[8][1] == "enzyme" and got[9] == ("472c", "ambiguous", "codex_name", 0.5)
    near = R.fuzzy_match(spark.createDataFrame([("Citric acid anhydrous",), ("nothing like it",)], "name string"), sub.select("row_ord", "ins", "name")).collect()
    assert [(r.ins, r.score) for r in near] == [("330", 100.0)]


def test_scoping(spark):
    items = spark.createDataFrame([(1, 0, None), (1, 1, 0), (1, 2, 1), (1, 3, None), (2, 0, 1), (2, 1, 0)], "label_id long, item_id int, parent_item_id int")
    got = {(r.label_id, r.item_id): (r.root_item_id, r.depth, r.component) for r in S.with_components(items).collect()}
    assert got[1, 2] == (0, 2, 0) and got[1, 3] == (3, 0, None) and (2, 0) in got


def test_cached_fetch(spark):
    cache = spark.createDataFrame([(1, dt.date(2026, 1, 8), "a"), (2, dt.date(2026, 1, 7), "b"), (3, dt.date(2026, 1, 1), "c")], "key long, fetched_at date, value string")
    got = A.cached_fetch(spark.range(1, 5).withColumnRenamed("id", "key"), cache, spark.createDataFrame([(2, "new"), (3, None)], "key long, value string"), "2026-01-15")
    assert {r.key: (r.state, r.value) for r in got.collect()} == {1: ("fresh", "a"), 2: ("fetched", "new"), 3: ("stale_cache_served", "c"), 4: ("missing", None)}


def test_inherited_classes(spark):
    sub = spark.createDataFrame([(1, "470", "x", []), (2, "470a", "y", ["B"]), (3, "470b", "z", ["A", "B"]), (4, "500", "w", [])], "row_ord long, ins string, name string, functional_classes array<string>")
    ids = spark.createDataFrame([("470",), ("470c",), ("500(i)",), ("9",)], "canonical_id string")
    got = {r.canonical_id: (r.classes, r.inherited) for r in A.functional_classes(ids, "canonical_id", sub).collect()}
    assert got == {"470": (["A", "B"], True), "470c": (["A", "B"], True), "500(i)": ([], False)}


def test_page_tables(spark):
    row = '<tr><td>&nbsp;</td><td></td><td><a href="f.html?id=1">{}</a></td><td>{}</td><td class="allowanceMaxLevel">{}</td><td class="allowanceComments">{}</td><td></td></tr>'
    note = '<div><img src="x" title="As acid."/><a href="n">Note 1</a></div><div><a href="n">Note 7</a></div>'
    html = '<a href="additives/details.html?id=63">Gum arabic (Acacia gum) (414)</a><a href="additives/details.html?id=63">Acacia Gum* (414)</a><a href="groups/details.html?id=63">GUMS</a><a href="x">n</a>'
    html += '<table id="allowances"><tbody>' + row.format("01.7", "Desserts", "1,500 mg/kg", note) + row.format("x", "no", "GMP", "") + row.format("05.3", "Gum", "GMP", "") + "</tbody></table>"
    html += 'GSFA Table 3 Provisions<table id="categories"><tr><td></td><td></td><td>01.3</td><td>Milk</td></tr></table>'
    pages = spark.createDataFrame([(1, html), (2, "<p>none</p>"), (3, None)], "page_id long, html string")
    rows = H.provisions(pages).collect()
    assert [(r.code, r.max_level_mg_kg, r.max_level_basis, r.conditions, r.note_codes) for r in rows] == [("01.7", 1500.0, "mg/kg", "As acid. [Note 1] | [Note 7]", ["1", "7"]), ("05.3", None, "gmp", None, [])]
    assert [(r.source, r.code) for r in H.detail(pages).orderBy("page_id", "source", "code").collect()] == [("own", "01.7"), ("own", "05.3"), ("table3", "01.3"), ("identity", None), ("identity", None)]
    assert {(r.kind, r.detail_id, r.name, r.ins) for r in H.index_records(pages).collect()} == {("additive", "63", "Gum arabic (Acacia gum)", "414"), ("group", "63", "GUMS", None)}
    assert [(r.detail_id, r.synonyms) for r in H.synonyms(pages).collect()] == [("63", ["Acacia Gum"])]


def test_word_clouds(spark):
    words = spark.createDataFrame([(1, 5.0, 10.0, "b"), (1, 1.0, 11.0, "a"), (1, 1.0, 20.0, "c")], "page int, x double, y double, text string")
    assert [(r.line, r.text) for r in word_clouds.lines(words).orderBy("line").collect()] == [(1, "a b"), (2, "c")]
    near = word_clouds.nearest(words.select("page", "y"), spark.createDataFrame([(1, 8.0), (1, 12.0), (1, 90.0)], "page int, y double"))
    assert sorted((r.y, r.anchor) for r in near.collect()) == [(10.0, 8.0), (11.0, 12.0), (20.0, 12.0)]


def test_missing_json_reads_empty(spark, tmp_path):
    assert readers.read_json(spark, f"file://{tmp_path}/none.json", "a long").collect() == []
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.read_json(spark, f"file://{tmp_path}/x.json", "a long").count() == 2


def test_stream_counts_like_a_table(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    events.repartition(1).write.parquet(f"{tmp_path}/in/t")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in/t")
    q = windowed_counts(stream, "1 hour").writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, windowed_counts(events, "1 hour").collect()))
    q = once_per_key(stream, "user_id", "400 days").writeStream.foreachBatch(upsert_latest(f"{tmp_path}/out", "user_id", "ts")).option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == events.select("user_id").distinct().count()
