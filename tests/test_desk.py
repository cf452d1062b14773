"""News, lookups, labels and substitutes on hand-built rows."""

from pyspark.sql import functions as F

from labelwright import plans
from labelwright.functions import text as T
from labelwright.operators import advisory, classes, lookups, resolution

REGISTRY = "row_ord long, ins string, name string, functional_classes array<string>"


def test_fuzzy_names_take_the_first_of_equals(spark):
    known = spark.createDataFrame([(1, "330", "citric acid"), (2, "331", "acid citric"), (3, "500", "sodium salts"), (4, "300", "ascorbic acid")], "row_ord long, ins string, name string")
    names = spark.createDataFrame([("citric  acid",), ("salts of sodium",), ("ascorbic acd",), ("sugar",)], "name string")
    whole = sorted(map(tuple, resolution.fuzzy_match(names, known).collect()))
    assert [r[:2] for r in whole] == [("ascorbic acd", "300"), ("citric  acid", "330"), ("salts of sodium", "500")]
    assert sorted(map(tuple, resolution.fuzzy_match(names.repartition(5), known.repartition(3)).collect())) == whole
    assert resolution.fuzzy_match(names, known.where("false")).collect() == []


def test_codex_lookup_goes_down_the_tiers(spark):
    known = spark.createDataFrame([(1, "330", "Citric acid", ["Acidity regulator"]), (2, "160a", "Carotenes", ["Colour"])], REGISTRY)
    synonyms = spark.createDataFrame([(1, "160a", "Provitamin A")], "row_ord long, ins string, term string")
    asks = spark.createDataFrame([("INS 330",), ("160a(ii)",), (" carotenes ",), ("provitamin a",), ("acid Citric",), ("acid citric",), ("water",), ("water",)], "query string")
    got = {r["query"]: (r.found, r.matched_on, r.ins) for r in lookups.codex(asks, known, synonyms).collect()}
    assert got == {
        "INS 330": (True, "code_exact", "330"), "160a(ii)": (True, "code_parent", "160a"), " carotenes ": (True, "name_exact", "160a"), "provitamin a": (True, "synonym_exact", "160a"),
        "acid Citric": (True, "fuzzy (score 100)", "330"), "acid citric": (True, "fuzzy (score 91)", "330"), "water": (False, None, None),
    }


def test_relevance_is_by_whole_words(spark):
    rows = spark.createDataFrame([("gum", "a LEGUME", False), ("gum", "Gum, again", True), ("titanium dioxide", "the Dioxide of it", True), ("bétanine", "la Bétanine", True), ("a.b", "axb", False), ("gum", None, False)], "name string, text string, want boolean")
    assert rows.where(T.is_relevant(F.col("name"), F.col("text")) != F.col("want")).count() == 0


def test_welded_classes(spark):
    vocabulary = ("Colour", "Colour retention agent", "Sweetener", "Acidity regulator")
    cases = {
        "Colour Sweetener": ["Colour", "Sweetener"], "SweetenerColour": ["Sweetener", "Colour"], "Sweetener, Colour retention agent.": ["Sweetener", "Colour retention agent"],
        "Colour retention": ["Colour retention"], "Mystery Colour": ["Mystery Colour"], "Acidity regulator/Colour": ["Acidity regulator", "Colour"], " ": [],
    }
    rows = spark.createDataFrame([(k,) for k in cases], "raw string")
    assert {r.raw: r.c for r in rows.select("raw", classes.split_classes(F.col("raw"), vocabulary).alias("c")).collect()} == cases


def test_topics_keep_their_order(spark):
    rows = spark.createDataFrame([('{"b": ["x", "y"], "a": "z"}',), ("[1]",), ("no",), (None,)], "d string")
    assert [r[0] for r in rows.select(T.flattened(T.topics(F.col("d")))).collect()] == ["x\ny\nz", None, None, None]


def test_substitutes_under_review_come_last(spark):
    known = spark.createDataFrame([(i, str(c), "n", ["A", "B"] if c != 300 else ["A"]) for i, c in enumerate((100, 200, 300, 400))], REGISTRY)
    row = lambda i, c, level: (str(i), str(c), "1.1 x", "1.1", "permitted", level, "mg/kg", None, [], "u")
    schema = "row_ord string, canonical_id string, food_category_raw string, fcs_code string, status string, max_level_mg_kg double, max_level_basis string, conditions string, note_codes array<string>, source_url string"
    permits = spark.createDataFrame([row(1, 200, 5.0), row(2, 300, None), row(3, 400, None)], schema)
    blocked = spark.createDataFrame([("100", "1.1", None)], "blocked_id string, fcs_code string, blocked_level double")
    order = lambda flagged: [r.candidate_id for r in advisory.substitutes(blocked, permits, known, flagged).orderBy("place").collect()]
    assert order(None) == ["400", "200", "300"]
    assert order(spark.createDataFrame([("400",)], "canonical_id string")) == ["200", "300", "400"]


def test_signals_and_proposals_are_found(spark, sf):
    for name in ("tv9_additive_signals", "tv9_route_signals", "tv10_item_evidence", "tv11_proposals"):
        assert plans.QUERIES[name](spark, sf).count() > 0, name
    assert {r.kind for r in plans.QUERIES["tv10_item_evidence"](spark, sf).select("kind").distinct().collect()} >= {"exact", "widened", "elsewhere", "prohibited", "absent", "no_pin", "unresolved", "out_of_scope"}
