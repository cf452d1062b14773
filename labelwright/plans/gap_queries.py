"""Queries of corpus documents, page chains, backbone counters and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import advisory as A
from ..operators import corpus as K
from ..operators import resolution as R
from ..operators import retrieval as V
from ..operators import vector_index as X
from ..operators import verdicts as J
from ..sources import html_tables as H
from ..storage import written
from .advisory_queries import _CLASSES
from .registry import load, query
from .resolution_queries import _substances
from .retrieval_queries import _SCORES
from .verdict_queries import VERDICT_VIEWS, _permits, item_verdicts, lineage_sql, verdict_sql

_CLAUSES = """clauses AS (
    SELECT code, string_agg(lower(p_brand), ', ' ORDER BY k) AS clause FROM (
        SELECT code, p_brand, row_number() OVER (PARTITION BY code ORDER BY count(*) DESC, lower(p_brand)) AS k
        FROM (SELECT CAST(1 + p_size % 16 AS string) AS code, p_brand FROM part) GROUP BY 1, 2) WHERE k <= 10 GROUP BY 1)"""
_SPLIT = r"string_split(regexp_replace(description, '([.?!])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1))"


@query(
    "tv4_corpus_documents",
    ("category_tree",),
    rf"""WITH {_CLAUSES},
    told AS (
        SELECT *, array_to_string(list_filter(list_transform({_SPLIT}, lambda x: trim(regexp_replace(x, '^(this category (covers|includes|comprises)|includes all other)\s*', '', 'i'))), lambda x: x <> ''), ' ') AS bare,
               trim(list_filter({_SPLIT}, lambda x: regexp_matches(x, '(?i)e\.g\.|for example|examples include|such as'))[1]) AS example FROM category_tree),
    up AS (
        SELECT c.code, string_agg(concat_ws(' -- ', a.name, a.description), ' -- ' ORDER BY length(a.code) DESC) AS chain, string_agg(concat_ws(' -- ', a.name, a.bare), ' -- ' ORDER BY length(a.code) DESC) AS bare_chain
        FROM told c JOIN told a ON starts_with(c.code, a.code || '.') GROUP BY 1)
    SELECT m.mode, t.code, CASE m.mode WHEN 'name-only' THEN concat_ws(' -- ', t.code, name) WHEN 'name-plus-examples' THEN concat_ws(' -- ', t.code, name, example)
        WHEN 'enriched' THEN concat_ws(' -- ', t.code, name, 'Typically permits: ' || clause || '.') WHEN 'full' THEN concat_ws(' -- ', t.code, name, description, chain) ELSE concat_ws(' -- ', t.code, name, bare, bare_chain) END AS document
    FROM told t LEFT JOIN up USING (code) LEFT JOIN clauses USING (code), (VALUES ('name-only'), ('name-plus-examples'), ('enriched'), ('full'), ('strip-framing')) m(mode)""",
)
def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = load(spark, sf_dir, "category_tree")
    pairs = load(spark, sf_dir, "part").select((1 + F.col("p_size") % 16).cast("string").alias("code"), F.col("p_brand").alias("class"))
    out = None
    for mode in K.MODES:
        part = K.documents(tree, mode, classes=pairs if mode == "enriched" else None).select(F.lit(mode).alias("mode"), "code", "document")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "jn5_eu_crosswalk",
    ("substances", "permits", "eu_list"),
    r"""WITH eu AS (SELECT canonical_id, min(row_ord) AS first, max_by(additive_name, row_ord) AS listed, regexp_extract(canonical_id, '^[0-9]+', 0) AS family FROM eu_list GROUP BY 1),
    s AS (SELECT DISTINCT ins, CASE WHEN regexp_matches(ins, '\([ivxlc]+\)$') THEN regexp_replace(ins, '\([ivxlc]+\)$', '') WHEN regexp_matches(ins, '^\d+[a-z]$') THEN regexp_replace(ins, '[a-z]$', '') END AS wider,
          regexp_extract(ins, '^[0-9]+', 0) AS family, concat(CASE WHEN ins LIKE '%(i)' THEN 'Sodium' ELSE 'Calcium' END, ' salts of acid ', regexp_extract(ins, '^[0-9]+', 0)) AS codex_name FROM substances),
    n AS (SELECT s.ins, arg_min(eu.canonical_id, (CASE WHEN listed = codex_name THEN '0' ELSE '1' END) || first) AS n_id FROM s JOIN eu USING (family) GROUP BY 1)
    SELECT s.ins, coalesce(a.canonical_id, b.canonical_id, n_id) AS eu_canonical_id,
           CASE WHEN a.canonical_id IS NOT NULL THEN NULL WHEN b.canonical_id IS NOT NULL THEN 'eu_widened_to_parent' WHEN n_id IS NOT NULL THEN 'crosswalk_by_name' ELSE 'not_in_eu_list' END AS eu_flag
    FROM s LEFT JOIN eu a ON s.ins = a.canonical_id LEFT JOIN eu b ON s.wider = b.canonical_id LEFT JOIN n ON s.ins = n.ins""",
)
def eu_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.regexp_extract("ins", r"^[0-9]+", 0)
    name = F.concat(F.when(F.endswith("ins", F.lit("(i)")), "Sodium").otherwise("Calcium"), F.lit(" salts of acid "), family)
    rows = load(spark, sf_dir, "substances").select("ins").distinct().select("ins", name.alias("codex_name"), F.lit("additive").alias("classification"))
    return R.crosswalk(rows, load(spark, sf_dir, "eu_list")).select("ins", "eu_canonical_id", "eu_flag")


def _pages(spark: SparkSession, sf_dir: str, html: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.expr(html).alias("html"))


_INDEX = """concat('<a href="additives/details.html?id=', CAST(p_partkey % 50 AS string), '">', p_name, ' (', CAST(100 + p_partkey % 400 AS string), ')</a><a href="groups/details.html?id=',
    CAST(p_size AS string), '">GROUP ', CAST(p_size AS string), '</a><a href="help.html?id=1">Help</a>')"""


@query(
    "src8_index_records",
    (),
    """SELECT 'additive' AS kind, CAST(p_partkey % 50 AS string) AS detail_id, arg_min(p_name, p_partkey) AS name, CAST(100 + min(p_partkey) % 400 AS string) AS ins FROM part GROUP BY 2
    UNION ALL SELECT DISTINCT 'group', CAST(p_size AS string), 'GROUP ' || p_size, NULL FROM part""",
)
def index_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.index_records(_pages(spark, sf_dir, _INDEX))


_SYNONYMS = """concat('<a href="details.html?id=', CAST(p_partkey % 50 AS string), '">Alias ', CAST(p_size AS string), '* (330)</a><a href="details.html?id=', CAST(p_partkey % 50 AS string), '">', p_name, ' (330)</a>')"""


@query("src9_synonyms", (), "SELECT k AS detail_id, string_agg(name, '|' ORDER BY first) AS synonyms FROM (SELECT CAST(p_partkey % 50 AS string) AS k, 'Alias ' || p_size AS name, min(p_partkey) AS first FROM part GROUP BY 1, 2) GROUP BY 1")
def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.synonyms(_pages(spark, sf_dir, _SYNONYMS)).select("detail_id", F.array_join("synonyms", "|").alias("synonyms"))


@query("src11_notes", (), """SELECT p_partkey AS page_id, concat('A', p_size, CASE WHEN p_size % 2 = 0 THEN '|XS7' WHEN p_size % 3 = 0 THEN '|' ELSE '' END) AS codes,
    concat(p_type, CASE WHEN p_size % 2 = 0 THEN '|' WHEN p_size % 3 = 0 THEN concat('|', p_brand) ELSE '' END) AS texts FROM part""")
def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = """concat('<div><img title="', p_type, '"/><a href="n.html">Note A', CAST(p_size AS string), '</a></div>', CASE WHEN p_size % 2 = 0 THEN '<div><a href="n.html">Note XS7</a></div>'
        WHEN p_size % 3 = 0 THEN concat('<div><img title="', p_brand, '"/></div>') ELSE '<div> </div>' END)"""
    pairs = _pages(spark, sf_dir, cell).withColumn("notes", H.notes(F.col("html")))
    return pairs.select("page_id", F.array_join(F.col("notes.code"), "|").alias("codes"), F.array_join(F.col("notes.text"), "|").alias("texts"))


_TABLE3 = """concat(CASE WHEN p_size % 2 = 0 THEN '<h3>GSFA Table 3 Provisions</h3>' ELSE '<h3>Other</h3>' END,
    '<table id="categories"><tr><th>x</th></tr><tr><td></td><td></td><td>', lpad(CAST(1 + p_size % 16 AS string), 2, '0'), '.1</td><td>', p_name, '</td></tr><tr><td></td><td></td><td>none</td><td>x</td></tr></table>')"""


@query("src12_table3", (), "SELECT p_partkey AS page_id, lpad(CAST(1 + p_size % 16 AS string), 2, '0') || '.1' AS code, p_name AS name FROM part WHERE p_size % 2 = 0")
def table3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.table3(_pages(spark, sf_dir, _TABLE3)).select("page_id", "code", "name")


_OWN = """concat('<table id="allowances"><tr><td></td><td></td><td>', lpad(CAST(1 + p_size % 16 AS string), 2, '0'), '.2</td><td>', p_name, '</td><td>', CAST(p_size * 10 AS string), ' mg/kg</td><td></td></tr></table>')"""


@query(
    "src13_detail",
    (),
    """SELECT p_partkey AS page_id, 'own' AS source, lpad(CAST(1 + p_size % 16 AS string), 2, '0') || '.2' AS code, p_name AS name, p_size * 10.0 AS level FROM part WHERE p_size % 3 = 0
    UNION ALL SELECT p_partkey, 'table3', lpad(CAST(1 + p_size % 16 AS string), 2, '0') || '.1', p_name, NULL FROM part WHERE p_size % 2 = 0
    UNION ALL SELECT p_partkey, 'identity', NULL, NULL, NULL FROM part WHERE p_size % 2 > 0 AND p_size % 3 > 0""",
)
def detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir, f"concat(CASE WHEN p_size % 3 = 0 THEN {_OWN} ELSE '' END, {_TABLE3})")
    return H.detail(pages).select("page_id", "source", "code", "name", F.col("max_level_mg_kg").alias("level"))


@query(
    "ag24_backbone_counters",
    (),
    """SELECT count(*) AS total, count(*) FILTER (WHERE p_size % 10 > 0) AS assigned, count(*) FILTER (WHERE p_size % 10 = 0) AS groups, count(*) FILTER (WHERE p_size % 7 = 0) AS members, count(*) FILTER (WHERE p_size % 3 > 0) AS with_synonyms,
        count(*) FILTER (WHERE p_size % 10 > 0 AND p_partkey % 20 > 0 AND p_size % 4 = 1) AS sub_types, count(*) FILTER (WHERE p_size % 10 > 0 AND p_partkey % 20 = 0) AS unmapped_not_group, count(*) FILTER (WHERE p_size % 11 = 0) AS doubled_urls FROM part""",
)
def backbone_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = load(spark, sf_dir, "part").selectExpr(
        "CASE WHEN p_size % 10 = 0 OR p_partkey % 20 = 0 THEN concat('UNMAPPED:', p_name, ' (x)') ELSE concat(CAST(p_partkey AS string), CASE WHEN p_size % 4 = 1 THEN '(i)' ELSE '' END) END AS canonical_id",
        "p_size % 10 = 0 AS is_group", "CASE WHEN p_size % 7 = 0 THEN p_brand END AS via_group", "CASE WHEN p_size % 3 > 0 THEN array(p_type) ELSE array() END AS synonyms",
        "CASE WHEN p_size % 11 = 0 THEN 'https://x/gsfaonline/gsfaonline/d' ELSE 'https://x/gsfaonline/d' END AS source_url",
    )
    return K.backbone_counters(records)


_PAIRS = """WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
    FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) a JOIN embeddings b ON a.vec_id <> b.vec_id)"""


@query("ag20_similarity_extremes", (), _PAIRS + " SELECT a AS query_id, count(*) AS n, round(min(s), 6) AS least, round(max(s), 6) AS most, round(avg(s), 6) AS mean FROM p GROUP BY a")
def similarity_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = X.open_index(load(spark, sf_dir, "corpus"), X.index_dir(spark))
    return X.extremes(index, load(spark, sf_dir, "probes")).select("query_id", "n", *(F.round(c, 6).alias(c) for c in ("least", "most", "mean")))


@query("ag20_closest_pairs", (), """WITH p AS (SELECT a.vec_id AS x, b.vec_id AS y, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
    SELECT x, y, round(s, 6) AS score FROM p ORDER BY s DESC, x, y LIMIT 10""")
def closest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the ten closest pairs of all rows."""
    index = X.open_index(load(spark, sf_dir, "corpus"), X.index_dir(spark))
    return X.closest_pairs(index, 10)[0].select("x", "y", F.round("score", 6).alias("score"))


@query("ag21_shortest_documents", (), "SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 5")
def shortest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the five shortest documents."""
    return load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").orderBy("n_chars", "doc_id").limit(5)


# A name against itself with a letter of each of three words taken out and its words turned round, against its first word, and
# against none. The longest common subsequence row by row: each letter raises the row to a running maximum.
_SPOILT = "array_to_string(list_transform(list_reverse(string_split(p_name, ' ')), lambda w, i: CASE WHEN (p_size + i) % 2 = 0 THEN concat(w[1:i], w[i + 2:]) ELSE w END), ' ')"


@query(
    "scl12_token_set_ratio",
    (),
    f"""WITH named AS (SELECT p_partkey, p_name AS a, CASE p_size % 4 WHEN 0 THEN array_to_string(list_reverse(string_split(p_name, ' ')), ' ') WHEN 1 THEN string_split(p_name, ' ')[1] WHEN 2 THEN ' ' ELSE {_SPOILT} END AS b FROM part),
    sets AS (SELECT *, list_filter(list_distinct(string_split(a, ' ')), lambda w: w <> '') AS x, list_filter(list_distinct(string_split(b, ' ')), lambda w: w <> '') AS y FROM named),
    parted AS (SELECT *, list_sort(list_filter(x, lambda w: list_contains(y, w))) AS both_, list_sort(list_filter(x, lambda w: NOT list_contains(y, w))) AS dx, list_sort(list_filter(y, lambda w: NOT list_contains(x, w))) AS dy FROM sets),
    strings AS (SELECT *, array_to_string(both_, ' ') AS base, array_to_string(list_concat(both_, dx), ' ') AS one, array_to_string(list_concat(both_, dy), ' ') AS two FROM parted),
    matched AS (SELECT *, list_transform(string_split(two, ''), lambda c: list_transform(string_split(one, ''), lambda d: (c = d)::INTEGER)) AS hits FROM strings),
    common AS (SELECT *, list_last(list_reduce(list_prepend(list_transform(string_split(one, ''), lambda d: 0), hits),
        lambda above, hit: list_transform(range(1, len(hit) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: CASE WHEN hit[i] = 1 THEN (CASE WHEN i > 1 THEN above[i - 1] ELSE 0 END) + 1 ELSE above[i] END))::INTEGER))) AS lcs FROM matched)
    SELECT p_partkey, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 WHEN len(both_) > 0 AND (len(dx) = 0 OR len(dy) = 0) THEN 100
        ELSE greatest(200.0 * lcs / (length(one) + length(two)), CASE WHEN len(both_) > 0 THEN greatest(200.0 * length(base) / (length(base) + length(one)), 200.0 * length(base) / (length(base) + length(two))) ELSE 0 END) END, 6)::DOUBLE AS ratio FROM common""",
)
def token_set_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in another order and a subset of words are wholly alike; no words are not; misspelt words are by their letters."""
    words = F.split("p_name", " ")
    spoilt = F.transform(F.reverse(words), lambda w, i: F.when((F.col("p_size") + i + 1) % 2 == 0, F.concat(F.substr(w, F.lit(1), i + 1), F.substr(w, i + 3))).otherwise(w))
    other = F.when(F.col("p_size") % 4 == 0, F.array_join(F.reverse(words), " ")).when(F.col("p_size") % 4 == 1, F.get(words, F.lit(0))).when(F.col("p_size") % 4 == 2, F.lit(" ")).otherwise(F.array_join(spoilt, " "))
    return load(spark, sf_dir, "part").select("p_partkey", F.round(R.token_set_ratios(F.col("p_name"), other), 6).alias("ratio"))


@query("tk7_vector_store", (), f"WITH {_SCORES} SELECT query_id, doc_ord, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10")
def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index searched exactly: cells that can't hold one of the ten best are skipped by their radius."""
    index = X.open_index(load(spark, sf_dir, "corpus"), X.index_dir(spark))
    found = X.search(index, load(spark, sf_dir, "probes"), 10, n_probe=8, exact=True)
    return found.select("query_id", "doc_ord", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("tk7_index_search", ())
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index searched in as many nearest cells as a recall of 0.95 takes, and how many rows those hold."""
    index, probes = X.open_index(load(spark, sf_dir, "corpus"), X.index_dir(spark)), load(spark, sf_dir, "probes")
    found = X.search(index, probes, 10).join(X.share_read(index, probes), "query_id")
    return found.select("query_id", "doc_ord", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), F.col("rows").alias("rows_read"))


_BLOCKING = "headline IN ('not_authorised_eu', 'not_permitted_in_category') AND verdict_certainty = 'certain'"


@query(
    "tv7_substitute_suggestions",
    (*VERDICT_VIEWS, "substances"),
    verdict_sql(f""", blk AS (SELECT v.label_id, v.item_id, v.eu_canonical_id AS blocked_id, t.fcs_code FROM verdicts v LEFT JOIN labels_top3 t ON v.label_id = t.label_id AND t.rank = 1 WHERE {_BLOCKING}),
    asked AS (SELECT DISTINCT blocked_id, fcs_code FROM blk WHERE fcs_code IS NOT NULL AND blocked_id IS NOT NULL),
    cand AS (SELECT code AS candidate_id, fcs_code, level FROM selected WHERE code NOT IN (SELECT canonical_id FROM clean WHERE status = 'prohibited')),
    ids AS (SELECT DISTINCT blocked_id AS x FROM blk UNION SELECT DISTINCT candidate_id FROM cand), {lineage_sql('class_steps', 'ids', 'x')}, {_CLASSES.replace('FROM steps s', 'FROM class_steps s')},
    met AS (SELECT p.blocked_id, p.fcs_code, c.candidate_id, c.level, len(list_intersect(a.classes, b.classes)) AS n_shared
        FROM asked p JOIN cand c ON p.fcs_code = c.fcs_code AND p.blocked_id <> c.candidate_id JOIN classes a ON a.id = p.blocked_id JOIN classes b ON b.id = c.candidate_id),
    placed AS (SELECT *, row_number() OVER (PARTITION BY blocked_id, fcs_code ORDER BY n_shared DESC, coalesce(level, 1e308) DESC, candidate_id) AS place FROM met WHERE n_shared > 0),
    told AS (SELECT blocked_id, fcs_code, string_agg(candidate_id, ',' ORDER BY place) AS candidates FROM placed WHERE place <= 5 GROUP BY 1, 2)
    SELECT label_id, item_id, b.blocked_id, b.fcs_code, coalesce(candidates, '') AS candidates, CASE WHEN b.fcs_code IS NULL THEN 'no food category available' WHEN coalesce(len(k.classes), 0) = 0 THEN 'functional class of the blocked additive is unknown'
        WHEN candidates IS NULL THEN 'no permitted additive of this category shares a functional class' END AS reason
    FROM blk b LEFT JOIN told s ON b.blocked_id = s.blocked_id AND b.fcs_code = s.fcs_code LEFT JOIN classes k ON k.id = b.blocked_id"""),
)
def substitute_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = load(spark, sf_dir, "labels_top3").where("rank = 1").select("label_id", "fcs_code")
    blocking = item_verdicts(spark, sf_dir).where(J.is_blocking(F.col("headline"), F.col("verdict_certainty"))).select("label_id", "item_id", F.col("eu_canonical_id").alias("blocked_id")).join(top, "label_id", "left")
    blocking = written(blocking, "blocking")
    rows = A.suggestions(blocking.withColumn("blocked_level", F.lit(None).cast("double")), _permits(spark, sf_dir), _substances(spark, sf_dir))
    return rows.select("label_id", "item_id", "blocked_id", "fcs_code", F.array_join("candidates", ",").alias("candidates"), "reason")
