"""Queries by name, and the views that they and their SQL share.

The views stand in for the permission table, labels and registries: they derive those shapes from the tables at hand, in
SQL that reads the same in Spark and DuckDB. Orders are carried as keys that sort like the rows they stand for, so no
view needs a global window. EACH(a, b, ..) stands for a row for each of the values, which the two spell differently.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_ID = """concat(CAST(100 + l_partkey % 150 AS string),
              CASE l_linenumber % 4 WHEN 1 THEN 'a' WHEN 2 THEN '(i)' WHEN 3 THEN 'b(ii)' ELSE '' END)"""
_ORD = """concat(lpad(CAST(l_orderkey AS string), 12, '0'), lpad(CAST(l_linenumber AS string), 3, '0'), lpad(CAST(l_partkey AS string), 12, '0'),
              lpad(CAST(l_suppkey AS string), 12, '0'), lpad(CAST(CAST(round(l_extendedprice * 100) AS bigint) AS string), 14, '0'))"""
_CATEGORY = """concat(CAST(1 + l_suppkey % 18 AS string),
                        CASE WHEN l_suppkey % 3 > 0 THEN concat('.', CAST(1 + l_suppkey % 5 AS string)) ELSE '' END,
                        ' Category ', CAST(l_suppkey % 18 AS string))"""

#: Each view may name base tables and the views above it.
VIEWS: dict[str, str] = {
    "permits": f"""
        SELECT {_ORD} AS row_ord, {_ID} AS canonical_id,
               CASE WHEN l_partkey % 97 = 0 AND l_returnflag = 'R' THEN NULL ELSE {_CATEGORY} END AS food_category_raw,
               CASE WHEN l_partkey % 97 = 0 AND l_returnflag = 'R' THEN 'prohibited' ELSE 'permitted' END AS status,
               CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 10 END AS max_level_mg_kg,
               CASE WHEN l_linenumber % 2 = 0 THEN 'mg/kg' ELSE 'gmp' END AS max_level_basis,
               CASE WHEN l_discount < 0.03 THEN NULL WHEN l_discount < 0.05 THEN '&nbsp;'
                    ELSE concat('clause ', CAST(CAST(round(l_discount * 100) AS int) AS string)) END AS conditions,
               CASE WHEN l_tax < 0.02 THEN '' ELSE concat('n', CAST(CAST(round(l_tax * 100) AS int) AS string), ',m', CAST(l_linenumber AS string)) END AS notes,
               concat('Additive ', CAST(100 + l_partkey % 150 AS string)) AS additive_name,
               CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE 'https://law.example/list' END AS source_url
        FROM lineitem""",
    "permits_conflict": f"""
        SELECT row_ord, canonical_id, food_category_raw, CASE WHEN odd THEN 'prohibited' ELSE 'permitted' END AS status,
               max_level_mg_kg, max_level_basis, conditions, notes, additive_name, source_url
        FROM (SELECT {_ORD} AS row_ord, {_ID} AS canonical_id, {_CATEGORY} AS food_category_raw, (l_partkey % 29 = 0 AND l_returnflag = 'R') AS odd,
                     CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 10 END AS max_level_mg_kg,
                     CASE WHEN l_linenumber % 2 = 0 THEN 'mg/kg' ELSE 'gmp' END AS max_level_basis,
                     CASE WHEN l_discount < 0.05 THEN NULL ELSE concat('clause ', CAST(CAST(round(l_discount * 100) AS int) AS string)) END AS conditions,
                     '' AS notes, 'x' AS additive_name, 'u' AS source_url
              FROM lineitem) t""",
    "items": f"""
        SELECT label_id, item_id, CASE WHEN item_id > 1 AND item_id % 3 <> 1 THEN CAST(floor(item_id / 2) AS int) END AS parent_item_id, canonical_id, price
        FROM (SELECT l_orderkey AS label_id,
                     CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS int) AS item_id,
                     {_ID} AS canonical_id, l_extendedprice AS price
              FROM lineitem) t""",
    "resolved": """
        SELECT label_id, item_id, parent_item_id, canonical_id AS canonical_ins,
               CASE WHEN item_id % 7 = 0 THEN NULL ELSE canonical_id END AS eu_canonical_id,
               CASE WHEN item_id % 11 = 0 THEN 'flavouring' WHEN (label_id + item_id) % 13 = 0 THEN 'unknown'
                    WHEN (label_id + item_id) % 17 = 0 THEN 'food_ingredient' ELSE 'additive' END AS classification
        FROM items""",
    "labels_top3": """
        SELECT o_orderkey AS label_id, CAST(r.k AS int) AS rank,
               concat(CAST(1 + (o_orderkey + r.k * 5) % 18 AS string),
                      CASE WHEN (o_orderkey + r.k) % 3 > 0 THEN concat('.', CAST(1 + (o_orderkey + r.k) % 5 AS string)) ELSE '' END) AS fcs_code
        FROM (SELECT o_orderkey, EACH(1, 2, 3) AS k FROM orders WHERE o_orderkey % 9 <> 0) r""",
    "substances": """
        SELECT p_partkey AS row_ord,
               concat(CAST(100 + p_partkey % 400 AS string), CASE p_partkey % 5 WHEN 1 THEN 'a' WHEN 2 THEN '(i)' WHEN 3 THEN 'b(ii)' ELSE '' END) AS ins,
               p_name AS name, p_type AS class_a, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS class_b
        FROM part""",
    "eu_list": """
        SELECT row_ord, CASE WHEN even THEN concat(family, CASE WHEN salt THEN 'c' ELSE 'a' END) ELSE canonical_id END AS canonical_id,
               CASE WHEN even THEN concat(CASE WHEN salt THEN 'Sodium' ELSE 'Calcium' END, ' salts of acid ', family) ELSE additive_name END AS additive_name
        FROM (SELECT row_ord, canonical_id, additive_name, regexp_extract(canonical_id, '^[0-9]+', 0) AS family, CAST(regexp_extract(canonical_id, '^[0-9]+', 0) AS int) % 2 = 0 AS even,
                     contains(canonical_id, '(') AS salt FROM permits) t""",
    "category_tree": """
        SELECT code, concat('Category ', code) AS name, CASE WHEN length(code) % 3 = 0 THEN NULL ELSE concat('This category covers wares of kind ', code,
               '. Includes chocolate wafers such as kind ', code, '. Includes all other wares. Some e.g. are not.') END AS description
        FROM (SELECT DISTINCT concat_ws('.', CAST(1 + p_size % 16 AS string), CASE WHEN d > 1 THEN CAST(1 + p_partkey % 3 AS string) END, CASE WHEN d > 2 THEN CAST(1 + p_partkey % 4 AS string) END,
                                CASE WHEN d > 3 THEN CAST(1 + p_partkey % 2 AS string) END) AS code
              FROM (SELECT p_size, p_partkey, EACH(1, 2, 3, 4) AS d FROM part) levels) t""",
    "corpus": "SELECT vec_id AS doc_ord, embedding, label FROM embeddings",
    "probes": "SELECT vec_id AS query_id, embedding, label FROM embeddings WHERE vec_id % 20 = 0",
    "signals": """
        SELECT event_id, CAST(user_id AS string) AS substance_id, event_type AS stage, CAST(year(ts) - event_id % 9 AS int) AS signal_year, ts, value
        FROM events""",
}

_NEEDS = {"resolved": ["items"], "eu_list": ["permits"]}


def _closure(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        for m in [*_closure(tuple(_NEEDS.get(n, ()))), n]:
            if m not in out:
                out.append(m)
    return out


def with_views(names: tuple[str, ...], body: str) -> str:
    """body after a WITH list of the views named; body may begin with further common table expressions and a comma-free SELECT."""
    parts = [f"{n} AS ({_each(VIEWS[n], 'unnest([{}])')})" for n in _closure(names)]
    body = body.strip()
    if body.upper().startswith("WITH "):
        rest = body[5:]
        recursive = "RECURSIVE " if " climb " in rest else ""
        return f"WITH {recursive}" + ",\n".join(parts + [rest])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def load(spark: SparkSession, sf_dir: str, name: str, **dealt: str) -> DataFrame:
    """A base table or a view, over the folder. dealt: base tables that are dealt out by a column before the view makes its columns.

    So numbers are shuffled rather than texts made of them, and what a view calls that column is known to be dealt out as well.
    """
    if name in TABLES:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return rows.repartition(dealt[name]) if name in dealt else rows
    text, args = _each(VIEWS[name], "explode(array({}))"), {}
    for t in [*TABLES, *VIEWS]:
        marked = _mark(text, t)
        if marked != text and t != name:
            args[f"_{t}"] = load(spark, sf_dir, t, **dealt)
            text = marked
    return spark.sql(text, **args)


def _each(text: str, spelled: str) -> str:
    return re.sub(r"EACH\(([^)]*)\)", lambda m: spelled.format(m[1]), text)


def _mark(text: str, table: str) -> str:
    return re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{_{table}}}", text)


def query(name: str, views: tuple[str, ...] = (), oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, and its SQL over the views named."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = with_views(views, oracle)
        return f

    return register
