"""The training-data queries that SQL can express, against DuckDB on whole tables."""

import math

import pytest

from labelwright.llm import queries

duckdb = pytest.importorskip("duckdb")


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(dict(zip(names, r))[c]) for c in columns]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_contract(spark, sf, name):
    """A row for every row of the table, unless the result is of pairs or of parts and orders."""
    rows = queries.QUERIES[name](spark, sf)
    if name == "op11_filter_audit":
        assert rows.count() == 600 * spark.read.parquet(f"{sf}/documents.parquet").select("source").distinct().count()
        return
    table = {"op5_html": "pages"}.get(name, "documents")
    if name != "op2_decontamination":
        assert rows.count() == spark.read.parquet(f"{sf}/{table}.parquet").count()
