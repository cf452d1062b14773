"""What the first review found left out of the engine's queries: whole tables, against SQL without the filters or brute force."""

import hashlib
import re

import pytest
from test_queries import plain

from labelwright import plans
from labelwright.plans.registry import TABLES

duckdb = pytest.importorskip("duckdb")


def agrees(spark, sf, name, text):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = plans.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = con.execute(text)
    names = [d[0] for d in found.description]
    want = sorted(repr([plain(dict(zip(names, r))[c]) for c in columns]) for r in found.fetchall())
    assert want and sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want


def split_parts(text):
    parts, open_, depth = [], None, 0
    for p in text.split(","):
        open_ = p if open_ is None else open_ + "," + p
        depth += sum(c in "([" for c in p) - sum(c in ")]" for c in p)
        if depth == 0:
            parts.append(open_)
            open_ = None
    parts += [open_] if open_ is not None else []
    return [x for x in (re.sub(r"^\s+|\s+$", "", p) for p in parts) if x]


def test_scl8_splits_long_texts(spark, sf, tmp_path):
    agrees(spark, sf, "scl8_split_top_level", plans.ORACLES["scl8_split_top_level"])
    rows = [(1, "a, b (c, d), e", 14), (2, "x (y, z), " * 600, 6000), (3, "a, b", None), (4, "open (, " + "long, " * 900, 5408), (5, "", 0), (6, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n, r.digest) for r in plans.QUERIES["scl8_split_top_level"](spark, str(tmp_path)).collect()}
    parts = {i: split_parts(t) for i, t, _ in rows if t}
    assert got == {i: (len(p), hashlib.md5("|".join(p).encode()).hexdigest()) for i, p in parts.items()}
