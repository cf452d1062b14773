"""Every registered query of the screening engine against its SQL in DuckDB, and the library without the training-data part."""

import math
import os
import shutil
import subprocess
import sys

import pytest

from labelwright import plans
from labelwright.plans.registry import TABLES

duckdb = pytest.importorskip("duckdb")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


#: Queries that SQL cannot express, each held against brute force in test_brute_force.py or test_vector_index.py.
BRUTE_FORCE = {"jn4_fuzzy_names", "tk4_mmr_diverse", "tk7_index_search", "tv1_declarations"}


def test_every_query_is_compared():
    assert set(plans.QUERIES) - set(plans.ORACLES) == BRUTE_FORCE


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - BRUTE_FORCE))
def test_query(spark, sf, duck, name):
    df = plans.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    found = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(dict(zip(names, r))[c]) for c in columns]) for r in found.fetchall())


def test_library_stands_without_the_training_data_part(tmp_path):
    home = tmp_path / "repo"
    shutil.copytree(ROOT, home, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 90 and not [q for q in e.queries() if q.startswith('op')]; assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=home, env={**os.environ, "PYTHONPATH": str(home)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
