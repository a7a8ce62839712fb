"""Every registered query against its SQL, on the smallest tables; and the library without its llm part."""

import os
import shutil
import subprocess
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        return None if v != v else float(f"{float(v):.9g}") + 0.0
    return str(v)


@pytest.mark.parametrize("name", sorted(set(ORACLE) & set(entry.queries())))
def test_query_equals_its_sql(spark, duck, name):
    a, b = entry.queries()[name](spark, SF).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda df: sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", ["capacity_book", "near_duplicate_stories", "story_clusters", "balanced_sample", "rebalance_engine"])
def test_query_without_sql_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.count() >= 0 and df.columns


def test_nothing_else_needs_the_llm_part(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/signalloom", tmp_path / "signalloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'event_metrics' in e.queries() and not any(q.startswith('op') for q in e.queries()) and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
