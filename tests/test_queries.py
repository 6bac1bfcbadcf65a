"""Every registered query against its DuckDB twin on the smallest tables, and that imports need no session."""

import math
import os
import subprocess
import sys
from pathlib import Path

import pytest

from textmill import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="the given tables are not here")


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got
    if name in catalog.ORACLE:
        r = duck.sql(catalog.ORACLE[name])
        assert sorted(r.columns) == cols
        want = [dict(zip(r.columns, x, strict=True)) for x in r.fetchall()]
        assert got == sorted((tuple(plain(x[c]) for c in cols) for x in want), key=repr)


def test_entry_module_imports_without_a_session():
    root = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=root, check=True)
