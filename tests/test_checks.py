"""Every registered query with check SQL, on the smallest given tables."""

import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
from check import TABLES, canon

FOLDER = "/root/testdata/sf0.001"
QUERIES, CHECKS = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    if name not in CHECKS:
        assert rows
        return
    cursor = duck.execute(CHECKS[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert canon(df.columns, rows) == canon(names, cursor.fetchall())


def test_flagship(spark):
    assert entry_module.entry(spark).count() > 0
