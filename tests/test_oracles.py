"""Every query with SQL gives DuckDB's rows over the smallest tables."""

import math
import os

import duckdb
import pytest

from grainmill import catalog

TABLES = "/root/testdata/sf0.001"
SLOW = {"preset_grid", "level_calibration"}  # eight and eleven analyses; the driver compares them
SQL = catalog.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(TABLES):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{name}'")
    return con


def plain(v):
    return (round(v, 9) if math.isfinite(v) else str(v)) if isinstance(v, float) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_rows_equal_the_sqls(spark, duck, name):
    df, rel = catalog.queries()[name](spark, TABLES), duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


def test_all_but_one_have_sql():
    assert set(catalog.queries()) - set(SQL) == {"u_repeat"}  # needs back references; brute force in test_whole_texts
