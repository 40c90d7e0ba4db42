"""Every registered query against its SQL at the smallest scale."""

import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry
from skyloom.plans import catalog

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF_DIR = "/root/testdata/sf0.001"
spec = importlib.util.spec_from_file_location("check_oracles", f"{HERE}/tools/check_oracles.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    rows = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert check.table_of(df.columns, rows) == check.table_of(names, cur.fetchall())
