"""Every registered query against its check SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from tabwright.plans import catalogue
from tabwright.plans.fixtures import TABLES
from tests.conftest import SMALL

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def canonical(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in found)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    found = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert found
        return
    wanted = duck.sql(sql)
    types = {c: TYPES[t] for c, t in df.dtypes}
    assert types == dict(zip(wanted.columns, map(str, wanted.types)))
    assert canonical(found, df.columns) == canonical(wanted.fetchall(), wanted.columns)


def test_entry(spark):
    assert entry.entry(spark).columns == ["x", "average", "n"]
    assert entry.entry(spark).count() == 5


def test_check_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
