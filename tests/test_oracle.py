"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from strandline.plans import registry


def rows_of(columns, rows):
    """Rows as sorted strings over sorted columns; numbers to six digits."""

    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, (bool, str, bytes)):
            return v
        if isinstance(v, (int, float, decimal.Decimal)):
            return round(float(v), 6)
        if isinstance(v, (datetime.date, datetime.datetime)):
            return v.isoformat()[:19]
        if isinstance(v, (list, tuple)):
            return [cell(x) for x in v]
        return str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([cell(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, small, duck, name):
    found = registry.queries()[name](spark, small)
    wanted = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(columns, wanted.fetchall())


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
