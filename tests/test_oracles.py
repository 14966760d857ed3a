"""Every named query of the engine against its SQL in DuckDB."""

import decimal

import duckdb
import pytest

from maskwell.plans import catalog_queries
from maskwell.plans.views import TABLES

DATA = "/root/testdata/sf0.001"


def canonical(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value.isoformat() if hasattr(value, "isoformat") else value


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog_queries.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog_queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    result = duck.execute(catalog_queries.oracle_sql()[name])
    have = [d[0] for d in result.description]
    assert sorted(have) == columns
    want = sorted((tuple(canonical(r[have.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    got = sorted((tuple(canonical(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want
