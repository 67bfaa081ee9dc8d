"""Every registered query against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import norm
from code_impact.plans import load_all
from code_impact.plans.registry import ORACLES, QUERIES
from code_impact.sources.tables import TABLES

load_all()


@pytest.fixture(scope="module")
def con(folder):
    found = duckdb.connect()
    found.execute("SET TimeZone='UTC'")
    for name in TABLES:
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, folder, name):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    found = sorted((tuple(norm(v) for v in row) for row in df.select(*columns).collect()), key=repr)
    assert name in ORACLES
    cursor = con.execute(ORACLES[name])
    named = [d[0] for d in cursor.description]
    assert sorted(named) == columns
    expected = sorted((tuple(norm(row[named.index(c)]) for c in columns) for row in cursor.fetchall()), key=repr)
    assert found == expected
    assert found


def test_entry_has_rows(spark):
    assert not entry.entry(spark).isEmpty()
