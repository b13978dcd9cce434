"""Every registered query against its SQL on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, normal
from registry.oracles import ORACLES as SQL
from registry.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data is not present")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_every_oracle_has_its_query():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(str([normal(v) for v in r]) for r in frame.select(*columns).collect())
    if name not in SQL:
        assert got
        return
    cursor = db.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(str([normal(r[i]) for i in order]) for r in cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
