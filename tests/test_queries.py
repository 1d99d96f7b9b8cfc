"""Every registered query against its SQL statement, at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from habitloom.plans.oracles import ORACLES
from habitloom.plans.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def test_entry(spark):
    assert entry_points.entry(spark).columns[0] == "corpus_id"


def test_entry_file_registers_all():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLES) <= set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    frame = QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    found = sorted((tuple(plain(row[c]) for c in columns) for row in frame.collect()), key=repr)
    result = tables.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted((tuple(plain(row[i]) for i in order) for row in result.fetchall()), key=repr)
    assert found == expected
