"""Every registered query against its SQL twin in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from batchloom.plans import catalogue

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(map(repr, zip(*[table[n].to_pylist() for n in names], strict=True)))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    found = catalogue.QUERIES[name](spark, sf)
    assert found.inputFiles()  # every query reads tables
    assert rows(found.toArrow()) == rows(duck.sql(catalogue.ORACLES[name]).to_arrow_table())


def test_every_query_has_a_twin():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_named(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
