"""Every registered query against its SQL twin on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def cell(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "NULL"
    return f"{value:.5f}" if isinstance(value, float) else str(value)


def lines(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_matches_sql(spark, duck, name):
    result = contract.queries()[name](spark, SF)
    rows = [tuple(r) for r in result.collect()]
    twin = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in twin.description]
    expected = twin.fetchall()
    assert sorted(result.columns) == sorted(columns)
    assert lines(result.columns, rows) == lines(columns, expected)


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_gives_rows(spark, name):
    assert contract.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() == 15
