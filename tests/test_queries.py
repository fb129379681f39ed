"""Every query with SQL gives the same rows as DuckDB; those without come back with their columns."""

import pytest
from oracle import differs, expected

import __spark_entry__ as entry
from tidemark.plans import queries as own

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_same_rows_as_sql(spark, name):
    assert differs(own.QUERIES[name](spark, SMALL).toPandas(), expected(SMALL, own.ORACLES[name])) == ""


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.ORACLES)))
def test_has_rows(spark, name):
    assert own.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
