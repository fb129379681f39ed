"""The text operators that SQL can express give the same rows as DuckDB."""

import pytest
from oracle import differs, expected

from tidemark.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    assert differs(queries.QUERIES[name](spark, SMALL).toPandas(), expected(SMALL, queries.ORACLES[name])) == ""
