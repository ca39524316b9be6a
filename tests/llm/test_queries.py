"""The text queries that SQL can express, against DuckDB; the others must run and have rows."""

import pytest

from evidloom.llm import queries as Q
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_equals_sql(spark, sf, name):
    same(spark, sf, Q.QUERIES[name], Q.SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, sf, name):
    df = Q.QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0
