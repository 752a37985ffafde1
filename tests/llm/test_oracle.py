"""Operators that SQL can express, against DuckDB on whole tables."""

import pytest

from tarnfold.llm import queries
from tests.oracle import connect, differences


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    assert differences(spark, connect(sf_dir), queries.QUERIES[name], queries.ORACLE_SQL[name], sf_dir) == ""


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 13))
