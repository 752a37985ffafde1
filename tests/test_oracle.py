"""Every query of the catalog against its SQL in DuckDB."""

import pytest

from tarnfold import catalog
from tests.oracle import connect, differences


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, con, sf_dir, name):
    assert differences(spark, con, catalog.QUERIES[name], catalog.ORACLE_SQL[name], sf_dir) == ""


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    rows = __spark_entry__.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"run_id", "state", "v"}
