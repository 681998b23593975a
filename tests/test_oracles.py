"""Every query with SQL gives the rows of its SQL."""

import pytest

from zonalvec.plans import registry

from . import oracle


@pytest.fixture(scope="module")
def con(data):
    return oracle.connection(data)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, data, con, name):
    columns, got = oracle.rows(registry.QUERIES[name](spark, data).toPandas())
    expected_columns, expected = oracle.rows(con.execute(registry.ORACLES[name]).df())
    assert columns == expected_columns
    assert got == expected
    assert got


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_has_rows(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 8000
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
