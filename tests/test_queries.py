"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import pytest

from ontolith.plans import queries as Q

from .compare import SF, assert_same


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql(spark, name):
    assert_same(spark, Q.QUERIES[name], Q.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, name):
    df = Q.QUERIES[name](spark, SF)
    assert df.count() > 0 and df.schema == Q.QUERIES[name](spark, SF).schema


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
