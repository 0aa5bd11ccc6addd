"""Every query with SQL agrees with it; every other one runs."""

import pytest
from compare import connect, same

from millrace import catalog


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_agrees_with_sql(spark, sf, duck, name):
    same(catalog.QUERIES[name](spark, sf), duck.sql(catalog.ORACLE[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    assert df.columns
    df.collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
