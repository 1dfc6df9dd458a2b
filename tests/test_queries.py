import pytest

from quillstone.plans.catalogue import QUERIES, SQL
from tests.oracle import assert_same, tables


@pytest.fixture(scope="module")
def con(sf_dir):
    return tables(sf_dir)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(name, spark, sf_dir, con):
    assert_same(QUERIES[name](spark, sf_dir), con, SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
