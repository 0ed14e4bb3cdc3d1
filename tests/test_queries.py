"""Every query with SQL gives the rows that its SQL gives; ``test_core_queries`` has those without."""

import pytest
from compare import assert_same, duck

from cohortlake import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    assert_same(QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df(), name)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["sv_id", "sample_id", "n", "dp32"]
