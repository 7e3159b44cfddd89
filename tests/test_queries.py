import os

import pytest
from sqlcheck import FOLDER, compare

import __spark_entry__
from repeatloom.plans import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, name):
    registry.QUERIES[name](spark, FOLDER).collect()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
