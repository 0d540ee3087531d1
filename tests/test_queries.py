import os

import pytest

import __spark_entry__
from tests.compare import duck_rows, spark_rows
from tomeforge.plans import registry

WHERE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(WHERE), reason="no tables")


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_against_sql(spark, name):
    got = spark_rows(registry.queries()[name](spark, WHERE))
    if name in registry.oracle_sql():
        assert got == duck_rows(registry.oracle_sql()[name], WHERE)
    else:
        assert got[1]


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert set(__spark_entry__.entry(spark).columns) == {"surface", "entity", "n", "commonness"}
