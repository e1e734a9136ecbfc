"""Every registered query agrees with its SQL on the smallest tables."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry_points
from auditframe.workload import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not available")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], SQL.get(name), SF) is None


def test_entry_points(spark):
    assert entry_points.entry(spark).count() == 5
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
