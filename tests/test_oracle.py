"""Every registered query against its SQL, on the smallest test tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, con, name):
    problem, n = differences(spark, con, SF_DIR, queries()[name], oracle_sql()[name])
    assert not problem
    assert n


def test_entry(spark):
    assert entry(spark).count() == 110


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
