"""Every query beside its SQL over whole tables of the smallest data, if that is there."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import difference, duck

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    sql = entry.oracle_sql().get(name)
    if sql is None:
        entry.queries()[name](spark, DATA).count()
    else:
        assert not difference(spark, con, entry.queries()[name], sql, DATA)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
