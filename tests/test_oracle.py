"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
# Queries of the optional parts are tested with those.
NAMES = sorted(n for n, q in queries().items() if q.__module__.startswith("gridloom.plans"))

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert compare(spark, con, SF, queries()[name], oracle_sql().get(name)) == ""


def test_entry(spark):
    assert entry(spark).count() == 5
