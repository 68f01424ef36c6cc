"""Every registered query against its SQL statement, on the smallest scale."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_check(spark, con, name):
    ok, note = compare(spark, con, SF, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
