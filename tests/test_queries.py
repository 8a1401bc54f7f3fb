"""Every registered query against its SQL twin over the whole small tables."""

import os

import pytest

import __spark_entry__ as entry
from checks import compare

SF_DIR = os.environ.get("GRIDMARK_TEST_DATA", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return compare.connect(SF_DIR)


def test_entry(spark):
    assert entry.entry(spark).count() == 12


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, connection, name):
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert entry.queries()[name](spark, SF_DIR).count() > 0
    else:
        assert compare.compare(spark, connection, entry.queries()[name], sql, SF_DIR) == ""
