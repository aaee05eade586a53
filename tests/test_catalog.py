"""Every query with a check equals it; queries keep their rows under another partitioning."""

import pytest

import __spark_entry__ as entry

from .compare import database, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_entry(spark):
    assert entry.entry(spark).count() == 7


def test_every_check_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    found = difference(spark, con, FOLDER, entry.queries()[name], entry.oracle_sql()[name])
    assert found in (None, "equal but empty")
