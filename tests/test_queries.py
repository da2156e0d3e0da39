"""Every registered query against its SQL on the small sample."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from conftest import SMALL

QUERIES, ORACLES = entry.library_queries(), entry.library_oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert difference(spark, SMALL, name, QUERIES, ORACLES, con) == ""


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
