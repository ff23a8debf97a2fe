"""Every registered query against its SQL at the smallest scale."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, message, rows = compare(spark, con, FOLDER, QUERIES[name], ORACLES.get(name))
    assert ok, message
    assert rows


def test_entry(spark):
    assert entry.entry(spark).count() == 4


def test_every_query_has_sql():
    """Queries that SQL cannot express are held against brute force in the tests of the training-data operators."""
    assert not [n for n in QUERIES if n not in ORACLES and not n.startswith("op") and n != "pipeline"]
