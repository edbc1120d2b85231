"""Registered queries against their SQL twins on the smallest data folder."""

import os

import pytest

import __spark_entry__ as entry
from deskweave import catalog
from parity import compare, duck

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def test_every_sql_has_a_query():
    assert set(SQL) == set(QUERIES) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("key", QUERIES)
def test_same_rows(spark, key):
    problem = compare(spark, duck(FOLDER), FOLDER, QUERIES[key], SQL[key])
    assert problem is None, problem


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {r.decision for r in rows} <= {"auto_handle", "escalate"}
