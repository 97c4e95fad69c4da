"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from factweave.plans import catalogue
from tests.oracle import compare, duck

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(ROOT)


KEYS = sorted(catalogue())


@pytest.mark.parametrize("key", KEYS)
def test_matches_sql(spark, connection, key):
    ok, message = compare(spark, ROOT, key, entry.queries()[key], entry.oracle_sql().get(key), connection)
    assert ok, message


def test_every_query_has_sql():
    assert set(KEYS) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    assert not entry.entry(spark).isEmpty()
