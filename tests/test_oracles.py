"""Every query with SQL gives the same rows on the smallest tables; the contract holds."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, con, name):
    assert compare(con, queries()[name](spark, FOLDER), oracle_sql()[name]) is None


def test_entry(spark):
    assert entry(spark).count() > 0


def test_names_match():
    assert set(oracle_sql()) <= set(queries())
