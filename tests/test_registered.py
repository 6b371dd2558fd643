"""Every registered query over the test tables against its SQL."""

import re

import __spark_entry__ as entry
import pytest
from compare import compare, connect

SMALL = "/root/testdata/sf0.001"
# The document queries have tests of their own, and SQL only where it can express them.
NAMES = sorted(n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n))


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_query_has_sql():
    assert set(NAMES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    assert compare(entry.queries()[name](spark, SMALL), duck, entry.oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
