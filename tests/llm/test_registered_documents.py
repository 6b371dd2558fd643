"""Document queries that SQL can express, against it."""

import __spark_entry__ as entry
import pytest
from compare import compare, connect
from ludoscope.llm import queries

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert compare(queries.queries()[name](spark, SMALL), connect(SMALL), queries.oracle_sql()[name]) is None


def test_all_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
