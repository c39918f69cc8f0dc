"""Queries with check SQL against it, and what is registered."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_queries import compare, duck  # noqa: E402
from shelfprice.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, folder, name):
    got = queries.QUERIES[name](spark, folder).toPandas()
    assert compare(got, duck(folder).execute(queries.ORACLE_SQL[name]).fetchdf()) == "ok"


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(entry.oracle_sql())
