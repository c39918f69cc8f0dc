"""Checksums of tables: free of order, sensitive to everything else."""

import datetime

import pytest
from pyspark.sql import functions as F

from shelfprice.operators.digest import table_digest

ROWS = [(1, "a", 1.25, datetime.date(2020, 1, 1)), (2, None, None, None), (2, "b", -0.000001, datetime.date(1999, 12, 31)), (1, "a", 1.25, datetime.date(2020, 1, 1))]
SCHEMA = "k int, s string, x double, d date"


@pytest.fixture
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def whole(df):
    return tuple(table_digest(df).first())


def test_order_and_partitions_do_not_matter(table):
    assert whole(table) == whole(table.repartition(3).orderBy(F.desc("x")))


@pytest.mark.parametrize("changed", [ROWS[:3], [*ROWS, ROWS[0]], [(1, "a", 1.250001, ROWS[0][3]), *ROWS[1:]], [(1, None, 1.25, ROWS[0][3]), *ROWS[1:]]])
def test_changes_show(spark, table, changed):
    assert whole(table) != whole(spark.createDataFrame(changed, SCHEMA))


def test_digests_of_groups_add_up(table):
    parts = table_digest(table, "k").collect()
    assert tuple(sum(p[c] for p in parts) for c in ("n_rows", "hash_high", "hash_low")) == whole(table)


def test_empty(table):
    assert whole(table.limit(0)) == (0, None, None) and table_digest(table.limit(0), "k").collect() == []
