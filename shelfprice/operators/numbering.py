"""Consecutive row numbers over a whole table, without a window that needs all rows in one task.

The rows are dealt by ranges of the order, sorted within each range and checkpointed, so that
every later job sees the same ranges. The rows of a range are counted; a row's number is the
count of the ranges before its own plus its place within it. Only one count per range goes
through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfprice.session import enable_checkpoints

#: ``monotonically_increasing_id`` keeps the place within a partition in its low 33 bits.
_PLACE_BITS = 33


def in_ranges(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` sorted by ``order`` across its partitions, which stay as they are from now on."""
    enable_checkpoints(df.sparkSession)
    return df.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()


def numbered(df: DataFrame, *order: str | Column, name: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` with the place of each row in the order as a long from 0, and the number of rows.

    The order should have no ties: equal rows are numbered in any order, and all of them lie in
    one range.
    """
    rows = in_ranges(df, *order)
    part = "_part"
    counts = {r[part]: r["n"] for r in rows.groupBy(F.spark_partition_id().alias(part)).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for k in sorted(counts):
        starts.append((k, total))
        total += counts[k]
    before = rows.sparkSession.createDataFrame(starts, f"{part} int, _before long")  # one row per range
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    placed = rows.select("*", F.spark_partition_id().alias(part), place.alias("_place"))
    joined = placed.join(F.broadcast(before), part)
    return joined.withColumn(name, F.col("_before") + F.col("_place")).drop(part, "_before", "_place"), total


def strided(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """At most ``n`` evenly spaced rows of an order, the first one included."""
    place = "_place_in_order"
    rows, total = numbered(df, *order, name=place)
    stride = max(1, total // n)
    return rows.where((F.col(place) % stride == 0) & (F.col(place) < n * stride)).drop(place)
