"""Checksums of tables that do not depend on the order of the rows, to compare results too large to collect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of a row's MD5 in each of the two sums; 32 bits, so that two billion rows add up within a long.
_DIGITS = 8


def as_text(value: Column, kind: str) -> Column:
    """A value as text that other engines write alike: doubles in whole millionths."""
    if kind in ("double", "float"):
        return F.floor(value * 1e6 + 0.5).cast("long").cast("string")
    return value.cast("string")


def table_digest(df: DataFrame, *by: str) -> DataFrame:
    """Number of rows, and two sums of hash parts over all columns, per ``by`` or of the whole table.

    Nulls count as the text ``null``. Equal digests mean equal rows with equal numbers of repeats, but for a
    chance of about 2 ** -64. The sums are combined map-side: one row per key moves.
    """
    kinds = dict(df.dtypes)
    row = F.md5(F.concat_ws("|", *[F.coalesce(as_text(F.col(c), kinds[c]), F.lit("null")) for c in df.columns]))

    def part(start: int) -> Column:
        return F.sum(F.conv(F.substring(row, start, _DIGITS), 16, 10).cast("long"))

    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), part(1).alias("hash_high"), part(1 + _DIGITS).alias("hash_low"))
