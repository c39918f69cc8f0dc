"""What the text operators share: the word rule, text tables, staged tables, packing of extra columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; of a null text none."""
    inner = trimmed(text)
    return F.when(F.length(inner) > 0, F.split(inner, SPACE_CLASS + "+")).otherwise(
        F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """Number of words as a long, without building them; 0 for a null text."""
    inner = trimmed(text)
    gaps = F.regexp_count(inner, F.lit(SPACE_CLASS + "+"))
    return F.when(F.length(inner) > 0, gaps + 1).otherwise(0).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def packed(docs: DataFrame, **computed: Column) -> DataFrame:
    """All columns of ``docs`` as one struct ``row_``, so that none can clash with the computed ones."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"),
                       *[c.alias(name) for name, c in computed.items()])


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row_.*")
