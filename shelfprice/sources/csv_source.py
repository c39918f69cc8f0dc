"""CSV input that tolerates ragged rows, odd headers and mixed encodings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt_record"
NO_HEADER = "the file begins without a header"


class DatasetError(ValueError):
    """A problem with the input that its owner can mend."""


def clean_headers(names: list[str]) -> list[str]:
    """Trim, turn inner white space into ``_`` and name blank headers by position."""
    trimmed = [str(name).strip() for name in names]
    return [re.sub(r"\s+", "_", name) if name else f"col_{i}" for i, name in enumerate(trimmed)]


def _pick_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 unless some line does not decode as UTF-8."""
    lines = spark.read.text(path)
    broken = lines.where(~F.is_valid_utf8("value"))
    return "UTF-8" if broken.isEmpty() else "ISO-8859-1"


def _refuse_open_quotes(spark: SparkSession, path: str) -> None:
    """A quote that is never closed would take the rest of its file into one field."""
    marks = spark.read.text(path).select(
        F.input_file_name().alias("file"), (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("n"))
    odd = marks.groupBy("file").agg(F.sum("n").alias("n")).where("n % 2 = 1")
    if not odd.isEmpty():
        raise DatasetError("a quote is opened but never closed")


def read_lenient_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    encoding: str = "auto",
    drop_blank_rows: bool = True,
    max_rows: int | None = None,
    multi_line: bool = True,
    **options,
) -> DataFrame:
    """Read a CSV with a header row.

    ``multi_line`` allows line breaks inside quotes, for which a file is read as a whole by
    one task: turn it off for large files without them. A quote left open is refused.

    Rows with more fields than the header are skipped, short rows are filled with
    NULL, blank rows are dropped. Pass ``schema`` on large inputs: without it Spark
    reads the data once more to infer types.
    """
    if encoding == "auto":
        encoding = _pick_encoding(spark, path)
    options = {
        "header": "true", "quote": '"', "escape": '"', "encoding": encoding,
        "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true",
        "mode": "PERMISSIVE", "multiLine": str(multi_line).lower(), **options,
    }
    _refuse_open_quotes(spark, path)
    if schema is None:
        schema = spark.read.options(**options, inferSchema="true").csv(path).schema
    if not schema.fields:
        raise DatasetError(NO_HEADER)
    width = len(schema.fields)
    with_corrupt = StructType(schema.fields + [StructField(CORRUPT, StringType())])
    rows = spark.read.options(**options, columnNameOfCorruptRecord=CORRUPT).schema(with_corrupt).csv(path)
    unquoted = F.regexp_replace(CORRUPT, r'"(?:[^"]|"")*"', "")
    rows = rows.where(F.col(CORRUPT).isNull() | (F.size(F.split(unquoted, re.escape(options.get("sep", ",")))) <= width)).drop(CORRUPT)
    if drop_blank_rows:
        rows = rows.dropna(how="all")
    rows = rows.toDF(*clean_headers(rows.columns))
    return require_rows(rows, max_rows)


def require_rows(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Reject an empty table and, when asked, one above a row limit."""
    if not df.columns:
        raise DatasetError(NO_HEADER)
    if df.isEmpty():
        raise DatasetError("nothing follows the header")
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise DatasetError(f"too many rows: at most {max_rows} are read")
    return df
