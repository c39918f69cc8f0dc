"""Tolerant text-to-value parsing without Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators and currency signs ignored inside a number.
NUMBER_NOISE = r"[,₹$€£\s]"

# Date shapes, and formats tried when none of the shapes fits.
SHORT_YEAR = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2})(?!\d)"
DAY_FIRST = r"^(1[3-9]|[2-9]\d)[/.-](\d{1,2})[/.-](\d{4})"
MONTH_FIRST = r"^(0?\d|1[0-2])[/.-](\d{1,2})[/.-](\d{4})"
ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}"
YEAR_FIRST = r"^(\d{4})/(\d{1,2})/(\d{1,2})"
WEEKDAY = r"^[A-Za-z]{3,9},\s*"
WORDED_DATES = (
    "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy", "yyyyMMdd",
)
#: What most dates that are not ISO text look like, and most numbers; the latter are always finite.
FULL_YEAR = r"^\d{1,2}[/.-]\d{1,2}[/.-]\d{4}(?!\d)"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
SHORT_NUMBER = r"^[+-]?\d{1,15}(\.\d{0,15})?$"


def parse_number(text: Column) -> Column:
    """Number from text such as ``$1,234.50``; blank or unreadable text, and one that is not finite, gives NULL."""
    plain = F.regexp_replace(text, NUMBER_NOISE, "")
    value = F.when(text.rlike(NUMBER), text.try_cast("double")).when(plain.rlike(NUMBER), plain.try_cast("double"))
    finite = F.when(F.abs(value) < float("inf"), value)
    # most text is a short number as it stands, or without its noise, and needs one or three patterns only
    return F.when(text.rlike(SHORT_NUMBER), text.try_cast("double")).when(
        plain.rlike(SHORT_NUMBER), plain.try_cast("double")).otherwise(finite)


def parse_date(text: Column) -> Column:
    """Date from ISO text, day/month/year or month/day/year text, or worded text.

    A leading part above 12 can only be a day; two-digit years are of this century.
    ISO text is read as it is. Other numeric shapes are rewritten to ISO text step by step, the usual one
    with a full year by its own two steps, and only text of another shape reaches the worded formats.
    """
    given = F.trim(text)
    full = F.regexp_replace(F.regexp_replace(given, DAY_FIRST, "$3-$2-$1"), MONTH_FIRST, "$3-$1-$2")
    text = F.regexp_replace(given, WEEKDAY, "")
    shape = F.regexp_replace(text, SHORT_YEAR, "$1/$2/20$3")
    shape = F.regexp_replace(shape, YEAR_FIRST, "$1-$2-$3")
    shape = F.regexp_replace(shape, DAY_FIRST, "$3-$2-$1")
    shape = F.regexp_replace(shape, MONTH_FIRST, "$3-$1-$2")
    iso = F.regexp_extract(shape, ISO_DATE, 0)
    worded = F.coalesce(*[F.try_to_timestamp(text, F.lit(fmt)).cast("date") for fmt in WORDED_DATES])
    return F.when(given.rlike(ISO_DATE), F.regexp_extract(given, ISO_DATE, 0).try_cast("date")).when(
        given.rlike(FULL_YEAR), F.regexp_extract(full, ISO_DATE, 0).try_cast("date")).when(iso != "", iso.try_cast("date")).otherwise(worded)
