"""Calendar attributes of a sale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Demand factor per month, January first.
SEASONAL_FACTORS = (1.12, 0.92, 1.0, 1.02, 0.96, 0.84, 0.78, 0.88, 1.08, 1.32, 1.5, 1.24)

# Month abbreviations, January first.
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# Months counted as festival months.
FESTIVAL_MONTHS = (1, 4, 11, 12)

# Fixed value: days in the year cycle.
YEAR_DAYS = 365.25


def _by_month(values: tuple, month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), month.cast("int"))


def seasonal_factor(month: Column) -> Column:
    inside = F.least(F.greatest(F.round(month), F.lit(1)), F.lit(12))
    return _by_month(SEASONAL_FACTORS, inside)


def month_name(month: Column) -> Column:
    return _by_month(MONTH_NAMES, month)


def weekend_flag(date: Column) -> Column:
    return (F.weekday(date) >= 5).cast("int")


def holiday_flag(month: Column, day: Column) -> Column:
    """November, 20 December to 5 January, and 10 to 15 April."""
    return (
        (month == 11)
        | ((month == 12) & (day >= 20))
        | ((month == 1) & (day <= 5))
        | ((month == 4) & day.between(10, 15))
    ).cast("int")


def year_angle(date: Column) -> Column:
    import math

    return F.dayofyear(date) * F.lit(2 * math.pi) / F.lit(YEAR_DAYS)
