import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfprice.functions import cents, clamp, holiday_flag, parse_date, parse_number, safe_ratio, seasonal_factor, weekend_flag


@pytest.mark.parametrize("value, rounded", [(2.345, 2.35), (0.125, 0.13), (-0.126, -0.13), (10.0, 10.0)])
def test_cents_round_half_up(one, value, rounded):
    assert one(cents(F.col("v")), v=value) == pytest.approx(rounded)


@pytest.mark.parametrize("text, value", [
    ("$1,234.50", 1234.5), ("₹ 99", 99.0), (" 7 ", 7.0), ("49.99", 49.99), ("", None), ("bad", None), ("€2 000", 2000.0), ("nan", None), ("Infinity", None), ("12d", None),
    ("-.5", -0.5), ("1e3", 1000.0), ("1e999", None),
])
def test_parse_number(one, text, value):
    assert one(parse_number(F.col("v")), v=text) == value


@pytest.mark.parametrize("text, day", [
    ("2026-01-05", dt.date(2026, 1, 5)), ("2026-1-5T10:00:00", dt.date(2026, 1, 5)), ("15/06/2026", dt.date(2026, 6, 15)),
    ("06/15/2026", dt.date(2026, 6, 15)), ("3.4.26", dt.date(2026, 3, 4)), ("13-11-05", dt.date(2005, 11, 13)),
    ("5/6/2024", dt.date(2024, 5, 6)), ("Mar 4, 2024", dt.date(2024, 3, 4)), ("20240304", dt.date(2024, 3, 4)),
    ("2026/01/05", dt.date(2026, 1, 5)), ("5 January 2024", dt.date(2024, 1, 5)), ("Jan 5 2024", dt.date(2024, 1, 5)),
    ("05-Jan-2024", dt.date(2024, 1, 5)), ("Fri, 05 Jan 2024", dt.date(2024, 1, 5)),
    ("2026-13-01", None), ("soon", None), ("", None),
])
def test_parse_date(one, text, day):
    assert one(parse_date(F.col("v")), v=text) == day


@pytest.mark.parametrize("month, day, flag", [(11, 3, 1), (12, 19, 0), (12, 20, 1), (1, 5, 1), (1, 6, 0), (4, 10, 1), (4, 16, 0), (7, 1, 0)])
def test_holidays(one, month, day, flag):
    assert one(holiday_flag(F.col("m"), F.col("d")), m=month, d=day) == flag


def test_weekend_and_season(one):
    assert one(weekend_flag(F.col("d").cast("date")), d="2024-03-02") == 1
    assert one(weekend_flag(F.col("d").cast("date")), d="2024-03-04") == 0
    assert one(seasonal_factor(F.col("m")), m=11) == 1.5
    assert one(seasonal_factor(F.col("m")), m=14) == 1.24


def test_clamp_and_ratio(one):
    assert one(clamp(F.col("v"), 0.0, 1.0), v=3.0) == 1.0
    assert one(safe_ratio(F.col("a"), F.col("b")), a=1.0, b=0.0) is None
