import datetime as dt

import pytest

from shelfprice.operators import cleaning


def raw(spark, *rows):
    return spark.createDataFrame(rows, "product_id string, date string, price string, cost string, units_sold string")


def test_normalize_derives_and_drops(spark):
    df = raw(
        spark, ("A", "2026-01-05", "49.99", None, "3"), ("A", "15/06/2026", "$1,000", "600", "2"),
        ("A", "2026-01-05", "bad", None, "1"), ("", "2026-01-05", "5", None, "1"), ("B", "never", "5", None, "1"),
        ("B", "2026-11-07", "10", "4", ""),
    )
    rows = cleaning.normalize_sales(df).orderBy("date").collect()
    assert len(rows) == 2
    first, second = rows
    assert first["cost"] == pytest.approx(49.99 * 0.5) and first["competitor_price"] == pytest.approx(49.99 * 1.03)
    assert first["category"] == "General" and first["inventory"] == 0 and first["holiday"] == 1 and first["is_weekend"] == 0
    assert second["date"] == dt.date(2026, 6, 15) and second["cost"] == 600 and second["price"] == 1000 and second["seasonal_factor"] == 0.84


def test_weekend_comes_from_the_date(spark):
    row = cleaning.normalize_sales(raw(spark, ("A", "2026-11-07", "10", "4", "1"))).first()
    assert row["is_weekend"] == 1 and row["holiday"] == 1 and row["seasonal_factor"] == 1.5


def test_median_and_mode_fill(spark):
    df = spark.createDataFrame([(1.0, "x"), (3.0, "x"), (None, None), (10.0, "y"), (float("nan"), "y")], "v double, c string")
    rows = cleaning.impute(df, ["v"], ["c"]).collect()
    assert sorted(r["v"] for r in rows) == [1.0, 3.0, 3.0, 3.0, 10.0]
    assert [r["c"] for r in rows].count("x") == 3  # x and y tie, the smaller one wins


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, c string")
    hot = cleaning.one_hot(df, "c")
    assert hot.columns == ["i", "c___missing__", "c_a", "c_b"]
    assert [tuple(r) for r in hot.orderBy("i").collect()] == [(1, 0.0, 1.0, 0.0), (2, 0.0, 0.0, 1.0), (3, 1.0, 0.0, 0.0)]
    assert cleaning.one_hot(df, "c", max_levels=2).columns == ["i"]


def test_usable_rows(spark):
    df = spark.createDataFrame([(str(i), 1, f"n{i}", "same") for i in range(40)] + [("bad", 1, "n", "same")], "y string, k int, wide string, c string")
    row = cleaning.usable_rows(df, "y").first()
    assert (row["n_rows"], row["rows_used"], row["rows_dropped"]) == (41, 40, 1)
    assert row["constant_columns"] == "c,k" and row["wide_columns"] == "wide" and row["enough_rows"]


def test_leakage(spark):
    df = spark.createDataFrame([(float(i), i * 1.05, i * 0.05, float((i * 7) % 5)) for i in range(1, 30)], "net double, sales double, tax double, other double")
    found = {r["column"]: r for r in cleaning.leakage_scan(df, "sales").collect()}
    assert found["tax"]["by_name"] and found["tax"]["by_value"] and found["net"]["by_value"] and not found["net"]["by_name"]
    assert not found["other"]["by_value"]
    safe, leaked = cleaning.split_features(df, "sales")
    assert leaked == ["tax"] and safe == ["net", "other"]
    assert cleaning.flag_leakage(df, "sales").first()["leakage_columns"] == "tax"


def test_duplicates_are_really_dropped(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (1, 3)], "a int, b int")
    assert cleaning.drop_duplicates(df).count() == 2 and cleaning.drop_duplicates(df, ["a"]).count() == 1


def test_texts_are_parsed_once(spark):
    """No filter or later column repeats the patterns, and odd shapes are read as before."""
    odd = [("7", "1/2/2024 10:00", "$1,234.50"), ("7", "13-1-2024", "12"), ("7", "Mon, 3.4.24", "1e3"), ("7", "2024/5/6", "-.5"),
           ("7", "Jan 7, 2024", "123456789012345678"), ("7", "2024-08-09T10:00", "+4."), ("7", "1/2/20245", "5"),
           ("7", "99/1/2024", "5"), ("7", "1/2/2024", "1e999"), (None, "1/2/2024", "5"), ("", "1/2/2024", "5")]
    raw = spark.createDataFrame([(p, d, n, n) for p, d, n in odd], "product_id string, date string, price string, units_sold string")
    clean = cleaning.normalize_sales(raw)
    assert [(str(r["date"]), r["price"]) for r in clean.collect()] == [
        ("2024-01-02", 1234.5), ("2024-01-13", 12.0), ("2024-03-04", 1000.0), ("2024-05-06", -0.5), ("2024-01-07", 123456789012345678.0),
        ("2024-08-09", 4.0), ("2024-01-25", 5.0)]
    plan = clean._jdf.queryExecution().executedPlan().toString().splitlines()
    assert sum("RLIKE" in line for line in plan) == 1
