import datetime as dt

import numpy as np
import pandas as pd
import pytest

from shelfprice.operators import features


@pytest.fixture
def daily(spark):
    rng = np.random.default_rng(5)
    rows = []
    for product, category in (("A", "x"), ("B", "x"), ("C", "y")):
        day = dt.date(2024, 1, 1)
        for _ in range(25):
            day += dt.timedelta(days=int(rng.integers(1, 4)))
            rows.append((product, category, day, float(np.round(rng.uniform(10, 20), 2)), 15.0, 40.0, float(rng.integers(0, 30))))
    return spark.createDataFrame(rows, "product_id string, category string, date date, price double, competitor_price double, inventory double, units_sold double")


def test_lags_and_means_match_pandas(daily):
    want = daily.toPandas().sort_values(["product_id", "date"])
    groups = want.groupby("product_id")["units_sold"]
    want["units_lag1"], want["units_lag7"] = groups.shift(1), groups.shift(7)
    want["units_roll7"] = groups.transform(lambda s: s.shift(1).rolling(7, min_periods=1).mean())
    want["price_ratio_to_base"] = want["price"] / want.groupby("product_id")["price"].transform("mean")
    want["price_over_cat"] = want["price"] - want.groupby("category")["price"].transform("mean")
    want = want.dropna(subset=["units_lag7"])
    got = features.demand_features(daily).toPandas().sort_values(["product_id", "date"])
    assert len(got) == len(want) == 3 * 18
    for c in ("units_lag1", "units_lag7", "units_roll7", "price_ratio_to_base", "price_over_cat"):
        np.testing.assert_allclose(got[c].to_numpy(), want[c].to_numpy(), rtol=1e-9, atol=1e-9)
    assert ((got["year_sin"] ** 2 + got["year_cos"] ** 2) - 1).abs().max() < 1e-9


def series_of(spark, *points):
    start = dt.date(2024, 1, 1)
    rows = [("P", start + dt.timedelta(days=d), 1, float(u)) for d, u in points]
    return spark.createDataFrame(rows, "product_id string, date date, n_rows long, units double")


def filled(points):
    days = dict(points)
    return np.array([float(days.get(d, 0)) for d in range(min(days), max(days) + 1)])


@pytest.mark.parametrize("points", [
    [(0, 5), (3, 2)], [(0, 5), (2, 1), (6, 8)], [(0, 5), (4, 1), (9, 7)], [(0, 3), (1, 4), (8, 2), (12, 9), (13, 1)],
    [(0, 9), (10, 2), (15, 7), (18, 30), (24, 1)],
])
def test_damped_trend_equals_gap_filled_series(spark, points):
    cells, values = series_of(spark, *points), filled(points)
    recent, older = values[-7:].mean(), values[-14:][:7].mean()
    want = 0.0 if len(values) < 7 else float(np.clip((recent - older) / max(older, 1e-6), -0.2, 0.2))
    row = features.damped_trend(cells, min_rows=1).first()
    assert row["days"] == len(values) and row["recent_trend"] == pytest.approx(want)
    assert [r["units"] for r in features.gap_filled(cells, "product_id").orderBy("date").collect()] == values.tolist()


def test_short_series_are_left_out(spark):
    assert features.damped_trend(series_of(spark, (0, 5), (3, 2))).count() == 0
    assert features.ar1_baseline(series_of(spark, (0, 5), (3, 2))).count() == 0


def test_ar1_equals_least_squares_on_gap_filled_series(spark):
    rng = np.random.default_rng(2)
    points = [(int(d), int(rng.integers(1, 20))) for d in sorted(rng.choice(90, 60, replace=False))]
    values = filled(points)
    slope, level = np.polyfit(values[:-1], values[1:], 1)
    rest = values[1:] - level - slope * values[:-1]
    n = len(rest)
    row = features.ar1_baseline(series_of(spark, *points), min_rows=1).first()
    assert row["phi"] == pytest.approx(slope) and row["const"] == pytest.approx(level)
    assert row["aic"] == pytest.approx(n * (np.log(2 * np.pi * (rest ** 2).sum() / n) + 1) + 6)
    assert row["last_units"] == values[-1] and row["days"] == len(values)


def test_unit_trend_counts_sale_days(spark):
    points = [(2 * i, i + 1) for i in range(14)]
    row = features.unit_trend(series_of(spark, *points)).first()
    assert row["unit_trend"] == sum(range(8, 15)) - sum(range(1, 8))
    assert features.unit_trend(series_of(spark, *points[:13])).first()["unit_trend"] == 0.0


def test_price_position(daily):
    got = features.price_position(daily).toPandas()
    assert got.groupby("product_id")["price_ratio_to_base"].mean().sub(1).abs().max() < 1e-9
    assert got.groupby("category")["price_over_cat"].mean().abs().max() < 1e-9
    assert isinstance(got, pd.DataFrame) and len(got) == 75
