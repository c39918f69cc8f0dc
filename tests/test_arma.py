"""The two-step fit with a moving-average term, against numpy on whole series."""

import datetime

import numpy as np
import pytest

from shelfprice.operators import features

START = datetime.date(2020, 1, 1)


def two_steps(y, order):
    """Long autoregression from autocovariances, then least squares on the last value and shock."""
    y = np.asarray(y, float)
    n, d = len(y), y - np.mean(y)
    c = np.array([(d[k:] * d[:n - k]).sum() / n for k in range(order + 1)])
    f = np.linalg.solve(np.array([[c[abs(i - j)] for j in range(order)] for i in range(order)]), c[1:])
    shock = np.array([np.nan] * order + [d[t] - f @ d[t - order:t][::-1] for t in range(order, n)])
    t = np.arange(order + 1, n)
    x = np.column_stack([np.ones(len(t)), y[t - 1], shock[t - 1]])
    beta, *_ = np.linalg.lstsq(x, y[t], rcond=None)
    rss = ((y[t] - x @ beta) ** 2).sum()
    return beta[1], beta[2], beta[0], len(t) * (np.log(2 * np.pi * rss / len(t)) + 1) + 8


def simulated(n, phi, theta, seed):
    e = np.random.default_rng(seed).normal(0, 1, n)
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = phi * y[t - 1] + e[t] + theta * e[t - 1]
    return y + 10


def cells(spark, series):
    rows = [(key, START + datetime.timedelta(days=t), float(v), 1) for key, y in series.items() for t, v in enumerate(y) if v]
    return spark.createDataFrame(rows, "product_id string, date date, units double, n_rows long")


def sparse(n, seed):
    draw = np.random.default_rng(seed)
    y = np.where(draw.random(n) < 0.05, draw.integers(1, 50, n), 0).astype(float)
    y[0] = y[-1] = 7
    return y


def test_equals_numpy(spark):
    series = {"dense": simulated(300, 0.6, 0.3, 1), "negative": simulated(250, -0.4, 0.5, 2), "sparse": sparse(900, 3), "burst": sparse(60, 4)}
    series["burst"][20:40] = 5
    got = {r["product_id"]: r for r in features.arma11_baseline(cells(spark, series), min_rows=3).collect()}
    assert got.keys() == series.keys()
    for key, y in series.items():
        row = got[key]
        assert [row["phi"], row["theta"], row["const"], row["aic"]] == pytest.approx(two_steps(y, features.LONG_ORDER), rel=1e-6), key
        assert row["days"] == len(y) and row["last_units"] == y[-1]


def test_finds_the_terms(spark):
    row = features.arma11_baseline(cells(spark, {"a": simulated(6000, 0.5, 0.4, 7)})).first()
    assert row["phi"] == pytest.approx(0.5, abs=0.06) and row["theta"] == pytest.approx(0.4, abs=0.06)


def test_short_and_constant_series(spark):
    flat = {"flat": [5.0] * 80, "short": [1.0] * 12}
    got = features.arma11_baseline(cells(spark, flat), min_rows=3).collect()
    assert [(r["product_id"], r["phi"], r["aic"]) for r in got] == [("flat", None, None)]


def test_more_cells_are_more_tasks(spark, monkeypatch):
    """A task holds a bounded number of cells, and their days are not staged or moved again."""
    asked = []
    dealt = features.by_key
    monkeypatch.setattr(features, "CELLS_PER_TASK", 20)
    monkeypatch.setattr(features, "by_key", lambda rows, key, tasks=0: asked.append(tasks) or dealt(rows, key, tasks))
    series = {str(k): simulated(60, 0.3, 0.2, k) for k in range(5)}
    got = {r["product_id"]: r["phi"] for r in features.arma11_baseline(cells(spark, series), min_rows=3).collect()}
    assert asked == [15] and got == {k: pytest.approx(two_steps(y, features.LONG_ORDER)[0], rel=1e-6) for k, y in series.items()}
