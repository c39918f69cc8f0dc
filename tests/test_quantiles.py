import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfprice.operators import quantiles


def found(df, columns, probs):
    return {(r["column"], r["prob"]): r["value"] for r in quantiles.column_quantiles(df, columns, probs).collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_small_columns_match_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = found(df, ["v"], [0.25, 0.5])
    for p in (0.25, 0.5):
        assert got[("v", p)] == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-6)


@pytest.mark.parametrize("whole_range", [10, 10**6])
def test_bracketed_search_matches_numpy(spark, monkeypatch, whole_range):
    monkeypatch.setattr(quantiles, "WHOLE_RANGE", whole_range)
    rng = np.random.default_rng(7)
    skewed = np.round(rng.lognormal(3, 2, 30_000), 4)
    hot = np.where(rng.random(30_000) < 0.4, 5.0, rng.normal(0, 1, 30_000))  # one value holds 40 %
    df = spark.createDataFrame(list(zip(skewed.tolist(), hot.tolist())), "a double, b double").repartition(6)
    got = found(df, ["a", "b"], [0.1, 0.25, 0.5, 0.75])
    for name, values in (("a", skewed), ("b", hot)):
        for p in (0.1, 0.25, 0.5, 0.75):
            assert got[(name, p)] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


def test_nulls_nan_and_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (float("nan"), 5.0), (3.0, None)], "a double, b double")
    got = found(df, ["a", "b"], [0.5])
    assert got == {("a", 0.5): 2.0, ("b", 0.5): 5.0}


def test_group_medians(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), float(np.round(v, 2)), float(w)) for k, v, w in zip(rng.integers(0, 5, 999), rng.normal(10, 3, 999), rng.integers(0, 4, 999))]
    df = spark.createDataFrame(rows, "k int, v double, w double")
    got = {r["k"]: (r["v"], r["w"]) for r in quantiles.group_medians(df, ["k"], ["v", "w"]).collect()}
    for k in range(5):
        mine = [r for r in rows if r[0] == k]
        assert got[k] == pytest.approx((np.median([r[1] for r in mine]), np.median([r[2] for r in mine])))


def test_only_a_bracket_is_ranked(spark, monkeypatch):
    """The value counts kept for ranking are a small part of a large column."""
    monkeypatch.setattr(quantiles, "WHOLE_RANGE", 10)
    df = spark.range(50_000).select(F.col("id").cast("double").alias("v"))
    brackets = quantiles._brackets(df, ["v"], [0.5]).first()
    assert brackets["high"] - brackets["low"] < 200 and brackets["low"] <= 24_999.5 <= brackets["high"]
