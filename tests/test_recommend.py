import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfprice.operators import elasticity, recommend
from shelfprice.sources import retail

STATE = ("product_id string, current_price double, cost double, inventory double, competitor_price double, month int, "
         "n_obs long, intercept double, elasticity double, r2 double, ceiling double, usable boolean")


def state(spark, **over):
    base = dict(product_id="P", current_price=100.0, cost=60.0, inventory=500.0, competitor_price=95.0, month=11,
                n_obs=200, intercept=10.0, elasticity=-1.4, r2=0.4, ceiling=200.0, usable=True)
    return spark.createDataFrame([tuple({**base, **over}.values())], STATE)


def by_hand(price, cost, inventory, a, b, ceiling, objective):
    """Independent brute force over the candidate grid."""
    low = max(0.6 * price, cost if cost and cost > 0 else 0.5 * price)
    high = min(1.45 * price, 1.2 * price)
    best = None
    for p in np.linspace(low, high, 14):
        d = min(max(math.exp(a) * p ** b, 0), ceiling)
        d = min(d, inventory) if inventory > 0 else d
        shown = [math.floor(v * 100 + 0.5) / 100 for v in (p, d, p * d)]
        value = (shown[0] - cost) * shown[1] if objective == "profit" else shown[2]
        if best is None or value > best[0]:
            best = (value, *shown)
    return best[1:]


@pytest.mark.parametrize("objective", ["revenue", "profit"])
@pytest.mark.parametrize("b, inventory, cost", [(-1.4, 500.0, 60.0), (-0.5, 500.0, 60.0), (-3.0, 20.0, 30.0), (-1.1, 0.0, 90.0), (-2.0, 500.0, 115.0)])
def test_recommendation_equals_brute_force(spark, objective, b, inventory, cost):
    a = math.log(50) - b * math.log(100)
    row = recommend.recommend(state(spark, elasticity=b, intercept=a, inventory=inventory, cost=cost), objective).first()
    want = by_hand(100.0, cost, inventory, a, b, 200.0, objective)
    assert (row["recommended_price"], row["expected_demand"], row["expected_revenue"]) == pytest.approx(want, abs=0.011)


def test_invariants_on_the_tables(spark, folder):
    got = recommend.recommend(retail.pricing_rows(spark, folder)).where("supported").cache()
    bad = got.where(
        (F.col("recommended_price") < F.col("cost") - 0.005) | (F.col("recommended_price") > F.col("current_price") * 1.2 + 0.006)
        | (F.col("elasticity") >= -0.01) | (F.size("candidates") != 14)
        | (F.col("expected_revenue") < F.array_max(F.transform("candidates", lambda c: c["revenue"])))
    )
    assert got.count() > 0 and bad.count() == 0
    changes = [abs(r["change_pct"]) for r in recommend.portfolio_top(got, 20).collect()]
    assert changes == sorted(changes, reverse=True)
    got.unpersist()


def outcome(df, **kwargs):
    return recommend.recommend(df, **kwargs).first()


def test_unsupported_outcomes(spark):
    assert outcome(state(spark, current_price=None))["outcome"] == recommend.NO_PRICE
    assert outcome(state(spark, usable=False))["outcome"] == recommend.NO_CURVE
    row = outcome(state(spark, cost=130.0))
    assert row["outcome"] == recommend.FLOOR_ABOVE_CAP and row["recommended_price"] is None
    assert recommend.unsupported(recommend.recommend(state(spark, cost=130.0))).count() == 1


def test_missing_price_falls_back(spark):
    row = outcome(state(spark, current_price=None), fallback_price=F.lit(100.0))
    assert row["supported"] and row["current_price"] == 100.0


def test_without_cost_the_floor_is_half(spark):
    row = outcome(state(spark, cost=None, elasticity=-3.0, intercept=20.0, ceiling=1e9, inventory=None))
    assert row["expected_profit"] is None and row["recommended_price"] >= 60.0
    assert row["rules"] == ["max-single-step-increase"]


def test_ties_take_the_lowest_price(spark):
    row = outcome(state(spark, elasticity=-1.0, intercept=math.log(5000.0), ceiling=1e9, inventory=0.0, cost=None))
    best = [c["price"] for c in row["candidates"] if c["revenue"] == row["expected_revenue"]]
    assert row["recommended_price"] == min(best)


@pytest.mark.parametrize("over, score, level", [
    (dict(), 9, "High"), (dict(n_obs=40, r2=0.15), 7, "High"), (dict(n_obs=10, r2=0.01, elasticity=-5.0), 4, "Medium"),
    (dict(n_obs=10, r2=0.01, elasticity=-5.0, cost=110.0), 3, "Low"),
])
def test_reliability(spark, over, score, level):
    row = recommend.reliability(state(spark, **over)).first()
    assert (row["reliability_score"], row["reliability"]) == (score, level)


def test_reasons(spark):
    rows = recommend.recommendation_reasons(recommend.recommend(state(spark, elasticity=-0.4, intercept=5.0)))
    codes = [r["code"] for r in rows.first()["reasons"]]
    assert codes[0] == "raise" and "above_competitor" in codes and "objective_revenue" in codes
    assert codes[-2:] == ["rule:price-floor-at-cost", "rule:max-single-step-increase"]
    profit = recommend.recommendation_reasons(recommend.recommend(state(spark), "profit")).first()["reasons"]
    assert "objective_profit" in [r["code"] for r in profit]
    context = recommend.context_reasons(recommend.recommend(state(spark, inventory=10.0))).first()["reasons"]
    assert [r["code"] for r in context][0] == "low_stock" and "peak_season" in [r["code"] for r in context]


def sold(spark, rows):
    return spark.createDataFrame(rows, "product_id string, price double, units_sold double")


def test_curve_equals_polyfit(spark):
    rng = np.random.default_rng(1)
    price = rng.uniform(5, 20, 200)
    units = np.maximum(1, np.round(500 * price ** -1.3 * rng.lognormal(0, 0.2, 200)))
    b, a = np.polyfit(np.log(price), np.log(units), 1)
    rows = [("A", float(p), float(u)) for p, u in zip(price, units)] + [("A", -1.0, 5.0), ("A", 5.0, 0.0)]
    row = elasticity.fit_curves(sold(spark, rows)).first()
    assert row["elasticity"] == pytest.approx(b) and row["intercept"] == pytest.approx(a)
    assert row["r2"] == pytest.approx(np.corrcoef(np.log(price), np.log(units))[0, 1] ** 2)
    assert row["n_obs"] == 200 and row["ceiling"] == 1.5 * units.max() and row["usable"]


def test_unusable_curves_and_pooled_fallback(spark):
    good = [("good", float(p), float(1000 / p)) for p in range(5, 25)]
    few = [("few", float(p), float(900 / p)) for p in range(5, 12)]
    rising = [("rising", float(p), float(p)) for p in range(5, 25)]
    flat = [("flat", 10.0, float(u)) for u in range(1, 20)]
    rows = sold(spark, good * 5 + few + rising + flat)
    curves = elasticity.fit_curves(rows)
    assert {r["product_id"]: r["usable"] for r in curves.collect()} == {"good": True, "few": False, "rising": False, "flat": False}
    fitted = {r["product_id"]: r for r in elasticity.with_pooled_fallback(curves, elasticity.pooled_curve(rows)).collect()}
    assert fitted["good"]["kind"] == "product" and fitted["few"]["kind"] == "category"
    assert fitted["few"]["elasticity"] == fitted["flat"]["elasticity"] and fitted["few"]["usable"]
    none = elasticity.with_pooled_fallback(elasticity.fit_curves(sold(spark, rising)), elasticity.pooled_curve(sold(spark, rising)))
    assert none.first()["kind"] == "unsupported" and not none.first()["usable"]


def test_constant_units_have_no_fit(spark):
    row = elasticity.fit_curves(sold(spark, [("A", float(p), 5.0) for p in range(5, 25)])).first()
    assert row["r2"] == 0.0 and not row["usable"]


def test_fixed_elasticity(spark):
    df = spark.createDataFrame([("P", 100.0, 60.0)], "product_id string, current_price double, cost double")
    row = recommend.fixed_elasticity_price(df, price_range=0.20).first()
    prices = np.linspace(80, 120, 11)
    demand = [max(1, math.floor(60 * (p / 100) ** -1 + 0.5)) for p in prices]
    best = max(range(11), key=lambda i: (prices[i] - 60) * demand[i])
    assert row["recommended_price"] == pytest.approx(prices[best]) and row["predicted_demand"] == demand[best]


@pytest.mark.parametrize("code, usd, want", [("INR", 125000.0, 10375000.0), ("INR", 49.99, 4149.17), ("EUR", 49.99, 45.99), ("GBP", 49.99, 39.49), ("XXX", 5.0, 5.0)])
def test_currency(spark, code, usd, want):
    row = recommend.convert_currency(spark.createDataFrame([(usd,)], "price double"), ["price"], code).first()
    assert row["price"] == pytest.approx(want) and row["currency"] == ("USD" if code == "XXX" else code)


def test_discount_grid(spark):
    rows = recommend.discount_grid(state(spark)).orderBy("discount_pct").collect()
    assert [r["price"] for r in rows] == [100.0, 95.0, 90.0, 85.0, 80.0]
    assert [r["demand"] for r in rows] == sorted(r["demand"] for r in rows)
    assert rows[0]["confidence_pct"] == 90  # near the competitor and a healthy margin, but much stock


def test_equal_rounded_candidates_take_the_first_step(spark):
    row = outcome(state(spark, cost=119.99, elasticity=-0.5, intercept=5.0, inventory=3.0), objective="profit")
    scores = [(c["price"] - 119.99) * c["demand"] for c in row["candidates"]]
    first = row["candidates"][scores.index(max(scores))]
    assert (row["expected_revenue"], row["expected_profit"]) == (first["revenue"], first["profit"])


def test_lines_are_read_once(spark, folder):
    """The curve of all products comes from the staged moments, not from the lines again."""
    from shelfprice.sources import retail

    plan = retail.pricing_rows(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan
