import json

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from shelfprice.models import demand, holdout, linear, pricing, segments
from shelfprice.sources import load_model, save_model, write_json

TINY = {"numTrees": 3, "maxIter": 2, "maxDepth": 3}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    n = 600
    price, rival, stock = rng.uniform(10, 30, n), rng.uniform(10, 30, n), rng.uniform(5, 90, n)
    units = np.maximum(0, 60 - 1.5 * price + 0.8 * rival + 0.1 * stock + rng.normal(0, 2, n))
    data = [(i, float(p), float(r), float(s), "ab"[i % 2], float(u)) for i, (p, r, s, u) in enumerate(zip(price, rival, stock, units))]
    return spark.createDataFrame(data, "id long, price double, competitor_price double, inventory double, category string, units_sold double").cache()


NUMERIC = ["price", "competitor_price", "inventory"]


def test_holdout_is_a_fifth_and_stable(rows):
    share = rows.agg(F.avg(holdout.is_test("id").cast("double"))).first()[0]
    assert 0.14 < share < 0.26
    again = rows.repartition(7).where(holdout.is_test("id")).select("id")
    assert again.exceptAll(rows.where(holdout.is_test("id")).select("id")).isEmpty()


def test_metrics_match_numpy(rows):
    scored = holdout.line_baseline(rows, "price", "units_sold", "id")
    got = holdout.regression_metrics(scored, "units_sold", "predicted").first()
    data = scored.select("units_sold", "predicted").toPandas()
    error = data["units_sold"] - data["predicted"]
    assert got["mae"] == pytest.approx(error.abs().mean()) and got["rmse"] == pytest.approx(np.sqrt((error ** 2).mean()))
    assert got["r2"] == pytest.approx(1 - (error ** 2).sum() / ((data["units_sold"] - data["units_sold"].mean()) ** 2).sum())


def test_comparison(spark, rows, tmp_path):
    compared = demand.compare(rows, ["id"], NUMERIC, demand.regressors(TINY), categorical=["category"], folds=3)
    table = {r["name"]: r for r in compared.table().collect()}
    assert set(table) == {"Linear Regression", "Random Forest", "Gradient Boosting", "Deep Boosting"}
    assert compared.train.count() + compared.test.count() == rows.count()
    assert compared.best == min(table, key=lambda n: table[n]["rmse"]) and sum(r["is_best"] for r in table.values()) == 1
    assert table["Linear Regression"]["r2"] > 0.8 and abs(table["Linear Regression"]["cv_r2_mean"] - table["Linear Regression"]["r2"]) < 0.1
    for name in table:
        shares = demand.feature_importance(compared.models[name], compared.test).collect()
        assert sum(r["importance"] for r in shares) == pytest.approx(1.0)
        assert [r["importance"] for r in shares] == sorted((r["importance"] for r in shares), reverse=True)
    assert {r["feature"] for r in shares} >= {"price", "competitor_price", "inventory"}
    assert compared.predictions("Random Forest").where("prediction < 0").count() == 0
    sample = demand.prediction_sample(compared.predictions(), ["id"], n=40)
    assert sample.count() == 40
    path = write_json(demand.report(compared), str(tmp_path / "report"))
    text = "".join(f.read_text() for f in (tmp_path / "report").glob("*.json"))
    assert json.loads(text)["winner"] == compared.best and path
    again = load_model(save_model(compared.models["Linear Regression"], str(tmp_path / "model")))
    assert again.transform(compared.test).count() == compared.test.count()
    fresh = demand.retrain(compared, rows, keys=["id"], numeric=NUMERIC, models={"Linear": LinearRegression(labelCol="units_sold")}, folds=1)
    assert fresh.best == "Linear" and fresh.metrics[0]["r2"] > 0.8
    fresh.release()


@pytest.fixture(scope="module")
def products(spark):
    data = [(f"P{i}", "c", 15.0 + i, 8.0 + i, 16.0 + i, 40.0 + i, 0.0, 3, 70, 20.0, 10.0) for i in range(8)]
    return spark.createDataFrame(data, "product_id string, category string, base_price double, cost double, competitor_price double, inventory double, "
                                       "is_weekend double, month int, doy int, cat_mean_price double, recent_units double")


def test_model_prices(rows, products):
    compared = demand.compare(rows, ["id"], NUMERIC, {"linear": LinearRegression(labelCol="units_sold")}, folds=1)
    model = compared.models["linear"]
    grid = pricing.model_price_grid(products, model).collect()
    assert len(grid) == 8 and all(r["recommended_price"] >= r["cost"] and r["expected_revenue"] >= 0 for r in grid)
    compared.release()


PRICED = ["price", "price_vs_competitor", "price_ratio_to_base", "price_over_cat", "inventory"]


@pytest.mark.parametrize("scaled", [False, True])
def test_exact_prices_are_the_best_of_all_cents(spark, scaled):
    rng = np.random.default_rng(8)
    n = 500
    price, rival, mean, cat = rng.uniform(8, 30, n), rng.uniform(10, 25, n), rng.uniform(12, 20, n), rng.uniform(14, 18, n)
    units = np.maximum(0, 70 - 2 * price + np.where(price > 19, -15, 0) + (rival - price) + rng.normal(0, 3, n))
    data = [tuple(map(float, (i, p, p - r, p / m, p - c, 50.0, u))) for i, (p, r, m, c, u) in enumerate(zip(price, rival, mean, cat, units))]
    table = spark.createDataFrame(data, ", ".join(f"{c} double" for c in ["id", *PRICED, "units_sold"]))
    models = {"trees": demand.demand_regressors({"maxIter": 5, "maxDepth": 4})["boosted"]}
    compared = demand.compare(table, ["id"], PRICED, models, folds=1, scaled=scaled)
    model = compared.models["trees"]
    assert set(pricing.price_thresholds(model)) == set(PRICED[:4])
    data = [(f"P{i}", "c", 12.0 + i, 6.0 + i, 13.0 + i, 40.0, 0.0, 3, 70, 16.0, 10.0, 15.0 + i / 2) for i in range(6)]
    products = spark.createDataFrame(data + [("dear", "c", 10.0, 50.0, 9.0, 40.0, 0.0, 3, 70, 16.0, 10.0, 10.0)], (
        "product_id string, category string, base_price double, cost double, competitor_price double, inventory double, is_weekend double, "
        "month int, doy int, cat_mean_price double, recent_units double, mean_price double"))
    got = {r["product_id"]: r for r in pricing.model_price_exact(products, model).collect()}
    for r in products.collect():
        low = max(r["cost"], r["base_price"] * 0.8, r["competitor_price"] * 0.9)
        high = max(r["cost"] + 0.01, min(r["base_price"] * 1.3, r["competitor_price"] * 1.25))
        cents = range(int(np.ceil(low * 100 - 1e-6)), int(np.floor(high * 100 + 1e-6)) + 1)
        tried = products.where(F.col("product_id") == r["product_id"]).crossJoin(spark.createDataFrame([(c / 100.0,) for c in cents], "price double"))
        every = demand.score(model, pricing.model_rows(tried)).select("price", F.least("prediction", "inventory").alias("units")).collect()
        best = max(every, key=lambda x: (x["price"] * x["units"], -x["price"]))
        row = got[r["product_id"]]
        assert row["recommended_price"] == pytest.approx(best["price"]), r["product_id"]
        assert row["expected_revenue"] == pytest.approx(best["price"] * best["units"], abs=0.006)
        assert row["n_prices"] < max(len(cents), 2)
    grid = {r["product_id"]: r for r in pricing.model_price_grid(products, model).collect()}
    assert all(got[p]["expected_revenue"] >= grid[p]["expected_revenue"] - 0.01 * 40 for p in grid)
    compared.release()


def test_linear_prices(products):
    line = linear.Line(["price", "competitor_price", "inventory", "price_gap"], 60.0, [-1.0, 0.4, 0.1, 0.5])
    swept = {r["product_id"]: r for r in pricing.prediction_table(products, line).collect()}
    profit = {r["product_id"]: r for r in pricing.prediction_table(products, line, "profit").collect()}
    for r in products.collect():
        low, high = max(r["cost"] * 1.02, 0.01), max(r["base_price"] * 1.2, r["competitor_price"] * 1.05)

        def units(price):
            said = 60 - price + 0.4 * r["competitor_price"] + 0.1 * r["inventory"] + 0.5 * (r["competitor_price"] - price)
            return min(max(said, 0.0), r["inventory"])

        prices = [low + k * (high - low) / 120 for k in range(121)]
        for found, cost in ((swept, 0.0), (profit, r["cost"])):
            best = max(prices, key=lambda p: (p - cost) * units(p))
            assert found[r["product_id"]]["recommended_price"] == pytest.approx(best, abs=0.0051)
            assert found[r["product_id"]]["expected_demand"] == pytest.approx(units(best), abs=0.051)
    plan = pricing.prediction_table(products, line)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    impacts = pricing.what_if_scenarios(products, line)
    assert impacts.count() == 32
    assert impacts.where("feature = 'price' and impact_pct >= 0").count() == 0
    assert impacts.where("feature = 'competitor_price' and impact_pct <= 0").count() == 0
    assert impacts.where("feature = 'weekend' and impact_pct <> 0").count() == 0  # not an input of this line


def test_segments(spark):
    rng = np.random.default_rng(4)
    data = [(i, float(rng.uniform(0, 100)), int(rng.integers(0, 40)), float(10 * (i % 4) + rng.uniform(0, 1))) for i in range(200)]
    customers = spark.createDataFrame(data, "customer_id long, loyalty_score double, purchase_count int, avg_sales double")
    found = segments.segment(customers)
    assert {r["segment_label"] for r in found.collect()} == set(segments.SEGMENT_NAMES)
    assert {r["loyalty_tier"] for r in found.collect()} == {"Gold", "Silver", "Bronze", "New"}
    counts = segments.segment_counts(found).collect()
    assert sum(r["customers"] for r in counts) == 200
    means = [r["m"] for r in found.groupBy("segment").agg(F.avg("avg_sales").alias("m")).orderBy("segment").collect()]
    assert means[0] < means[-1]


def test_latest_row_at_its_own_price_is_the_training_row(spark, folder):
    """Scoring a product at its latest price uses the inputs that training had."""
    from shelfprice.operators import features
    from shelfprice.plans.series import daily_sales

    rows = features.demand_features(daily_sales(spark, folder))
    latest = pricing.latest_rows(rows)
    scored = pricing.model_rows(latest.withColumn("price", F.col("base_price"))).select(
        "product_id", *[F.col(c).cast("double").alias(f"own_{c}") for c in demand.DEMAND_FEATURES])
    trained = rows.groupBy("product_id").agg(F.max("date").alias("date")).join(rows, ["product_id", "date"])
    pairs = trained.join(scored, "product_id").collect()
    assert len(pairs) > 100
    for r in pairs:
        for c in demand.DEMAND_FEATURES:
            assert r[f"own_{c}"] == pytest.approx(float(r[c]), rel=1e-9, abs=1e-9), c
