import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfprice.operators import profiling, quantiles


@pytest.fixture
def sample(spark):
    rows = [(f"P{i % 10}", 20.0 + i % 7, 9.0 + i % 3, 21.0 + i % 5, float(50 + i % 40), float(5 + (i * 7) % 100)) for i in range(400)]
    return spark.createDataFrame(rows, "product_id string, price double, cost double, competitor_price double, inventory double, units_sold double")


def test_suggested_target_is_units(sample):
    ranked = profiling.target_candidates(sample, "units_sold").collect()
    assert ranked[0]["column"] == "units_sold" and all(0 <= r["suitability"] <= 1 for r in ranked)


def test_quality_falls_with_bad_values(spark, sample):
    good = profiling.quality_score(sample).first()
    bad = spark.createDataFrame([("P1", -50.0, 5.0, 20.0, 60.0, 9.0), ("P1", -1.0, 5.0, 20.0, 60.0, 9.0), ("P2", 25.0, 99999.0, 20.0, 60.0, 9.0)], sample.schema)
    worse = profiling.quality_score(sample.unionByName(bad)).first()
    assert worse["score"] < good["score"]
    assert any("negative" in issue for issue in worse["issues"]) and any("below cost" in issue for issue in worse["issues"])


def test_quality_of_tiny_table(spark):
    row = profiling.quality_score(spark.createDataFrame([("a",), ("b",)], "name string")).first()
    assert row["score"] == 40 and row["label"] == "Poor"  # few rows and nothing numeric


def test_missing_and_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, float("nan")), (3, 1.0)], "a int, b double")
    missing = {r["column"]: r["n_missing"] for r in profiling.profile_missing(df).collect()}
    assert missing == {"a": 0, "b": 3}
    assert profiling.duplicate_count(df).first()["duplicates"] == 1
    assert profiling.duplicate_count(df, ["a"]).first()["distinct_rows"] == 3
    summary = profiling.profile_summary(df).first()
    assert summary["total_missing"] == 3 and summary["numeric_columns"] == 2


def test_sample_is_limited_and_finite(spark, sample):
    roles = {"price": "price", "units": "units_sold", "cost": None}
    assert profiling.latest_sample(sample, roles, ["price", "units_sold"], n=20).count() == 20
    for n in (3, 2001):
        with pytest.raises(ValueError, match="20 to 2,000"):
            profiling.latest_sample(sample, roles, ["price", "units_sold"], n=n)
    odd = spark.createDataFrame([(float("nan"), float("inf"))], "price double, units_sold double")
    row = profiling.latest_sample(odd, roles, ["price"]).first()
    assert row["price"] is None and row["units_sold"] is None


def test_outliers(spark):
    df = spark.createDataFrame([(float(i % 10),) for i in range(200)] + [(1000.0,), (-900.0,)], "v double")
    row = profiling.iqr_outliers(df).first()
    assert row["outliers"] == 2


@pytest.mark.parametrize("whole_range", [100_000, 10])
def test_outliers_in_two_reads(spark, monkeypatch, whole_range):
    """Same quartiles and outliers as numpy, whether or not the sketch narrows the search; two reads of the rows."""
    monkeypatch.setattr(quantiles, "WHOLE_RANGE", whole_range)
    rng = np.random.default_rng(3)
    n = 4000
    v = np.concatenate([rng.normal(100, 5, n - 40), rng.normal(100, 400, 40)]).round(2)
    columns = {"v": v, "flat": np.full(n, 2.0), "skew": np.exp(rng.normal(0, 2, n)).round(3)}
    rows = [(*(float(c[i]) for c in columns.values()), None, float("nan") if i % 2 else 1.0 + i) for i in range(n)]
    table = spark.createDataFrame(rows, "v double, flat double, skew double, none double, gaps double")
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    found = {r["column"]: r for r in profiling.iqr_outliers(table.mapInArrow(passed, table.schema)).collect()}
    columns["gaps"] = np.array([1.0 + i for i in range(0, n, 2)])
    assert set(found) == set(columns)
    for name, values in columns.items():
        q1, q3 = np.quantile(values, [0.25, 0.75])
        far = ((values < q1 - 3 * (q3 - q1)) | (values > q3 + 3 * (q3 - q1))).sum() if q3 > q1 else 0
        assert (found[name]["q1"], found[name]["q3"]) == pytest.approx((q1, q3))
        assert found[name]["outliers"] == far
    assert found["v"]["outliers"] > 10 and found["skew"]["outliers"] > 10
    assert read.value == 2 * n


def test_basic_stats_of_empty_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double").withColumn("w", F.lit(2.345))
    stats = {r["column"]: r for r in profiling.basic_stats(df).collect()}
    assert (stats["v"]["min"], stats["v"]["avg"], stats["v"]["count"]) == (0.0, 0.0, 0)
    assert stats["w"]["max"] in (2.35, 2.34) and stats["w"]["count"] == 2
