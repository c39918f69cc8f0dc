import pytest
from pyspark.sql import functions as F

from shelfprice.operators import joins
from shelfprice.operators.staging import spread, stage


@pytest.fixture
def skewed(spark):
    """A third of the rows share key 0."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500)
    return spark.range(9_000).select(key.cast("long").alias("k"), F.col("id").alias("row"))


def dimension(spark, n=400):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_lookup_equals_plain_join(spark, skewed, how):
    got = joins.spread_lookup(skewed, dimension(spark), "k", how)
    want = skewed.join(dimension(spark), "k", how)
    assert got.columns == ["k", "row", "v"]
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_hot_rows_are_spread(spark, skewed, monkeypatch):
    monkeypatch.setattr(joins, "HOT_SHARE", 0.1)
    plan = joins.spread_lookup(skewed, dimension(spark), "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and "xxhash64" in plan


def test_lookup_picks_by_size(spark, skewed):
    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    small = stage(dimension(spark))
    assert joins.fits_broadcast(small) and "_salt" not in plan(joins.lookup(skewed, small, "k"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not joins.fits_broadcast(small) and "_salt" in plan(joins.lookup(skewed, small, "k"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    with pytest.raises(ValueError):
        joins.lookup(skewed, small, "k", how="right")


def test_rollup_through_keeps_totals(spark, skewed):
    groups = dimension(spark, 500).select("k", (F.col("k") % 3).alias("g"))
    got = joins.rollup_through(skewed, groups, "k", ["g"], {"total": F.col("row")})
    want = skewed.join(groups, "k").groupBy("g").agg(F.count("*").alias("n_rows"), F.sum("row").alias("total"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.select(*got.columns).collect()}


def test_stage_and_spread(spark, skewed):
    kept = stage(skewed)
    assert kept.exceptAll(skewed).isEmpty() and kept.count() == skewed.count()
    few = spark.range(0, 100, 1, numPartitions=1)
    assert spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, numPartitions=64)
    assert spread(many) is many
