"""Refits from stored statistics equal those from all rows."""

import pytest
from pyspark.sql import functions as F

from shelfprice.operators import elasticity as curves
from shelfprice.operators.batches import Batches
from shelfprice.sources import retail

FIELDS = ["n_obs", "intercept", "elasticity", "r2", "ceiling", "usable"]


@pytest.fixture
def lines(spark, folder):
    return retail.lines(spark, folder).withColumn("year", F.year("date"))


def moments(rows, *by):
    return rows.groupBy(*by, "product_id").agg(*curves.curve_aggregates())


def check(kept, rows):
    got = {r["product_id"]: r for r in curves.finish_curve(curves.merged_moments(kept.read(), "product_id")).collect()}
    want = {r["product_id"]: r for r in curves.fit_curves(rows).collect()}
    assert got.keys() == want.keys()
    for key, row in want.items():
        for field in FIELDS:
            assert got[key][field] == pytest.approx(row[field], rel=1e-7, abs=1e-7), (key, field)


def test_append_replace_and_remove(spark, lines, tmp_path):
    kept = Batches(spark, str(tmp_path / "curves"))
    kept.put_each(moments(lines.where("year < 1999"), "year"), "year")
    check(kept, lines.where("year < 1999"))
    kept.put("later", moments(lines.where("year >= 1999")))
    check(kept, lines)
    kept.put("1996", moments(lines.where("year = 1996 AND units_sold > 10")))  # corrected rows of a year
    check(kept, lines.where("year <> 1996 OR units_sold > 10"))
    assert kept.remove("1997") and not kept.remove("1997")
    check(kept, lines.where("year <> 1997 AND (year <> 1996 OR units_sold > 10)"))


def test_a_refit_reads_no_lines(spark, lines, tmp_path):
    kept = Batches(spark, str(tmp_path / "curves"))
    kept.put("all", moments(lines))
    plan = curves.merged_moments(kept.read(), "product_id")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan


def test_products_without_sold_units(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.0, 0.0), (1, 3.0, 0.0), (2, 2.0, 5.0)], "product_id long, price double, units_sold double")
    kept = Batches(spark, str(tmp_path / "curves"))
    kept.put("a", moments(rows.where("product_id = 1")))
    kept.put("b", moments(rows))
    got = {r["product_id"]: r for r in curves.finish_curve(curves.merged_moments(kept.read(), "product_id")).collect()}
    assert (got[1]["n_obs"], got[1]["usable"], got[2]["n_obs"], got[2]["elasticity"]) == (0, False, 1, None)


@pytest.mark.parametrize("name", ["", "a/b", "x=y"])
def test_names(spark, tmp_path, name):
    with pytest.raises(ValueError, match="name of a batch"):
        Batches(spark, str(tmp_path)).remove(name)
