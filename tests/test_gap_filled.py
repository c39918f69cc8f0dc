"""The missing days of each product, against pandas."""

import pandas as pd
from pyspark.sql import functions as F

from shelfprice import plans
from shelfprice.operators import features
from shelfprice.operators.staging import by_key
from shelfprice.sources import retail


def test_every_product_has_every_day(spark, folder):
    lines = retail.lines(spark, folder).select("product_id", "date", "units_sold").toPandas()
    lines["date"] = pd.to_datetime(lines["date"])
    want = {}
    for product, own in lines.groupby("product_id"):
        units = own.groupby("date")["units_sold"].sum()
        for day in pd.date_range(units.index.min(), units.index.max()):
            want[product, day.date()] = float(units.get(day, 0.0))
    rows = plans.queries()["gap_filled_products"](spark, folder).collect()
    assert len(rows) == len(want) > len(lines)
    assert {(r["product_id"], r["date"]): float(r["units"]) for r in rows} == want


def test_days_are_made_where_the_cells_are(spark):
    """No day is moved after it is made, and days of no key have no units."""
    cells = spark.createDataFrame([("a", "2024-01-01", 2.0), ("a", "2024-01-04", 3.0), ("a", "2024-01-04", 4.0), (None, "2024-01-01", 5.0), ("b", None, 1.0)],
                                  "k string, date string, units double").withColumn("date", F.col("date").cast("date"))
    filled = features.gap_filled(cells, "k")
    assert sorted(((r["k"] or "", r["date"].day, r["units"]) for r in filled.collect())) == [
        ("", 1, 0.0), ("a", 1, 2.0), ("a", 2, 0.0), ("a", 3, 0.0), ("a", 4, 7.0)]
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange") and "Join" not in plan
    assert by_key(cells, "k").rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
