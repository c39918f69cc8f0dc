"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS the cores.
"""

from __future__ import annotations

import json
import os
import time

from shelfprice import build_session
from shelfprice.plans import queries

HEADLINE = [
    "portfolio", "portfolio_top", "price_recommendation_profit", "candidate_sweep", "elasticity", "elasticity_pooled",
    "demand_features", "price_position", "product_summary", "stock_cover", "monthly", "category_totals", "top_products",
    "overview", "customer_mix", "damped_trend", "ar1_baseline", "sales_history", "quality_score", "iqr_outliers",
    "median_fill", "normalize_sales", "negotiation", "price_policy", "ridge_model", "customer_segments",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    plans = queries()
    plans["portfolio"](spark, folder).write.format("noop").mode("overwrite").save()  # start-up is not measured
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        plans[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
