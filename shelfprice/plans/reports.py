"""Catalogue and receipt reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfprice.functions import cents, from_cents, round_to, to_cents
from shelfprice.operators import analytics
from shelfprice.operators.joins import rollup_through
from shelfprice.operators.recommend import recommend
from shelfprice.operators.staging import stage
from shelfprice.plans.registry import query
from shelfprice.plans.series import RECENT
from shelfprice.plans.views import HOLIDAY, SEASON, WEEKEND, half_up, money, sql
from shelfprice.sources import retail



def _money(name: str):
    return to_cents(F.col(name))


def _cells(spark, folder):
    return analytics.catalogue_cells(retail.lines(spark, folder), retail.products(spark, folder))


def _mean(total: str):
    return from_cents(F.col(total)) / F.col("n_rows")


def product_lines(spark, folder):
    totals = rollup_through(
        retail.till(spark, folder), retail.shelves(spark, folder), "l_partkey", ["product_line"],
        {"sales": _money("sales"), "price": _money("price"), "quantity": F.col("quantity")},
    )
    return totals.select(
        "product_line", from_cents(F.col("sales")).alias("total_sales"), cents(_mean("price")).alias("avg_price"),
        cents(F.col("quantity") / F.col("n_rows")).alias("avg_quantity"), F.col("quantity").alias("total_quantity"),
    )


def branches(spark, folder):
    totals = rollup_through(
        retail.till(spark, folder), retail.stores(spark, folder), "l_suppkey", ["branch"], {"sales": _money("sales"), "price": _money("price")}
    )
    return totals.select("branch", from_cents(F.col("sales")).alias("total_sales"), cents(_mean("price")).alias("avg_price"))


LINE_REPORT = f"""
    SELECT p_type AS product_line, {money('sales')} AS total_sales, {half_up("CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) / count(*)", 2)} AS avg_price,
           {half_up("sum(quantity) / count(*)", 2)} AS avg_quantity, sum(quantity) AS total_quantity
    FROM till JOIN part ON l_partkey = p_partkey GROUP BY p_type"""
BRANCH_REPORT = f"""
    SELECT n_name AS branch, {money('sales')} AS total_sales, {half_up("CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) / count(*)", 2)} AS avg_price
    FROM till JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"""


@query(sql("SELECT * FROM report", "till", report=LINE_REPORT))
def product_line_report(spark, folder):
    return product_lines(spark, folder)


@query(sql("SELECT * FROM report", "till", report=BRANCH_REPORT))
def branch_report(spark, folder):
    return branches(spark, folder)


@query(sql("""
(SELECT 'best_line' AS board, product_line AS name, total_sales FROM line_report ORDER BY total_sales DESC, name LIMIT 3)
UNION ALL (SELECT 'worst_line', product_line AS name, total_sales FROM line_report ORDER BY total_sales, name LIMIT 3)
UNION ALL (SELECT 'best_branch', branch AS name, total_sales FROM branch_report ORDER BY total_sales DESC, name LIMIT 3)
UNION ALL (SELECT 'worst_branch', branch AS name, total_sales FROM branch_report ORDER BY total_sales, name LIMIT 3)
""", "till", line_report=LINE_REPORT, branch_report=BRANCH_REPORT))
def best_worst_lines(spark, folder):
    boards = []
    for kind, report, name in (("line", stage(product_lines(spark, folder)), "product_line"), ("branch", stage(branches(spark, folder)), "branch")):
        named = report.select(F.col(name).alias("name"), "total_sales")
        for rank, order in (("best", F.desc("total_sales")), ("worst", F.asc("total_sales"))):
            boards.append(named.orderBy(order, "name").limit(3).select(F.lit(f"{rank}_{kind}").alias("board"), "name", "total_sales"))
    result = boards[0]
    for board in boards[1:]:
        result = result.unionByName(board)
    return result


@query(sql(f"SELECT date, {money('sales')} AS sales FROM till GROUP BY date", "till"))
def sales_by_date(spark, folder):
    return retail.till(spark, folder).groupBy("date").agg(from_cents(F.sum(_money("sales"))).alias("sales"))


@query(sql("""
SELECT hour, avg_sales, avg_sales = (SELECT max(avg_sales) FROM hours) AS peak, avg_sales = (SELECT min(avg_sales) FROM hours) AS low
FROM hours
""", hours=f"SELECT CAST(hour(ts) AS INTEGER) AS hour, {half_up(money('value') + ' / count(*)', 6)} AS avg_sales FROM events GROUP BY 1"))
def sales_by_hour(spark, folder):
    hours = retail.table(spark, folder, "events").groupBy(F.hour("ts").alias("hour")).agg(
        round_to(from_cents(F.sum(_money("value"))) / F.count("*"), 6).alias("avg_sales")
    )
    return analytics.flag_extremes(hours, "hour", "avg_sales", "peak", "low")


@query(sql(f"""
SELECT 'customer_type' AS attribute, c_mktsegment AS name, count(*) AS n_rows, {half_up(money('sales') + ' / count(*)', 2)} AS avg_sales
FROM till JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
UNION ALL SELECT 'gender', gender, count(*), {half_up(money('sales') + ' / count(*)', 2)} FROM till GROUP BY gender
""", "till"))
def customer_mix(spark, folder):
    till = retail.till(spark, folder)
    per_buyer = rollup_through(till, retail.receipts(spark, folder), "l_orderkey", ["c_custkey"], {"sales": _money("sales")})
    by_type = per_buyer.join(retail.buyers(spark, folder), "c_custkey").groupBy("customer_type").agg(
        F.sum("sales").alias("sales"), F.sum("n_rows").alias("n_rows")
    )
    by_gender = till.groupBy("gender").agg(F.sum(_money("sales")).alias("sales"), F.count("*").alias("n_rows"))
    parts = [
        groups.select(F.lit(c).alias("attribute"), F.col(c).alias("name"), "n_rows", cents(_mean("sales")).alias("avg_sales"))
        for c, groups in (("customer_type", by_type), ("gender", by_gender))
    ]
    return parts[0].unionByName(parts[1])


@query("SELECT o_orderpriority AS payment, count(*) AS n_rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def payment_mix(spark, folder):
    return rollup_through(retail.till(spark, folder), retail.receipts(spark, folder), "l_orderkey", ["payment"], {})


@query(sql(f"""
SELECT product_id, category, {half_up("base", 2)} AS base_price, {half_up("cost", 2)} AS cost, {half_up("comp", 2)} AS competitor_price,
       {half_up("stock30", 0)} AS inventory, {half_up("units / days", 1)} AS avg_daily,
       {half_up("stock7 / greatest(0.1, units / days)", 0)} AS days_left, units, {half_up("revenue", 0)} AS revenue, {half_up("profit", 0)} AS profit,
       {half_up("(base - cost) / base * 100.0", 1)} AS margin_pct
FROM (SELECT product_id, category, quantile_cont(price, 0.5) AS base, quantile_cont(cost, 0.5) AS cost, quantile_cont(competitor_price, 0.5) AS comp,
             sum(units_sold) AS units, count(DISTINCT date) AS days, {money('price * units_sold')} AS revenue,
             {money('(price - cost) * units_sold')} AS profit FROM sales GROUP BY product_id, category)
JOIN (SELECT product_id, quantile_cont(inventory, 0.5) FILTER (recency <= 30) AS stock30, quantile_cont(inventory, 0.5) FILTER (recency <= 7) AS stock7
      FROM recent GROUP BY product_id) USING (product_id)
""", "sales", recent=RECENT))
def product_summary(spark, folder):
    return analytics.product_summary(retail.sales(spark, folder), retail.LATEST_FIRST)


@query(sql(f"""
SELECT product_id, date, units, CAST(revenue AS DOUBLE) AS revenue, {half_up("CAST(price_total AS DOUBLE) / n_rows", 4)} AS avg_price FROM cells
""", "cells"))
def daily_series(spark, folder):
    return analytics.daily_series(_cells(spark, folder))


MONTHS = f"""
    SELECT m AS month, coalesce(units, 0.0) AS units, coalesce(revenue, 0.0) AS revenue, coalesce(profit, 0.0) AS profit,
           coalesce({SEASON.replace('month', 'm')}, 0.0) AS seasonal_factor
    FROM (SELECT CAST(range AS INTEGER) AS m FROM range(1, 13))
    LEFT JOIN (SELECT CAST(month(date) AS INTEGER) AS k, sum(units) AS units, CAST(sum(revenue) AS DOUBLE) AS revenue,
                      CAST(sum(profit) AS DOUBLE) AS profit FROM cells GROUP BY 1) ON k = m"""


@query(sql("""
SELECT *, month = (SELECT month FROM months ORDER BY units DESC, month LIMIT 1) AS best_month,
       month = (SELECT month FROM months ORDER BY units, month LIMIT 1) AS worst_month FROM months
""", "cells", months=MONTHS))
def monthly(spark, folder):
    return analytics.monthly(_cells(spark, folder))


@query(sql("""
SELECT coalesce(CAST(quarter(date) AS INTEGER), 0) AS quarter, coalesce(CAST(month(date) AS INTEGER), 0) AS month, sum(units) AS units
FROM cells GROUP BY ROLLUP (CAST(quarter(date) AS INTEGER), CAST(month(date) AS INTEGER))
""", "cells"))
def seasons(spark, folder):
    return analytics.seasons(_cells(spark, folder))


@query(sql(f"""
SELECT (SELECT quarter FROM quarters ORDER BY units DESC, quarter LIMIT 1) AS best_season,
       (SELECT quarter FROM quarters ORDER BY units, quarter LIMIT 1) AS worst_season,
       {half_up("(max(units) / greatest(1.0, min(units)) - 1.0) * 100.0", 0)} AS gap_pct FROM quarters
""", "cells", quarters="SELECT CAST(quarter(date) AS INTEGER) AS quarter, sum(units) AS units FROM cells GROUP BY 1"))
def season_summary(spark, folder):
    return analytics.season_summary(_cells(spark, folder))


FESTIVAL = "CAST(month(date) IN (1, 4, 11, 12) AS INTEGER)"


def _mean_units(test: str) -> str:
    return f"sum(units) FILTER ({test}) / sum(n_rows) FILTER ({test})"


EFFECTS = f"""
    SELECT {", ".join(f"{_mean_units(f'{test} = {flag}')} AS {name}" for name, test, flag in (
        ("weekend", WEEKEND, 1), ("weekday", WEEKEND, 0), ("holiday", HOLIDAY, 1), ("nonholiday", HOLIDAY, 0),
        ("festival", FESTIVAL, 1), ("regular", FESTIVAL, 0)))}
    FROM cells"""


@query(sql(f"""
SELECT {", ".join(f"{half_up(name, 1)} AS {name}_units" for name in ("weekend", "weekday", "holiday", "nonholiday", "festival", "regular"))},
       {half_up("(holiday - nonholiday) / nonholiday * 100.0", 0)} AS holiday_impact_pct
FROM effects
""", "cells", effects=EFFECTS))
def calendar_effects(spark, folder):
    return analytics.calendar_effects(_cells(spark, folder))


GROUPS = "SELECT category, sum(revenue) AS revenue, sum(profit) AS profit FROM totals GROUP BY category"


@query(sql("""
SELECT *, category = (SELECT category FROM groups ORDER BY revenue DESC, category LIMIT 1) AS best_revenue,
       category = (SELECT category FROM groups ORDER BY revenue, category LIMIT 1) AS worst_revenue,
       category = (SELECT category FROM groups ORDER BY profit DESC, category LIMIT 1) AS best_profit,
       category = (SELECT category FROM groups ORDER BY profit, category LIMIT 1) AS worst_profit FROM groups
""", "totals", groups=GROUPS))
def category_totals(spark, folder):
    return analytics.category_totals(analytics.product_totals(_cells(spark, folder)))


@query(sql("""
(SELECT 'top_profit' AS board, product_id, profit, revenue FROM totals ORDER BY profit DESC, product_id LIMIT 5)
UNION ALL (SELECT 'lowest_profit', product_id, profit, revenue FROM totals ORDER BY profit, product_id LIMIT 1)
UNION ALL (SELECT 'top_revenue', product_id, profit, revenue FROM totals ORDER BY revenue DESC, product_id LIMIT 5)
UNION ALL (SELECT 'lowest_revenue', product_id, profit, revenue FROM totals ORDER BY revenue, product_id LIMIT 1)
""", "totals"))
def top_products(spark, folder):
    return analytics.top_products(stage(analytics.product_totals(_cells(spark, folder))))


@query(sql(f"""
SELECT max(date) AS generated_on, count(DISTINCT product_id) AS products, CAST(sum(n_rows) AS BIGINT) AS total_sales_rows,
       sum(units) FILTER (recent) AS sales_last_30d, {half_up("sum(units) FILTER (recent) / sum(n_rows) FILTER (recent)", 1)} AS avg_daily_units,
       {half_up("CAST(sum(price_total) FILTER (recent) AS DOUBLE) / sum(n_rows) FILTER (recent)", 2)} AS avg_price,
       (SELECT count(*) FROM customer) AS customers
FROM (SELECT *, date >= (SELECT max(date) - 30 FROM cells) AS recent FROM cells)
""", "cells"))
def overview(spark, folder):
    return analytics.overview(retail.lines(spark, folder), retail.table(spark, folder, "customer"))


@query(sql(f"""
SELECT product_id, CAST(month(date) AS INTEGER) AS month, {half_up("CAST(sum(price_total) AS DOUBLE) / sum(n_rows)", 4)} AS avg_price
FROM cells GROUP BY 1, 2
""", "cells"))
def price_trend(spark, folder):
    return analytics.price_trend(_cells(spark, folder))


@query(sql(f"""
SELECT (SELECT CAST(sum(n_rows) AS BIGINT) FROM cells) AS records, (SELECT count(*) FROM totals) AS products,
       (SELECT count(*) FROM months WHERE units > 0) AS months, b.product_id AS top_product, b.profit AS top_profit,
       c.category AS top_category, c.revenue AS top_category_revenue, hi.name AS peak_month, hi.units AS peak_units, lo.name AS weak_month,
       {half_up("(holiday - nonholiday) / nonholiday * 100.0", 0)} AS holiday_impact_pct, {half_up("weekend", 1)} AS weekend_units,
       {half_up("weekday", 1)} AS weekday_units, r.product_id AS example_product,
       {half_up("(r.recommended_price - r.current_price) / r.current_price * 100.0", 1)} AS example_change_pct
FROM effects, (SELECT * FROM totals ORDER BY profit DESC, product_id LIMIT 1) b, (SELECT * FROM groups ORDER BY revenue DESC, category LIMIT 1) c,
     (SELECT * FROM months ORDER BY units DESC, month LIMIT 1) hi, (SELECT * FROM months ORDER BY units, month LIMIT 1) lo,
     (SELECT * FROM recommended ORDER BY product_id LIMIT 1) r
""", "totals", "recommended", effects=EFFECTS, groups=GROUPS,
    months="SELECT month(date) AS month, strftime(min(date), '%b') AS name, sum(units) AS units FROM cells GROUP BY 1"))
def insight(spark, folder):
    prices = recommend(retail.pricing_rows(spark, folder)).where("supported")
    return analytics.insight(stage(_cells(spark, folder)), prices).drop("story")
