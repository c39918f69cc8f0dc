"""Windows and time series per product."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfprice.functions import round_to
from shelfprice.operators import analytics, features
from shelfprice.operators.digest import table_digest
from shelfprice.operators.staging import stage
from shelfprice.plans.registry import query
from shelfprice.plans.views import digest_sql, half_up, sql
from shelfprice.sources import retail

# The test products have 14 to 49 lines each; 60 is meant for years of daily rows.
MIN_SERIES_ROWS = 20

DAILY = """
    SELECT product_id, category, date, units AS units_sold, CAST(price_total AS DOUBLE) / n_rows AS price,
           list_price * (1.0 + tax_total / n_rows) AS competitor_price, stock + most AS inventory
    FROM (SELECT product_id, date, count(*) AS n_rows, sum(units_sold) AS units, max(units_sold) AS most, sum(tax_rate) AS tax_total,
                 sum(CAST(price AS DECIMAL(18,2))) AS price_total
          FROM lines GROUP BY product_id, date) JOIN products USING (product_id)"""


def daily_sales(spark, folder):
    """One row per product and day, with the day's mean prices and its highest stock.

    The lines are summed per product and day before the catalogue is joined.
    """
    days = features.daily_cells(retail.lines(spark, folder), sums={"tax_total": F.col("tax_rate")}, tops={"most": F.col("units_sold")})
    return days.join(retail.products(spark, folder), "product_id").select(
        "product_id", "category", "date", F.col("units").alias("units_sold"), features.mean_price().alias("price"),
        (F.col("list_price") * (F.lit(1.0) + F.col("tax_total") / F.col("n_rows"))).alias("competitor_price"),
        (F.col("stock") + F.col("most")).alias("inventory"),
    )


ROUNDED = ["price_ratio_to_base", "price_vs_competitor", "price_over_cat", "units_roll7", "year_sin", "year_cos"]


@query(sql(f"""
SELECT product_id, category, date, units_sold, units_lag1, units_lag7, dow, is_weekend, doy, month,
       {", ".join(f"{half_up(c, 6)} AS {c}" for c in ROUNDED)}
FROM (SELECT *, price / avg(price) OVER (PARTITION BY product_id) AS price_ratio_to_base,
             price - competitor_price AS price_vs_competitor, price - avg(price) OVER (PARTITION BY category) AS price_over_cat_all,
             lag(units_sold, 1) OVER w AS units_lag1, lag(units_sold, 7) OVER w AS units_lag7,
             avg(units_sold) OVER (PARTITION BY product_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS units_roll7,
             CAST(isodow(date) - 1 AS INTEGER) AS dow, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend,
             CAST(dayofyear(date) AS INTEGER) AS doy, CAST(month(date) AS INTEGER) AS month,
             sin(2 * pi() * dayofyear(date) / 365.25) AS year_sin, cos(2 * pi() * dayofyear(date) / 365.25) AS year_cos,
             price - (SELECT avg(d.price) FROM daily d WHERE d.category = daily.category) AS price_over_cat
      FROM daily WINDOW w AS (PARTITION BY product_id ORDER BY date))
WHERE units_lag7 IS NOT NULL
""", "lines", "products", daily=DAILY))
def demand_features(spark, folder):
    featured = features.demand_features(daily_sales(spark, folder))
    return featured.select(
        "product_id", "category", "date", "units_sold", "units_lag1", "units_lag7", "dow", "is_weekend", "doy", "month",
        *[round_to(F.col(c), 6).alias(c) for c in ROUNDED],
    )


POSITION = ["product_mean_price", "cat_mean_price", "price_ratio_to_base", "price_over_cat"]


@query(sql(f"""
SELECT order_id, line_no, supplier_id, product_id, category, price, {", ".join(f"{half_up(c, 6)} AS {c}" for c in POSITION)}
FROM (SELECT *, price / product_mean_price AS price_ratio_to_base, price - cat_mean_price AS price_over_cat
      FROM (SELECT *, CAST(sum(CAST(price AS DECIMAL(18,2))) OVER (PARTITION BY product_id) AS DOUBLE) / count(*) OVER (PARTITION BY product_id) AS product_mean_price,
                   CAST(sum(CAST(price AS DECIMAL(18,2))) OVER (PARTITION BY category) AS DOUBLE) / count(*) OVER (PARTITION BY category) AS cat_mean_price
            FROM sales))
""", "sales"))
def price_position(spark, folder):
    rows = retail.sales(spark, folder).select("order_id", "line_no", "supplier_id", "product_id", "category", "price")
    return features.price_position(rows).withColumns({c: round_to(F.col(c), 6) for c in POSITION})


@query(sql(f"""
SELECT date, CAST(isodow(date) - 1 AS INTEGER) AS dow, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend,
       CAST(dayofyear(date) AS INTEGER) AS doy, CAST(month(date) AS INTEGER) AS month,
       {half_up("sin(2 * pi() * dayofyear(date) / 365.25)", 6)} AS year_sin, {half_up("cos(2 * pi() * dayofyear(date) / 365.25)", 6)} AS year_cos
FROM (SELECT DISTINCT date FROM lines)
""", "lines"))
def calendar_features(spark, folder):
    dated = features.calendar_features(retail.lines(spark, folder).select("date").distinct())
    return dated.withColumns({c: round_to(F.col(c), 6) for c in ("year_sin", "year_cos")})


@query(sql("""
SELECT category, CAST(day AS DATE) AS date, coalesce(units, 0.0) AS units
FROM (SELECT category, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS day FROM cells GROUP BY category)
LEFT JOIN (SELECT category AS c, date AS d, sum(units) AS units FROM cells GROUP BY category, date) ON c = category AND d = day
""", "cells"))
def gap_filled_series(spark, folder):
    cells = analytics.catalogue_cells(retail.lines(spark, folder), retail.products(spark, folder))
    return features.gap_filled(cells, "category")


@query()
def gap_filled_products(spark, folder):
    """Every day of every product between its first and last sale."""
    return features.gap_filled(features.daily_cells(retail.lines(spark, folder)), "product_id")


EVERY_DAY = """
    SELECT product_id, CAST(day AS DATE) AS date, coalesce(units, 0.0) AS units
    FROM (SELECT product_id, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS day FROM cells GROUP BY product_id)
    LEFT JOIN (SELECT product_id AS p, date AS d, units FROM cells) ON p = product_id AND d = day"""


@query(sql(digest_sql("filled", ["CAST(product_id AS VARCHAR)", "CAST(date AS VARCHAR)", "CAST(CAST(floor(units * 1e6 + 0.5) AS BIGINT) AS VARCHAR)"], "product_id"),
           "cells", filled=EVERY_DAY))
def gap_filled_digests(spark, folder):
    """Checksums per product of all days of all products: the series themselves are millions of rows."""
    return table_digest(gap_filled_products(spark, folder), "product_id")


SERIES = f"""
    SELECT product_id, CAST(day AS DATE) AS day, coalesce(units, 0.0) AS units,
           row_number() OVER (PARTITION BY product_id ORDER BY day) AS i,
           row_number() OVER (PARTITION BY product_id ORDER BY day DESC) AS back, count(*) OVER (PARTITION BY product_id) AS days
    FROM (SELECT product_id, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS day FROM cells
          GROUP BY product_id HAVING sum(n_rows) >= {MIN_SERIES_ROWS})
    LEFT JOIN (SELECT product_id AS p, date AS d, units FROM cells) ON p = product_id AND d = day"""


@query(sql(f"""
SELECT product_id, CAST(days AS INTEGER) AS days,
       {half_up("CASE WHEN days < 7 THEN 0.0 ELSE least(greatest((recent - prior) / greatest(prior, 1e-6), -0.2), 0.2) END", 6)} AS recent_trend
FROM (SELECT product_id, days, avg(units) FILTER (back <= 7) AS recent,
             avg(units) FILTER (CASE WHEN days >= 14 THEN back BETWEEN 8 AND 14 ELSE i <= 7 END) AS prior
      FROM series GROUP BY product_id, days)
""", "cells", series=SERIES))
def damped_trend(spark, folder):
    trend = features.damped_trend(features.daily_cells(retail.lines(spark, folder)), min_rows=MIN_SERIES_ROWS)
    return trend.withColumn("recent_trend", round_to(F.col("recent_trend"), 6))


@query(sql("""
SELECT product_id, count(*) AS sale_days,
       CASE WHEN count(*) < 14 THEN 0.0 ELSE coalesce(sum(units) FILTER (back <= 7), 0.0) - coalesce(sum(units) FILTER (back BETWEEN 8 AND 14), 0.0) END AS unit_trend
FROM (SELECT product_id, units, row_number() OVER (PARTITION BY product_id ORDER BY date DESC) AS back FROM cells)
GROUP BY product_id
""", "cells"))
def unit_trend(spark, folder):
    return features.unit_trend(features.daily_cells(retail.lines(spark, folder)))


@query(sql(f"""
SELECT product_id, days, {half_up("phi", 6)} AS phi, {half_up("const", 6)} AS const,
       {half_up("n * (ln(2 * pi() * rss / n) + 1) + 6", 4)} AS aic, last_units
FROM (SELECT product_id, days, CAST(count(before) AS DOUBLE) AS n, regr_slope(units, before) AS phi, regr_intercept(units, before) AS const,
             regr_syy(units, before) - regr_slope(units, before) * regr_sxy(units, before) AS rss, max(CASE WHEN back = 1 THEN units END) AS last_units
      FROM (SELECT *, lag(units) OVER (PARTITION BY product_id ORDER BY day) AS before FROM series) GROUP BY product_id, days)
WHERE n > 3
""", "cells", series=SERIES))
def ar1_baseline(spark, folder):
    fitted = features.ar1_baseline(features.daily_cells(retail.lines(spark, folder)), min_rows=MIN_SERIES_ROWS)
    return fitted.withColumns({"phi": round_to(F.col("phi"), 6), "const": round_to(F.col("const"), 6), "aic": round_to(F.col("aic"), 4)})


def _levinson(order: int) -> dict[str, str]:
    """Steps from autocovariances c0, c1, ... to the coefficients f1, ... of an autoregression."""
    steps, before = {}, "covariances"
    for k in range(1, order + 1):
        explained = "".join(f" - f{j} * c{k - j}" for j in range(1, k))
        replaced = "".join(f", f{j} - r * f{k - j} AS f{j}" for j in range(1, k))
        dropped = ", ".join(["v", "r", *[f"f{j}" for j in range(1, k)]])
        steps[f"levinson{k}"] = f"""
            SELECT * EXCLUDE ({dropped}){replaced}, r AS f{k}, v * (1.0 - r * r) AS v
            FROM (SELECT *, (c{k}{explained}) / nullif(v, 0.0) AS r FROM {before})"""
        before = f"levinson{k}"
    return steps


_P = features.LONG_ORDER
SHOCKS = {
    "deviations": f"""
        SELECT product_id, i, days, units, units - m AS d, m, {", ".join(f"lag(units - m, {k}) OVER w AS d{k}" for k in range(1, _P + 1))}
        FROM (SELECT *, avg(units) OVER (PARTITION BY product_id) AS m FROM series) WINDOW w AS (PARTITION BY product_id ORDER BY i)""",
    "covariances": f"""
        SELECT product_id, sum(d * d) / count(*) AS v, {", ".join(f"sum(d * d{k}) / count(*) AS c{k}" for k in range(1, _P + 1))}
        FROM deviations WHERE days > {2 * _P + 5} GROUP BY product_id""",
    **_levinson(_P),
    "shocks": f"""
        SELECT product_id, i, days, units, d - {" - ".join(f"f{k} * d{k}" for k in range(1, _P + 1))} AS e
        FROM deviations JOIN levinson{_P} USING (product_id)""",
    "pairs": "SELECT *, lag(units) OVER w AS x, lag(e) OVER w AS e1 FROM shocks WINDOW w AS (PARTITION BY product_id ORDER BY i)",
    "moments": """
        SELECT product_id, days, CAST(count(e1) AS DOUBLE) AS n, avg(units) FILTER (e1 IS NOT NULL) AS my, avg(x) FILTER (e1 IS NOT NULL) AS mx, avg(e1) AS me,
               regr_syy(units, e1) AS cyy, regr_sxx(e1, x) AS cxx, regr_sxx(units, e1) AS cee, regr_sxy(units, e1) AS cye, regr_sxy(e1, x) AS cxe,
               sum((units - mu) * (x - mu)) FILTER (e1 IS NOT NULL) - count(e1) * avg(units - mu) FILTER (e1 IS NOT NULL) * avg(x - mu) FILTER (e1 IS NOT NULL) AS cxy,
               max(units) FILTER (i = days) AS last_units
        FROM (SELECT *, avg(units) OVER (PARTITION BY product_id) AS mu FROM pairs) GROUP BY product_id, days""",
    "solved": """
        SELECT *, (cxy * cee - cye * cxe) / nullif(cxx * cee - cxe * cxe, 0.0) AS phi, (cye * cxx - cxy * cxe) / nullif(cxx * cee - cxe * cxe, 0.0) AS theta
        FROM moments""",
}


@query(sql(f"""
SELECT product_id, days, {half_up("phi", 4)} AS phi, {half_up("theta", 4)} AS theta, {half_up("my - phi * mx - theta * me", 4)} AS const,
       {half_up("n * (ln(2 * pi() * (cyy - phi * cxy - theta * cye) / n) + 1) + 8", 3)} AS aic, last_units
FROM solved
""", "cells", series=SERIES, **SHOCKS))
def arma11_baseline(spark, folder):
    fitted = features.arma11_baseline(features.daily_cells(retail.lines(spark, folder)), min_rows=MIN_SERIES_ROWS)
    return fitted.withColumns({**{c: round_to(F.col(c), 4) for c in ("phi", "theta", "const")}, "aic": round_to(F.col("aic"), 3)})


RECENT = """
    SELECT product_id, inventory, row_number() OVER (PARTITION BY product_id ORDER BY date DESC, order_id DESC, line_no DESC,
           supplier_id DESC, units_sold DESC, price DESC) AS recency FROM sales"""
COVER = f"""
    SELECT product_id, {half_up("stock30", 0)} AS inventory, {half_up("pace", 1)} AS avg_daily, days_left,
           CASE WHEN days_left >= 0 AND days_left < 7 THEN 'low' WHEN days_left > 60 THEN 'over' ELSE 'ok' END AS stock_flag
    FROM (SELECT *, {half_up("stock7 / greatest(0.1, pace)", 0)} AS days_left
          FROM (SELECT product_id, quantile_cont(inventory, 0.5) FILTER (recency <= 30) AS stock30,
                       quantile_cont(inventory, 0.5) FILTER (recency <= 7) AS stock7 FROM recent GROUP BY product_id)
          JOIN (SELECT product_id, sum(units) / count(*) AS pace FROM cells GROUP BY product_id) USING (product_id))"""


def _cover(spark, folder):
    return analytics.stock_cover(retail.stock_rows(spark, folder), retail.LATEST_FIRST)


@query(sql("SELECT * FROM cover", "sales", "cells", recent=RECENT, cover=COVER))
def stock_cover(spark, folder):
    return _cover(spark, folder)


@query(sql("""
(SELECT * FROM cover WHERE stock_flag = 'low' ORDER BY days_left, product_id LIMIT 5)
UNION ALL (SELECT * FROM cover WHERE stock_flag = 'over' ORDER BY days_left, product_id LIMIT 5)
""", "sales", "cells", recent=RECENT, cover=COVER))
def stock_alerts(spark, folder):
    return analytics.stock_alerts(stage(_cover(spark, folder)))


@query(sql("SELECT * FROM cover ORDER BY days_left, product_id LIMIT 8", "sales", "cells", recent=RECENT, cover=COVER))
def stock_shortlist(spark, folder):
    return _cover(spark, folder).orderBy("days_left", "product_id").limit(8)


@query(sql("""
SELECT product_id, date, units_sold, price, recency
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY product_id ORDER BY date DESC, order_id DESC, line_no DESC, supplier_id DESC,
             units_sold DESC, price DESC) AS INTEGER) AS recency FROM lines) WHERE recency <= 30
""", "lines"))
def sales_history(spark, folder):
    return analytics.sales_history(retail.lines(spark, folder), retail.LATEST_FIRST)
