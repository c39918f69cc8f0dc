"""The retail views in SQL, for the check queries."""

from __future__ import annotations

from shelfprice.functions.calendar import SEASONAL_FACTORS


def half_up(expression: str, digits: int) -> str:
    return f"(floor(({expression}) * 1e{digits} + 0.5) / 1e{digits})"


def money(expression: str) -> str:
    return f"CAST(sum(CAST({expression} AS DECIMAL(18,2))) AS DOUBLE)"


SEASON = "([" + ", ".join(str(v) for v in SEASONAL_FACTORS) + "][month])::DOUBLE"
HOLIDAY = (
    "CAST(month(date) = 11 OR (month(date) = 12 AND day(date) >= 20) OR (month(date) = 1 AND day(date) <= 5) "
    "OR (month(date) = 4 AND day(date) BETWEEN 10 AND 15) AS INTEGER)"
)
WEEKEND = "CAST(isodow(date) >= 6 AS INTEGER)"

CURVE = ("n_obs", "intercept", "elasticity", "r2", "ceiling")

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": ((), f"""
        SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id, l_suppkey AS supplier_id,
               CAST(l_shipdate AS DATE) AS date, {half_up('l_extendedprice / l_quantity', 2)} AS price,
               l_quantity AS units_sold, l_discount AS discount, l_tax AS tax_rate,
               l_returnflag AS return_flag, l_linestatus AS line_status
        FROM lineitem"""),
    "products": ((), f"""
        SELECT p_partkey AS product_id, p_type AS category, p_brand AS brand, p_retailprice AS list_price,
               {half_up('p_retailprice * 0.5', 2)} AS cost, p_size AS stock
        FROM part"""),
    "sales": (("lines", "products"), f"""
        SELECT *, {SEASON} AS seasonal_factor FROM (
            SELECT order_id, line_no, product_id, supplier_id, date, price, units_sold, discount, tax_rate, return_flag,
                   line_status, category, brand, cost, {half_up('list_price * (1.0 + tax_rate)', 2)} AS competitor_price,
                   stock + units_sold AS inventory, {WEEKEND} AS is_weekend,
                   CAST(month(date) AS INTEGER) AS month, {HOLIDAY} AS holiday
            FROM lines JOIN products USING (product_id))"""),
    "cells": (("lines", "products"), """
        SELECT product_id, category, cost, date, n_rows, units, revenue, price_total,
               revenue - CAST(cost * units AS DECIMAL(18,2)) AS profit
        FROM (SELECT product_id, date, count(*) AS n_rows, sum(units_sold) AS units,
                     sum(CAST(price * units_sold AS DECIMAL(18,2))) AS revenue,
                     sum(CAST(price AS DECIMAL(18,2))) AS price_total
              FROM lines GROUP BY product_id, date) JOIN products USING (product_id)"""),
    "totals": (("cells",), f"""
        SELECT product_id, category, sum(units) AS units, {half_up('CAST(sum(revenue) AS DOUBLE)', 0)} AS revenue,
               {half_up('CAST(sum(profit) AS DOUBLE)', 0)} AS profit, count(*) AS days
        FROM cells GROUP BY product_id, category"""),
    "customers": ((), f"""
        SELECT c_custkey AS customer_id, r_name AS region, c_mktsegment AS segment_hint,
               coalesce(purchase_count, 0) AS purchase_count, coalesce(spend / purchase_count, 0.0) AS avg_sales,
               {half_up("coalesce(purchase_count, 0) * 100.0::DOUBLE / (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey))", 1)} AS loyalty_score
        FROM customer
        LEFT JOIN (SELECT o_custkey, count(*) AS purchase_count, {money('o_totalprice')} AS spend FROM orders GROUP BY o_custkey)
               ON c_custkey = o_custkey
        LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey"""),
    "till": ((), f"""
        SELECT l_partkey, l_suppkey, l_orderkey, l_returnflag AS gender, CAST(l_shipdate AS DATE) AS date,
               l_quantity AS quantity, {half_up('l_extendedprice / l_quantity', 2)} AS price,
               {half_up('l_extendedprice * (1.0 + l_tax)', 2)} AS sales, {half_up('l_extendedprice * l_tax', 2)} AS tax_5pct,
               {half_up('l_extendedprice * 0.6', 2)} AS cogs,
               {half_up('l_extendedprice * (1.0 + l_tax) - l_extendedprice * 0.6', 2)} AS gross_income
        FROM lineitem"""),
    "messy": (("sales",), """
        SELECT product_id, date, category,
               CASE WHEN tax_rate = 0 AND line_status = 'F' THEN -price ELSE price END AS price,
               CASE WHEN return_flag <> 'R' THEN cost END AS cost,
               CASE WHEN return_flag <> 'A' OR line_status <> 'O' THEN competitor_price END AS competitor_price,
               CASE WHEN discount <> 0 THEN inventory END AS inventory, units_sold
        FROM sales"""),
    "curves": (("lines",), """
        SELECT product_id, count(*) AS n_obs, regr_slope(ln(units_sold), ln(price)) AS elasticity,
               regr_intercept(ln(units_sold), ln(price)) AS intercept,
               CASE WHEN regr_syy(ln(units_sold), ln(price)) > 1e-12 THEN regr_r2(ln(units_sold), ln(price)) ELSE 0.0 END AS r2,
               regr_sxx(ln(units_sold), ln(price)) AS sxx, max(units_sold) * 1.5 AS ceiling
        FROM lines WHERE price > 0 AND units_sold > 0 GROUP BY product_id"""),
    "pooled": (("lines",), """
        SELECT count(*) AS n_obs, regr_slope(ln(units_sold), ln(price)) AS elasticity,
               regr_intercept(ln(units_sold), ln(price)) AS intercept, regr_r2(ln(units_sold), ln(price)) AS r2,
               regr_sxx(ln(units_sold), ln(price)) AS sxx, max(units_sold) * 1.5 AS ceiling
        FROM lines WHERE price > 0 AND units_sold > 0"""),
    "latest": (("lines",), """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY date DESC, order_id DESC, line_no DESC,
                              supplier_id DESC, units_sold DESC, price DESC) AS recency FROM lines) WHERE recency = 1"""),
    "fitted": (("curves", "pooled"), f"""
        SELECT product_id, {", ".join(f"CASE WHEN own OR NOT pool THEN c.{c} ELSE p.{c} END AS {c}" for c in CURVE)}, own OR pool AS usable
        FROM (SELECT *, coalesce(n_obs >= 8 AND sxx > 1e-12 AND elasticity < -0.01, FALSE) AS own FROM curves) c,
             (SELECT *, coalesce(n_obs >= 8 AND sxx > 1e-12 AND elasticity < -0.01, FALSE) AS pool FROM pooled) p"""),
    "state": (("fitted", "latest", "products"), f"""
        SELECT product_id, n_obs, intercept, elasticity, r2, ceiling, usable,
               price AS current_price, cost, category, stock + units_sold AS inventory,
               {half_up('list_price * (1.0 + tax_rate)', 2)} AS competitor_price, CAST(month(date) AS INTEGER) AS month
        FROM fitted JOIN latest USING (product_id) JOIN products USING (product_id)"""),
}


def sweep_views(objective: str = "revenue") -> dict[str, tuple[tuple[str, ...], str]]:
    score = "(price - cost) * demand" if objective == "profit" else "revenue"
    return {
        "bounds": (("state",), """
            SELECT *, CASE WHEN NOT usable THEN 'no_demand_curve' WHEN cost > current_price * 1.2 THEN 'cost_floor_above_step_cap'
                           ELSE 'ok' END AS outcome,
                   CASE WHEN greatest(current_price * 0.6, cost) < current_price * 1.45 THEN greatest(current_price * 0.6, cost)
                        ELSE greatest(current_price * 0.9, cost) END AS low, current_price * 1.2 AS high
            FROM state"""),
        "swept": (("bounds",), f"""
            SELECT product_id, current_price, cost, step, {half_up('p', 2)} AS price, {half_up('d', 2)} AS demand,
                   {half_up('p * d', 2)} AS revenue, {half_up('(p - cost) * d', 2)} AS profit
            FROM (SELECT *, least(least(greatest(exp(intercept) * pow(p, elasticity), 0.0), ceiling), inventory) AS d
                  FROM (SELECT *, low + step * ((high - low) / 13) AS p
                        FROM bounds CROSS JOIN (SELECT CAST(range AS INTEGER) AS step FROM range(14)) WHERE outcome = 'ok'))"""),
        "recommended": (("swept", "bounds"), f"""
            SELECT b.*, w.price AS recommended_price, w.demand AS expected_demand, w.revenue AS expected_revenue,
                   w.profit AS expected_profit, {half_up('(w.price - b.current_price) / b.current_price * 100.0', 1)} AS change_pct,
                   least(greatest(exp(intercept) * pow(b.current_price, elasticity), 0.0), ceiling) AS current_demand,
                   points, CASE WHEN points >= 7 THEN 'High' WHEN points >= 4 THEN 'Medium' ELSE 'Low' END AS reliability
            FROM (SELECT *, least(9, CASE WHEN n_obs >= 150 THEN 3 WHEN n_obs >= 30 THEN 2 ELSE 1 END
                                   + CASE WHEN r2 >= 0.3 THEN 3 WHEN r2 >= 0.1 THEN 2 ELSE 1 END
                                   + CASE WHEN elasticity BETWEEN -3.0 AND -0.3 THEN 2 ELSE 1 END
                                   + CASE WHEN cost > 0 AND current_price > cost THEN 1 ELSE 0 END) AS points FROM bounds) b
            JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {score} DESC, step) AS place FROM swept)
                  WHERE place = 1) w USING (product_id)"""),
        "offers": (("bounds", "recommended"), """
            SELECT b.product_id, coalesce(r.recommended_price, b.current_price) AS recommended_price, b.competitor_price, b.cost,
                   b.inventory, b.current_price, b.elasticity, b.outcome AS priced_by
            FROM bounds b LEFT JOIN recommended r ON r.product_id = b.product_id"""),
    }


def digest_sql(table: str, texts: list[str], *by: str) -> str:
    """The checksums of ``operators.digest`` over a table whose columns are written by the expressions ``texts``."""
    row = "md5(concat_ws('|', " + ", ".join(f"coalesce({t}, 'null')" for t in texts) + "))"
    keys = "".join(f"{c}, " for c in by)
    return f"""
SELECT {keys}count(*) AS n_rows, {", ".join(f"CAST(sum(CAST('0x' || substr(hash, {start}, 8) AS BIGINT)) AS BIGINT) AS {name}" for start, name in ((1, "hash_high"), (9, "hash_low")))}
FROM (SELECT *, {row} AS hash FROM {table}) {"GROUP BY " + ", ".join(by) if by else ""}"""


def sql(body: str, *names: str, objective: str = "revenue", recursive: bool = False, **steps: str) -> str:
    """``body`` behind the WITH clause of the named views and of those they use.

    ``steps`` are further named subqueries, in order, that may read the views; with
    ``recursive`` also themselves.
    """
    known = {**VIEWS, **sweep_views(objective)}
    ordered: list[str] = []

    def need(name: str) -> None:
        if name not in ordered:
            for other in known[name][0]:
                need(other)
            ordered.append(name)

    for name in names:
        need(name)
    clauses = [f"{name} AS ({known[name][1]})" for name in ordered] + [f"{name} AS ({text})" for name, text in steps.items()]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(clauses) + f"\n{body}" if clauses else body
