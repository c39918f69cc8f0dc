"""Demand curves and price recommendations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfprice.functions import round_to
from shelfprice.operators import analytics, elasticity as curves, recommend as price
from shelfprice.operators.batches import Batches
from shelfprice.operators.quantiles import column_quantiles
from shelfprice.operators.staging import stage
from shelfprice.plans.registry import query
from shelfprice.plans.views import half_up, sql
from shelfprice.session import scratch_dir
from shelfprice.sources import retail

# A stricter rule than the default, so that some test products need the pooled curve.
STRICT_ROWS = 30
CURVE = ["intercept", "elasticity", "r2"]


def recommended(spark, folder, objective="revenue"):
    return price.recommend(retail.pricing_rows(spark, folder), objective)


def _rounded(df, columns, digits=6):
    return df.withColumns({c: round_to(F.col(c), digits) for c in columns})


PORTFOLIO = """product_id, current_price, recommended_price, change_pct, expected_demand, expected_revenue, expected_profit,
       floor(elasticity * 1e6 + 0.5) / 1e6 AS elasticity, reliability"""


@query(sql(f"SELECT {PORTFOLIO} FROM recommended", "recommended"))
def portfolio(spark, folder):
    return _rounded(price.portfolio(recommended(spark, folder)), ["elasticity"])


def _written(value: str) -> str:
    return f"CAST(CAST({value} AS DECIMAL(18,2)) AS VARCHAR)"


@query(sql(f"""
SELECT product_id, '{{"product_id":' || product_id || ',"prices":{{"current":"' || {_written("current_price")} || '","recommended":"' || {_written("recommended_price")}
       || '"}},"expected":{{"revenue":"' || {_written("expected_revenue")} || '","profit":"' || {_written("expected_profit")} || '"}},"reliability":"' || reliability || '"}}' AS payload
FROM recommended
""", "recommended"))
def portfolio_json(spark, folder):
    """One JSON payload per recommendation, money as text with two digits."""
    def money(c):
        return F.col(c).cast("decimal(18,2)").cast("string")

    payload = F.struct(
        "product_id", F.struct(money("current_price").alias("current"), money("recommended_price").alias("recommended")).alias("prices"),
        F.struct(money("expected_revenue").alias("revenue"), money("expected_profit").alias("profit")).alias("expected"), "reliability")
    return price.portfolio(recommended(spark, folder)).select("product_id", F.to_json(payload).alias("payload"))


#: Products of this category come without a price of their own, as in a catalogue with gaps.
UNPRICED = "PROMO"
_GAPS = f"CASE WHEN category <> '{UNPRICED}' THEN price ELSE (SELECT quantile_cont(l.price, 0.5) FROM latest l JOIN products USING (product_id) WHERE category <> '{UNPRICED}') END"


@query(sql(f"SELECT {PORTFOLIO} FROM recommended", "recommended").replace("price AS current_price, cost, category", f"{_GAPS} AS current_price, cost, category"))
def portfolio_without_prices(spark, folder):
    """Recommendations where a category has no current prices: the exact median of the others stands in."""
    state = retail.pricing_rows(spark, folder).withColumn("current_price", F.when(F.col("category") != UNPRICED, F.col("current_price")))
    state = stage(state)
    median = column_quantiles(state, ["current_price"], [0.5]).select("value").scalar()
    return _rounded(price.portfolio(price.recommend(state, fallback_price=median)), ["elasticity"])


@query(sql(f"SELECT {PORTFOLIO} FROM recommended ORDER BY abs(change_pct) DESC, product_id LIMIT 10", "recommended"))
def portfolio_top(spark, folder):
    return _rounded(price.portfolio_top(recommended(spark, folder)), ["elasticity"])


@query(sql(f"""
SELECT product_id, n_obs, {", ".join(f"{half_up(c, 6)} AS {c}" for c in CURVE)}, ceiling,
       n_obs >= 8 AND sxx > 1e-12 AND elasticity < -0.01 AS usable
FROM curves
""", "curves"))
def elasticity(spark, folder):
    return _rounded(curves.fit_curves(retail.lines(spark, folder)), CURVE)


@query(sql(f"""
SELECT product_id, kind, n_obs, {", ".join(f"{half_up(c, 6)} AS {c}" for c in CURVE)}, ceiling
FROM (SELECT c.product_id, CASE WHEN own THEN 'product' ELSE 'category' END AS kind, CASE WHEN own THEN c.n_obs ELSE p.n_obs END AS n_obs,
             CASE WHEN own THEN c.intercept ELSE p.intercept END AS intercept, CASE WHEN own THEN c.elasticity ELSE p.elasticity END AS elasticity,
             CASE WHEN own THEN c.r2 ELSE p.r2 END AS r2, CASE WHEN own THEN c.ceiling ELSE p.ceiling END AS ceiling
      FROM (SELECT *, n_obs >= {STRICT_ROWS} AND sxx > 1e-12 AND elasticity < -0.01 AS own FROM curves) c, pooled p)
""", "curves", "pooled"))
def elasticity_pooled(spark, folder):
    moments = retail.lines(spark, folder).groupBy("product_id").agg(*curves.curve_aggregates())
    pooled = curves.finish_curve(curves.merged_moments(moments), STRICT_ROWS)
    fitted = curves.with_pooled_fallback(curves.finish_curve(moments, STRICT_ROWS), pooled)
    return _rounded(fitted, CURVE).drop("usable")


def _curve_moments(rows, *by):
    return rows.groupBy(*by, "product_id").agg(*curves.curve_aggregates())


@query(sql(f"""
SELECT product_id, n_obs, {", ".join(f"{half_up(c, 6)} AS {c}" for c in CURVE)}, ceiling,
       n_obs >= 8 AND sxx > 1e-12 AND elasticity < -0.01 AS usable
FROM curves
""", "curves"))
def refreshed_curves(spark, folder):
    """Curves from the statistics of batches: a year each, a new one added, a faulty one put twice and removed."""
    lines = retail.lines(spark, folder).withColumn("year", F.year("date"))
    kept = Batches(spark, f"{scratch_dir(spark)}/curves-{uuid.uuid4().hex}")
    kept.put_each(_curve_moments(lines.where("year < 2000"), "year"), "year")
    for _ in range(2):
        kept.put("faulty", _curve_moments(lines.where("year = 1997").withColumn("price", F.col("price") * 2)))
    kept.put("2000 and later", _curve_moments(lines.where("year >= 2000")))
    kept.remove("faulty")
    return _rounded(curves.finish_curve(curves.merged_moments(kept.read(), "product_id")), CURVE)


@query(sql("SELECT product_id, step, price, demand, revenue, profit FROM swept", "swept"))
def candidate_sweep(spark, folder):
    return price.candidate_table(price.sweep(retail.pricing_rows(spark, folder)))


CHOICE = """SELECT product_id, current_price, recommended_price, expected_demand, expected_revenue, expected_profit, change_pct,
       floor(current_demand * 1e4 + 0.5) / 1e4 AS current_demand FROM recommended"""


def _choice(df):
    return df.where("supported").select(
        "product_id", "current_price", "recommended_price", "expected_demand", "expected_revenue", "expected_profit", "change_pct",
        round_to(F.col("current_demand"), 4).alias("current_demand"),
    )


@query(sql(CHOICE, "recommended"))
def price_recommendation(spark, folder):
    return _choice(recommended(spark, folder))


@query(sql(CHOICE, "recommended", objective="profit"))
def price_recommendation_profit(spark, folder):
    return _choice(recommended(spark, folder, "profit"))


@query(sql("SELECT product_id, n_obs, CAST(points AS INTEGER) AS reliability_score, reliability FROM recommended", "recommended"))
def reliability(spark, folder):
    return recommended(spark, folder).where("supported").select("product_id", "n_obs", "reliability_score", "reliability")


REASON_CODES = """
SELECT product_id, concat_ws(',',
    CASE WHEN recommended_price > current_price THEN 'raise' WHEN recommended_price < current_price THEN 'lower' ELSE 'keep' END,
    CASE WHEN ratio > 1.05 THEN 'demand_up' WHEN ratio < 0.95 THEN 'demand_down' END,
    CASE WHEN gap > 3 THEN 'above_competitor' WHEN gap < -3 THEN 'below_competitor' ELSE 'near_competitor' END,
    CASE WHEN inventory < expected_demand * 7 THEN 'stock_short' ELSE 'stock_enough' END,
    'objective_revenue', 'model', 'rule:price-floor-at-cost', 'rule:max-single-step-increase') AS codes,
    concat_ws(',',
    CASE WHEN recommended_price > current_price THEN 'up' WHEN recommended_price < current_price THEN 'down' ELSE 'flat' END,
    CASE WHEN ratio > 1.05 THEN 'up' WHEN ratio < 0.95 THEN 'down' END,
    CASE WHEN gap > 3 THEN 'up' WHEN gap < -3 THEN 'down' ELSE 'flat' END, 'flat', 'flat', 'flat', 'flat', 'flat') AS tones
FROM (SELECT *, expected_demand / greatest(current_demand, 1e-9) AS ratio, (recommended_price - competitor_price) / competitor_price * 100.0 AS gap
      FROM recommended)
"""


@query(sql("""
SELECT product_id, points AS score, reliability, concat_ws(',',
    CASE WHEN n_obs >= 150 THEN 'solid_history' WHEN n_obs >= 30 THEN 'moderate_history' ELSE 'thin_history' END,
    CASE WHEN r2 >= 0.3 THEN 'good_fit' WHEN r2 >= 0.1 THEN 'acceptable_fit' ELSE 'weak_fit' END,
    CASE WHEN elasticity BETWEEN -3.0 AND -0.3 THEN 'plausible_elasticity' ELSE 'extreme_elasticity' END,
    CASE WHEN cost > 0 AND current_price > cost THEN 'known_margin' END) AS codes
FROM recommended
""", "recommended"))
def reliability_reasons(spark, folder):
    rated = recommended(spark, folder).where("supported")
    return rated.select("product_id", F.col("reliability_score").alias("score"), "reliability",
                        F.array_join(price.reliability_codes(), ",").alias("codes"))


def _joined(field):
    return F.array_join(F.transform("reasons", lambda r: r[field]), ",")


@query(sql(REASON_CODES, "recommended"))
def recommendation_reasons(spark, folder):
    explained = price.recommendation_reasons(recommended(spark, folder))
    return explained.select("product_id", _joined("code").alias("codes"), _joined("tone").alias("tones"))


@query(sql("""
SELECT product_id, concat_ws(',',
    CASE WHEN inventory <= 20 THEN 'low_stock' WHEN inventory >= 200 THEN 'high_stock' ELSE 'balanced_stock' END,
    CASE WHEN gap > 0.05 THEN 'competitor_above' WHEN gap < -0.05 THEN 'competitor_below' ELSE 'competitor_level' END,
    CASE WHEN month IN (10, 11, 12) THEN 'peak_season' WHEN month IN (6, 7, 8) THEN 'off_season' END,
    CASE WHEN margin > 0.55 THEN 'healthy_margin' WHEN margin < 0.2 THEN 'tight_margin' END) AS codes
FROM (SELECT *, (competitor_price - recommended_price) / recommended_price AS gap, (recommended_price - cost) / recommended_price AS margin
      FROM recommended)
""", "recommended"))
def context_reasons(spark, folder):
    return price.context_reasons(recommended(spark, folder)).select("product_id", _joined("code").alias("codes"))


@query(sql(f"""
SELECT product_id, price AS current_price, CASE WHEN own OR NOT pool THEN n_obs ELSE pool_n END AS n_obs,
       CASE WHEN NOT own AND NOT pool THEN 'no_demand_curve' ELSE 'cost_floor_above_step_cap' END AS outcome
FROM (SELECT *, coalesce(n_obs >= {STRICT_ROWS} AND sxx > 1e-12 AND elasticity < -0.01, FALSE) AS own FROM curves)
     JOIN latest USING (product_id) JOIN products USING (product_id),
     (SELECT n_obs AS pool_n, coalesce(n_obs >= {STRICT_ROWS} AND sxx > 1e-12 AND elasticity < -0.01, FALSE) AS pool FROM pooled)
WHERE (NOT own AND NOT pool) OR cost > price * 1.2
""", "curves", "latest", "products", "pooled"))
def unsupported_groups(spark, folder):
    state = retail.pricing_rows(spark, folder, min_rows=STRICT_ROWS)
    return price.unsupported(price.recommend(state))


@query(sql(f"""
SELECT product_id, current_price, recommended_price, current_revenue, new_revenue, current_profit, new_profit,
       {half_up("(new_revenue - current_revenue) / nullif(abs(current_revenue), 0) * 100.0", 1)} AS revenue_uplift_pct,
       {half_up("(new_profit - current_profit) / nullif(abs(current_profit), 0) * 100.0", 1)} AS profit_uplift_pct
FROM (SELECT product_id, current_price, recommended_price, {half_up("t.revenue / (months * 30.0::DOUBLE)", 0)} AS current_revenue,
             {half_up("expected_revenue", 0)} AS new_revenue, {half_up("t.profit / (months * 30.0::DOUBLE)", 0)} AS current_profit,
             {half_up("(recommended_price - r.cost) * expected_demand", 0)} AS new_profit
      FROM recommended r JOIN totals t USING (product_id), (SELECT count(DISTINCT month(date)) AS months FROM cells))
""", "recommended", "totals"))
def price_comparison(spark, folder):
    lines, catalogue = retail.lines(spark, folder), retail.products(spark, folder)
    months = lines.agg(F.count_distinct(F.month("date")).alias("months")).scalar()
    totals = analytics.product_totals(analytics.catalogue_cells(lines, catalogue))
    return price.price_comparison(recommended(spark, folder), totals, months)


@query(sql("""
SELECT product_id, t.category, current_price, cost, recommended_price, expected_revenue, change_pct AS price_change_pct,
       t.revenue AS current_revenue, t.profit AS current_profit
FROM recommended r JOIN totals t USING (product_id)
""", "recommended", "totals"))
def prediction_export(spark, folder):
    cells = analytics.catalogue_cells(retail.lines(spark, folder), retail.products(spark, folder))
    return price.prediction_export(recommended(spark, folder), analytics.product_totals(cells))


@query(sql(f"""
SELECT product_id, current_price, cost, {half_up("p", 2)} AS recommended_price, d AS predicted_demand, {half_up("profit", 2)} AS expected_profit
FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY profit DESC, i) AS place
      FROM (SELECT *, (p - cost) * d AS profit
            FROM (SELECT *, greatest(1.0::DOUBLE, floor(60 * pow(p / current_price, -1) + 0.5)) AS d
                  FROM (SELECT product_id, current_price, cost, i, current_price * 0.85 + i * ((current_price * 1.15 - current_price * 0.85) / 10) AS p
                        FROM state, (SELECT range AS i FROM range(11))))))
WHERE place = 1
""", "state"))
def fixed_elasticity_price(spark, folder):
    return price.fixed_elasticity_price(retail.pricing_rows(spark, folder))


@query(sql(f"""
SELECT product_id, discount_pct, {half_up("p", 2)} AS price, d AS demand, {half_up("p * d", 2)} AS revenue, {half_up("(p - cost) * d", 2)} AS profit,
       CAST(least(97, 55 + CASE WHEN current_price BETWEEN competitor_price * 0.7 AND competitor_price * 1.3 THEN 20 ELSE 0 END
            + CASE WHEN current_price <= cost * 2.5 THEN 15 ELSE 0 END + CASE WHEN inventory BETWEEN 10 AND 200 THEN 10 ELSE 0 END) AS INTEGER) AS confidence_pct
FROM (SELECT *, {half_up("least(least(greatest(exp(intercept) * pow(p, elasticity), 0.0), ceiling), inventory)", 1)} AS d
      FROM (SELECT *, current_price * (1.0 - discount_pct / 100.0) AS p
            FROM state, (SELECT unnest([0.0::DOUBLE, 5, 10, 15, 20]) AS discount_pct) WHERE usable))
""", "state"))
def discount_grid(spark, folder):
    return price.discount_grid(retail.pricing_rows(spark, folder))


@query("\nUNION ALL\n".join(
    f"SELECT p_partkey AS product_id, {half_up(f'p_retailprice * {rate}::DOUBLE', 2)} AS list_price, "
    f"{half_up(half_up('p_retailprice * 0.5', 2) + f' * {rate}::DOUBLE', 2)} AS cost, '{code}' AS currency FROM part"
    for code, rate in price.EXCHANGE_RATES.items()
))
def currency_convert(spark, folder):
    catalogue = retail.products(spark, folder).select("product_id", "list_price", "cost")
    shown = [price.convert_currency(catalogue, ["list_price", "cost"], code) for code in price.EXCHANGE_RATES]
    result = shown[0]
    for other in shown[1:]:
        result = result.unionByName(other)
    return result
