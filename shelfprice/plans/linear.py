"""The ridge model of sold units: fit, cross-validation, hold-out, and what it says about prices.

The check SQL adds up the same hundredths and solves the normal equations by elimination, one
step per input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfprice.functions import round_to
from shelfprice.models import holdout, linear, pricing
from shelfprice.models.demand import LABEL, RIDGE_FEATURES, RIDGE_PENALTY
from shelfprice.operators.batches import Batches
from shelfprice.operators.numbering import strided
from shelfprice.operators.staging import stage
from shelfprice.plans.registry import query
from shelfprice.plans.views import SEASON, half_up, sql
from shelfprice.session import scratch_dir
from shelfprice.sources import retail

LINE_KEYS = ["order_id", "line_no", "supplier_id", "product_id"]
PENALTIES = (0.001, 1.0, 1000.0, 100000.0)
STRIDED_ROWS = 40

_HASH = "md5(concat_ws('-', order_id, line_no, supplier_id, product_id))"
_K = len(RIDGE_FEATURES)
_SIZE = _K + 2
_INPUTS = f"range(1, {_K + 1})"
_ALL = f"range(1, {_K + 2})"


def _solved(name: str, source: str) -> dict[str, str]:
    """Steps that add intercept and weights to the rows of ``source`` (penalty, p: products of all inputs in row order)."""
    label = _K + 1
    steps = {
        f"{name}_c": f"""
            SELECT *, [[CAST(p[1] * p[a * {_SIZE} + b + 1] - p[a + 1] * p[b + 1] AS DOUBLE) for b in {_ALL}] for a in {_ALL}] AS c FROM {source}""",
        f"{name}_0": f"""
            SELECT *, [[CASE WHEN b = {label} THEN c[a][b] / sqrt(c[a][a])
                             ELSE CAST(p[1] AS DOUBLE) * c[a][b] / sqrt(c[a][a] * c[b][b]) + CASE WHEN a = b THEN penalty ELSE 0.0 END END
                        for b in {_ALL}] for a in {_INPUTS}] AS m FROM {name}_c""",
    }
    for k in range(1, _K + 1):
        steps[f"{name}_{k}"] = f"""
            SELECT * EXCLUDE (m), [[CASE WHEN a = {k} THEN m[{k}][b] / m[{k}][{k}] ELSE m[a][b] - m[a][{k}] * m[{k}][b] / m[{k}][{k}] END
                                    for b in {_ALL}] for a in {_INPUTS}] AS m FROM {name}_{k - 1}"""
    steps[f"{name}_w"] = f"SELECT * EXCLUDE (m), [m[a][{label}] * p[1] / sqrt(c[a][a]) for a in {_INPUTS}] AS w FROM {name}_{_K}"
    steps[name] = f"SELECT *, (p[{_SIZE}] - list_sum([w[a] * p[a + 1] for a in {_INPUTS}])) / p[1] / 100.0 AS intercept FROM {name}_w"
    return steps


CROSSED = {
    "marked": f"""
        SELECT *, competitor_price - price AS price_gap, substr(hash, 1, 2) < '33' AS is_test,
               {" + ".join(f"CAST(substr(hash, 3, 2) >= '{start}' AS INTEGER)" for start in ("33", "66", "99", "cc"))} AS fold
        FROM (SELECT *, {_HASH} AS hash FROM sales)""",
    "hundredths": f"""
        SELECT fold, [1, {", ".join(f"CAST(floor({c} * 100.0 + 0.5) AS BIGINT)" for c in [*RIDGE_FEATURES, LABEL])}] AS v FROM marked WHERE NOT is_test""",
    "crossed": f"""
        SELECT fold, i, j, sum(v[i] * v[j]) AS total FROM hundredths, range(1, {_SIZE + 1}) AS a(i), range(1, {_SIZE + 1}) AS b(j) GROUP BY ALL""",
    "fitted_on": f"""
        SELECT CAST({RIDGE_PENALTY} AS DOUBLE) AS penalty, list(total ORDER BY i, j) AS p FROM (SELECT i, j, sum(total) AS total FROM crossed GROUP BY i, j)""",
}
RIDGE = {**CROSSED, **_solved("ridge", "fitted_on")}
PREDICTED = "greatest(0.0, (SELECT intercept FROM ridge) + " + " + ".join(
    f"(SELECT w[{k}] FROM ridge) * {{{c}}}" for k, c in enumerate(RIDGE_FEATURES, 1)) + ")"
SCORED = {**RIDGE, "scored": f"SELECT *, {PREDICTED.format(**{c: c for c in RIDGE_FEATURES})} AS predicted FROM marked WHERE is_test"}


class Ridge:
    """Lines with hold-out mark and fold, staged once, and the model fitted to the training rows."""

    def __init__(self, spark, folder):
        sales = retail.sales(spark, folder).withColumn("price_gap", F.col("competitor_price") - F.col("price"))
        self.rows = stage(sales.select(*LINE_KEYS, "category", "date", *RIDGE_FEATURES, LABEL).withColumns(
            {"is_test": holdout.is_test(*LINE_KEYS), "fold": holdout.even_fold(*LINE_KEYS)}))
        table = linear.moment_table(self.rows.where(~F.col("is_test")), RIDGE_FEATURES, LABEL, "fold")
        self.folds = linear.collected(table, RIDGE_FEATURES, "fold")
        parts = list(self.folds.values())
        self.line = sum(parts[1:], parts[0]).ridge(RIDGE_PENALTY)

    def scored(self):
        return self.rows.where("is_test").withColumn("predicted", self.line.column())


@query(sql(f"""
SELECT feature, {half_up("coefficient", 4)} AS coefficient, {half_up("r2", 6)} AS r2, {half_up("mae", 6)} AS mae, {half_up("rmse", 6)} AS rmse
FROM (SELECT unnest({RIDGE_FEATURES}) AS feature, unnest(w) AS coefficient FROM ridge),
     (SELECT 1 - avg(e * e) / var_pop(units_sold) AS r2, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse FROM (SELECT *, units_sold - predicted AS e FROM scored))
""", "sales", **SCORED))
def ridge_model(spark, folder):
    """Change of sold units per unit of each input, and the metrics on the hold-out."""
    ridge = Ridge(spark, folder)
    metrics = holdout.regression_metrics(ridge.scored(), LABEL, "predicted").drop("n_rows")
    weights = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(w).alias("coefficient"))
                        for f, w in zip(RIDGE_FEATURES, ridge.line.coefficients, strict=True)])
    rounded = metrics.select(F.inline(weights), *[round_to(F.col(c), 6).alias(c) for c in ("r2", "mae", "rmse")])
    return rounded.withColumn("coefficient", round_to(F.col("coefficient"), 4))


@query(sql(f"""
SELECT feature, {half_up("coefficient", 4)} AS coefficient, n_rows
FROM (SELECT unnest({RIDGE_FEATURES}) AS feature, unnest(w) AS coefficient, CAST(p[1] AS BIGINT) AS n_rows FROM ridge)
""", "sales", **RIDGE))
def refreshed_ridge(spark, folder):
    """The ridge model from stored moments: three folds first, then the other two as a batch of new rows, one batch removed."""
    ridge = Ridge(spark, folder)
    kept = Batches(spark, f"{scratch_dir(spark)}/moments-{uuid.uuid4().hex}")

    def moments(rows):
        return linear.moment_table(rows.where(~F.col("is_test")), RIDGE_FEATURES, LABEL)

    kept.put("first", moments(ridge.rows.where("fold < 3")))
    kept.put("twice", moments(ridge.rows.where("fold = 1")))
    kept.put("new", moments(ridge.rows.where("fold >= 3")))
    kept.remove("twice")
    merged = linear.collected(kept.read(), RIDGE_FEATURES)[None]
    line = merged.ridge(RIDGE_PENALTY)
    rows = spark.createDataFrame([(f, w, merged.n) for f, w in zip(RIDGE_FEATURES, line.coefficients, strict=True)], "feature string, coefficient double, n_rows long")
    return rows.withColumn("coefficient", round_to(F.col("coefficient"), 4))


_LIST = "[" + ", ".join(str(p) for p in PENALTIES) + "]::DOUBLE[]"
FOLDS = {
    **CROSSED,
    "left_out": f"""
        SELECT fold, penalty, p, q FROM (SELECT fold, list(everything - total ORDER BY i, j) AS p, list(total ORDER BY i, j) AS q
            FROM (SELECT *, sum(total) OVER (PARTITION BY i, j) AS everything FROM crossed) GROUP BY fold), (SELECT unnest({_LIST}) AS penalty)""",
    **_solved("lines_without", "left_out"),
    "folds_scored": f"""
        SELECT penalty, fold, 1.0 - (list_sum([list_sum([u[a] * u[b] * d[a][b] for b in {_ALL}]) for a in {_ALL}]) + pow(bias, 2)) / d[{_K + 1}][{_K + 1}] AS r2
        FROM (SELECT penalty, fold, list_append([-w[a] for a in {_INPUTS}], 1.0) AS u,
                     [[CAST(q[1] * q[a * {_SIZE} + b + 1] - q[a + 1] * q[b + 1] AS DOUBLE) for b in {_ALL}] for a in {_ALL}] AS d,
                     q[{_SIZE}] - intercept * q[1] * 100.0 - list_sum([w[a] * q[a + 1] for a in {_INPUTS}]) AS bias
              FROM lines_without)""",
}


@query(sql(f"""
SELECT penalty, {half_up("r2_mean", 6)} AS r2_mean, {half_up("r2_std", 6)} AS r2_std, n_folds, r2_mean = max(r2_mean) OVER () AS is_best
FROM (SELECT penalty, avg(r2) AS r2_mean, stddev_pop(r2) AS r2_std, CAST(count(*) AS INTEGER) AS n_folds FROM folds_scored GROUP BY penalty)
""", "sales", **FOLDS))
def linear_cv(spark, folder):
    """Five-fold R² of the linear model along a path of penalties, all from one aggregation."""
    found = []
    for penalty, scores in linear.cross_validated(Ridge(spark, folder).folds, PENALTIES):
        mean = sum(scores) / len(scores)
        found.append((penalty, mean, (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5, len(scores)))
    best = max(m for _, m, _, _ in found)
    rows = spark.createDataFrame([(*r, r[1] == best) for r in found], "penalty double, r2_mean double, r2_std double, n_folds int, is_best boolean")
    return rows.withColumns({c: round_to(F.col(c), 6) for c in ("r2_mean", "r2_std")})


@query(sql(f"""
SELECT order_id, line_no, supplier_id, product_id, category, date, price, competitor_price, cost, inventory, units_sold AS actual,
       {half_up("predicted", 4)} AS predicted
FROM (SELECT *, greatest(count(*) OVER () // {STRIDED_ROWS}, 1) AS stride,
             row_number() OVER (ORDER BY date, {", ".join(LINE_KEYS)}, price, units_sold, competitor_price) - 1 AS place FROM scored)
WHERE place % stride = 0 AND place < {STRIDED_ROWS} * stride
""", "sales", **SCORED))
def prediction_strided(spark, folder):
    """At most 40 evenly spaced lines of the hold-out in order of date, with what was sold and what was expected."""
    scored = stage(Ridge(spark, folder).scored())
    sample = strided(scored, STRIDED_ROWS, "date", *LINE_KEYS, "price", "units_sold", "competitor_price")
    return sample.select(*LINE_KEYS, "category", "date", "price", "competitor_price", "cost", "inventory",
                         F.col("units_sold").alias("actual"), round_to(F.col("predicted"), 4).alias("predicted"))


@query(sql(f"""
SELECT category, count(*) AS n_rows, {half_up("avg(units_sold)", 3)} AS mean_actual, {half_up("avg(predicted)", 3)} AS mean_predicted
FROM scored GROUP BY GROUPING SETS ((category), ())
""", "sales", **SCORED))
def prediction_means(spark, folder):
    """Mean of what was sold and of what was expected on the hold-out, per category and (null) of all."""
    return Ridge(spark, folder).scored().rollup("category").agg(
        F.count("*").alias("n_rows"), round_to(F.avg(LABEL), 3).alias("mean_actual"), round_to(F.avg("predicted"), 3).alias("mean_predicted"))


def priced_products(spark, folder):
    """Each product as of its latest sale, with the inputs of the model."""
    return retail.pricing_rows(spark, folder).select(
        "product_id", "category", F.col("current_price").alias("base_price"), "cost", "competitor_price", "inventory", "month",
        (F.weekday("date") >= 5).cast("double").alias("is_weekend"))


PRICED = f"""
    SELECT product_id, s.category, current_price AS base_price, cost, competitor_price, inventory, CAST(isodow(date) >= 6 AS DOUBLE) AS is_weekend,
           CAST(s.month AS INTEGER) AS month, {SEASON} AS seasonal_factor FROM state s JOIN latest USING (product_id)"""


def _at(**changed: str) -> str:
    """Predicted units with some inputs replaced; the gap follows the prices."""
    inputs = {c: c for c in RIDGE_FEATURES} | {"price": "base_price"} | changed
    return PREDICTED.format(**inputs | {"price_gap": f"(({inputs['competitor_price']}) - ({inputs['price']}))"})


@query(sql(f"""
SELECT product_id, category, base_price, best AS recommended_price, {half_up("(best - base_price) / base_price * 100.0", 1)} AS price_change_pct,
       {half_up("units", 1)} AS expected_demand, {half_up("best * units", 2)} AS expected_revenue, {half_up("(best - cost) * units", 2)} AS expected_profit
FROM (SELECT *, {half_up("p", 2)} AS best, row_number() OVER (PARTITION BY product_id ORDER BY p * units DESC, step) AS place
      FROM (SELECT *, least({_at(price="p")} * (0.85::DOUBLE + 0.3::DOUBLE * 0.5::DOUBLE), inventory) AS units
            FROM (SELECT *, low + step * ((greatest(base_price * 1.2, competitor_price * 1.05) - low) / 120) AS p
                  FROM (SELECT *, greatest(cost * 1.02, 0.01) AS low FROM priced), (SELECT range AS step FROM range(121)))))
WHERE place = 1
""", "sales", "state", "latest", **RIDGE, priced=PRICED))
def prediction_table(spark, folder):
    """Best of 121 prices of every product by the ridge model."""
    return pricing.prediction_table(priced_products(spark, folder), Ridge(spark, folder).line)


def _impact(name: str, changed: str, base: str) -> str:
    change = half_up(f"coalesce(({changed} - {base}) / nullif({base}, 0.0), 0.0) * 100.0", 1)
    return f"SELECT product_id, '{name}' AS feature, {change} AS impact_pct FROM demanded"


@query(sql(" UNION ALL ".join(
    [_impact("price", "d_price", "d_base"), _impact("competitor_price", "d_rival", "d_base"), _impact("inventory", "d_stock", "d_base"),
     _impact("weekend", "d_weekend", "d_weekday")]), "sales", "state", "latest", **RIDGE, priced=PRICED, demanded=f"""
    SELECT product_id, {_at()} AS d_base, {_at(price="(base_price * 1.1)")} AS d_price, {_at(competitor_price="(competitor_price * 1.1)")} AS d_rival,
           {_at(inventory="(inventory * 1.5)")} AS d_stock, {_at(is_weekend="0.0")} AS d_weekday, {_at(is_weekend="1.0")} AS d_weekend FROM priced"""))
def what_if_scenarios(spark, folder):
    """Change of expected demand when price, competitor, stock or day type change."""
    return pricing.what_if_scenarios(priced_products(spark, folder), Ridge(spark, folder).line)
