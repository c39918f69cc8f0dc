"""Demand curves: ``ln(units) = a + b ln(price)`` fitted per group by SQL aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules that make a curve usable.
MIN_CURVE_ROWS = 8
MAX_ELASTICITY = -0.01
CEILING_MULTIPLE = 1.5
MIN_VARIATION = 1e-12

CURVE_FIELDS = ["n_obs", "intercept", "elasticity", "r2", "ceiling", "usable"]


def _sold(price: str, units: str) -> Column:
    return (F.col(price) > 0) & (F.col(units) > 0)


def curve_aggregates(price: str = "price", units: str = "units_sold") -> list[Column]:
    """Moments of a curve fit. They merge, so a hot group is combined map-side."""
    sold = _sold(price, units)
    x, y = F.when(sold, F.log(price)), F.when(sold, F.log(units))
    return [
        F.count(F.when(sold, 1)).alias("n_obs"),
        F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"),
        F.covar_pop(y, x).alias("cov_xy"), F.var_pop(x).alias("var_x"), F.var_pop(y).alias("var_y"),
        F.max(F.when(sold, F.col(units))).alias("most_units"),
    ]


def finish_curve(fits: DataFrame, min_rows: int = MIN_CURVE_ROWS, max_elasticity: float = MAX_ELASTICITY) -> DataFrame:
    """Turn the moments into a least-squares curve and say whether it can be used.

    A curve is unusable below ``min_rows`` rows, without price variation, or when
    demand does not fall with the price.
    """
    price_varies = F.col("var_x") * F.col("n_obs") > MIN_VARIATION
    units_vary = F.col("var_y") * F.col("n_obs") > MIN_VARIATION
    slope = F.when(price_varies, F.col("cov_xy") / F.col("var_x"))
    explained = F.when(price_varies & units_vary, F.pow("cov_xy", F.lit(2)) / (F.col("var_x") * F.col("var_y")))
    fitted = fits.withColumn("elasticity", slope).withColumns({
        "intercept": F.col("mean_y") - F.col("elasticity") * F.col("mean_x"),
        "r2": F.coalesce(explained, F.lit(0.0)),
        "ceiling": F.col("most_units") * CEILING_MULTIPLE,
        "usable": F.coalesce((F.col("n_obs") >= min_rows) & (F.col("elasticity") < max_elasticity), F.lit(False)),
    })
    return fitted.drop("mean_x", "mean_y", "cov_xy", "var_x", "var_y", "most_units")


def fit_curves(rows: DataFrame, group: str = "product_id", min_rows: int = MIN_CURVE_ROWS, **names: str) -> DataFrame:
    """One curve per group, in one aggregation over the table."""
    return finish_curve(rows.groupBy(group).agg(*curve_aggregates(**names)), min_rows)


def pooled_curve(rows: DataFrame, min_rows: int = MIN_CURVE_ROWS, **names: str) -> DataFrame:
    """The curve of the whole table, in one row."""
    return finish_curve(rows.agg(*curve_aggregates(**names)), min_rows)


def merged_moments(fits: DataFrame, *by: str) -> DataFrame:
    """Moments of all groups together, or of those with equal ``by``, from those of the groups: the rows are not read again."""
    n = F.col("n_obs")
    weight = F.sum(F.when(n > 0, n))

    def mean(value: Column) -> Column:
        return F.sum(F.when(n > 0, n * value)) / weight

    sums = fits.groupBy(*by).agg(
        weight.alias("n_obs"), mean(F.col("mean_x")).alias("mean_x"), mean(F.col("mean_y")).alias("mean_y"),
        mean(F.col("cov_xy") + F.col("mean_x") * F.col("mean_y")).alias("xy"),
        mean(F.col("var_x") + F.col("mean_x") * F.col("mean_x")).alias("xx"),
        mean(F.col("var_y") + F.col("mean_y") * F.col("mean_y")).alias("yy"),
        F.max("most_units").alias("most_units"),
    )
    return sums.select(
        *by, F.coalesce("n_obs", F.lit(0)).alias("n_obs"), "mean_x", "mean_y", "most_units",
        (F.col("xy") - F.col("mean_x") * F.col("mean_y")).alias("cov_xy"),
        (F.col("xx") - F.col("mean_x") * F.col("mean_x")).alias("var_x"),
        (F.col("yy") - F.col("mean_y") * F.col("mean_y")).alias("var_y"),
    )


def with_pooled_fallback(curves: DataFrame, pooled: DataFrame) -> DataFrame:
    """Use the pooled curve where a group has none; ``kind`` tells which one it is.

    A group keeps its own figures when there is no usable curve at all.
    """
    whole = pooled.select(F.struct(*CURVE_FIELDS)).scalar()
    own = F.col("usable")
    kind = F.when(own, "product").when(whole.getField("usable"), "category").otherwise("unsupported")
    pool = F.coalesce(whole.getField("usable"), F.lit(False))
    chosen = {c: F.when(own | ~pool, F.col(c)).otherwise(whole.getField(c)) for c in CURVE_FIELDS if c != "usable"}
    return curves.withColumn("kind", kind).withColumns(chosen).withColumn("usable", F.col("kind") != "unsupported")


def demand_at(price: Column, intercept: Column, elasticity: Column, ceiling: Column) -> Column:
    """Units expected at a price, between 0 and the ceiling."""
    return F.least(F.greatest(F.exp(intercept) * F.pow(price, elasticity), F.lit(0.0)), ceiling)
