"""Demand features and time series per product.

Sales are summed to product-day cells first. A cell table has at most one row per
product and calendar day, so the windows below see short groups even when one
product owns a third of all sales, and the first sums happen before any shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfprice.functions import clamp, from_cents, seasonal_factor, to_cents
from shelfprice.functions.calendar import year_angle
from shelfprice.operators.joins import lookup
from shelfprice.operators.staging import by_key, stage

TREND_LIMIT = 0.2
TREND_DAYS = 7


def daily_cells(rows: DataFrame, key: str = "product_id", sums: dict | None = None, tops: dict | None = None) -> DataFrame:
    """Rows, units, revenue and price total per key and day; money in cents.

    ``sums`` and ``tops`` name further totals and maxima.
    """
    return rows.groupBy(key, "date").agg(
        F.count("*").alias("n_rows"),
        F.sum("units_sold").alias("units"),
        F.sum(to_cents(F.col("price") * F.col("units_sold"))).alias("revenue"),
        F.sum(to_cents(F.col("price"))).alias("price_total"),
        *[F.sum(value).alias(name) for name, value in (sums or {}).items()],
        *[F.max(value).alias(name) for name, value in (tops or {}).items()],
    )


def mean_price():
    return from_cents(F.col("price_total")) / F.col("n_rows")


def calendar_features(dates: DataFrame) -> DataFrame:
    """Weekday (Monday 0), weekend, day of year, month and the position in the year."""
    return dates.withColumns({
        "dow": F.weekday("date"),
        "is_weekend": (F.weekday("date") >= 5).cast("int"),
        "doy": F.dayofyear("date"),
        "month": F.month("date"),
        "year_sin": F.sin(year_angle(F.col("date"))),
        "year_cos": F.cos(year_angle(F.col("date"))),
    })


def demand_features(daily: DataFrame) -> DataFrame:
    """Lags, trailing mean, price position and calendar per product-day.

    ``daily`` has product_id, date, category, price, competitor_price, inventory and
    units_sold, one row per product and day. All windows share one sort. Days
    without a seventh predecessor are dropped. The table is staged, as the category
    means need a pass of their own.
    """
    daily = stage(daily)
    by_day, whole = Window.partitionBy("product_id").orderBy("date"), Window.partitionBy("product_id")
    # in ten-thousandths, so that the means do not depend on the order of the rows
    unit = F.floor(F.col("price") * 1e4 + 0.5).cast("long")
    category_price = stage(daily.groupBy("category").agg((F.sum(unit) / F.count(unit) / 1e4).alias("cat_mean_price")))
    featured = daily.withColumns({
        "units_lag1": F.lag("units_sold", 1).over(by_day),
        "units_lag7": F.lag("units_sold", 7).over(by_day),
        "units_roll7": F.avg("units_sold").over(by_day.rowsBetween(-7, -1)),
        "price_ratio_to_base": F.col("price") / (F.sum(unit).over(whole) / F.count(unit).over(whole) / 1e4),
        "price_vs_competitor": F.col("price") - F.col("competitor_price"),
    }).where(F.col("units_lag7").isNotNull())
    featured = lookup(featured, category_price, "category")
    featured = featured.withColumn("price_over_cat", F.col("price") - F.col("cat_mean_price"))
    return calendar_features(featured).withColumn("seasonal_factor", seasonal_factor(F.col("month")))


def price_position(rows: DataFrame) -> DataFrame:
    """Each row with the mean price of its product and category, and the gaps to them.

    The means are grouped and joined back, not windowed: a window by category would
    put a whole category in one task. The product means are staged, so that the
    category means and the join size come from them and not from the rows again.
    """
    per_product = stage(rows.groupBy("product_id", "category").agg(
        F.sum(to_cents(F.col("price"))).alias("total"), F.count("*").alias("n")
    ))
    per_category = stage(per_product.groupBy("category").agg(
        (from_cents(F.sum("total")) / F.sum("n")).alias("cat_mean_price")
    ))
    product_mean = per_product.select("product_id", (from_cents(F.col("total")) / F.col("n")).alias("product_mean_price"))
    joined = lookup(lookup(rows, product_mean, "product_id"), per_category, "category")
    return joined.withColumns({
        "price_ratio_to_base": F.col("price") / F.col("product_mean_price"),
        "price_over_cat": F.col("price") - F.col("cat_mean_price"),
    })


def gap_filled(cells: DataFrame, key: str) -> DataFrame:
    """``(key, date, units)`` for every day between first and last sale, 0 where none sold.

    A sale day is followed by the days without sales up to the next one, where it is: the cells move, the
    days do not. What belongs to no key has no units.
    """
    per_day = by_key(cells.where(F.col("date").isNotNull()), key).groupBy(key, "date").agg(F.sum("units").alias("units"))
    later = F.lead("date").over(Window.partitionBy(key).orderBy("date"))
    until = F.coalesce(F.date_sub(later, 1), F.col("date"))
    days = per_day.withColumn("until_", until).select(
        key, "units", F.posexplode(F.sequence("date", "until_")).alias("step_", "date"))
    sold = F.when((F.col("step_") == 0) & F.col(key).isNotNull(), F.col("units"))
    return days.select(key, "date", F.coalesce(sold, F.lit(0.0)).alias("units"))


def _with_span(cells: DataFrame, key: str) -> DataFrame:
    whole = Window.partitionBy(key)
    return cells.withColumns({"first": F.min("date").over(whole), "last": F.max("date").over(whole)})


def damped_trend(cells: DataFrame, key: str = "product_id", min_rows: int = 60) -> DataFrame:
    """Relative change of the last seven days against the seven before, within ±0.2.

    Counts days without sales as 0, as on a gap-filled series, but without building
    one: only the days inside the two windows are added up.
    """
    age = F.datediff("last", "date")
    length = F.datediff("last", "first") + 1
    # a series shorter than 14 days compares with its own first seven days
    prior = F.when(length >= 2 * TREND_DAYS, age.between(TREND_DAYS, 2 * TREND_DAYS - 1)).otherwise(
        F.datediff("date", "first") < TREND_DAYS
    )
    totals = _with_span(cells, key).groupBy(key, "first", "last").agg(
        F.sum("n_rows").alias("n_rows"),
        (F.sum(F.when(age < TREND_DAYS, F.col("units")).otherwise(0.0)) / TREND_DAYS).alias("recent_mean"),
        (F.sum(F.when(prior, F.col("units")).otherwise(0.0)) / TREND_DAYS).alias("prior_mean"),
    )
    change = (F.col("recent_mean") - F.col("prior_mean")) / F.greatest("prior_mean", F.lit(1e-6))
    return totals.where(F.col("n_rows") >= min_rows).select(
        key, length.alias("days"),
        F.when(length < TREND_DAYS, 0.0).otherwise(clamp(change, -TREND_LIMIT, TREND_LIMIT)).alias("recent_trend"),
    )


def unit_trend(cells: DataFrame, key: str = "product_id") -> DataFrame:
    """Units of the last seven sale days minus the seven before; 0 below 14 sale days."""
    newest = Window.partitionBy(key).orderBy(F.desc("date"))
    ranked = cells.withColumn("age", F.row_number().over(newest))
    recent = F.sum(F.when(F.col("age") <= 7, F.col("units")).otherwise(0.0))
    prior = F.sum(F.when(F.col("age").between(8, 14), F.col("units")).otherwise(0.0))
    return ranked.groupBy(key).agg(
        F.count("*").alias("sale_days"),
        F.when(F.count("*") < 14, 0.0).otherwise(recent - prior).alias("unit_trend"),
    )


def ar1_baseline(cells: DataFrame, key: str = "product_id", min_rows: int = 60) -> DataFrame:
    """First-order autoregression of daily units with its AIC, fitted by least squares.

    Days without sales count as 0. They add nothing to the sums of squares and
    products, so the fit needs the cells and the length of the span only.
    """
    by_day = Window.partitionBy(key).orderBy("date")
    before = F.when(F.datediff("date", F.lag("date").over(by_day)) == 1, F.lag("units").over(by_day))
    paired = _with_span(cells, key).withColumn("before", F.coalesce(before, F.lit(0.0)))
    is_first, is_last = F.col("date") == F.col("first"), F.col("date") == F.col("last")
    x, y = F.when(is_last, 0.0).otherwise(F.col("units")), F.when(is_first, 0.0).otherwise(F.col("units"))
    sums = paired.groupBy(key, "first", "last").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"),
        F.sum(F.col("units") * F.col("before")).alias("sxy"),
        F.max(F.when(is_last, F.col("units"))).alias("last_units"),
    ).withColumn("n", F.datediff("last", "first").cast("double"))
    n = F.col("n")
    cxx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    cxy = F.col("sxy") - F.col("sx") * F.col("sy") / n
    cyy = F.col("syy") - F.col("sy") * F.col("sy") / n
    fitted = (
        sums.where((F.col("n_rows") >= min_rows) & (n > 3))
        .withColumns({"cxx": cxx, "cxy": cxy, "cyy": cyy})
        .withColumn("phi", F.col("cxy") / F.nullif(F.col("cxx"), F.lit(0.0)))
        .withColumns({
            "const": (F.col("sy") - F.col("phi") * F.col("sx")) / n,
            "rss": F.col("cyy") - F.col("phi") * F.col("cxy"),
        })
    )
    aic = n * (F.log(F.lit(2 * math.pi) * F.nullif(F.greatest("rss", F.lit(0.0)), F.lit(0.0)) / n) + 1.0) + 6.0
    return fitted.select(key, (n + 1).cast("bigint").alias("days"), "phi", "const", aic.alias("aic"), "last_units")


LONG_ORDER = 7
#: Cells whose days a task holds; each is dealt to ``order + 2`` days.
CELLS_PER_TASK = 100_000


def _lagged_days(cells: DataFrame, key: str, lags: int) -> DataFrame:
    """``key``, ``date`` and the units ``y0`` of that day and ``y1`` ... of the days before, for days within ``lags`` of a sale.

    On all other days of the span every one of these is 0. A sale is dealt to the days it is a lag of,
    so no series is built and no window is needed.
    """
    span = _with_span(cells.groupBy(key, "date").agg(F.sum("units").alias("units")), key)
    last_step = F.least(F.lit(lags), F.datediff("last", "date"))
    dealt = span.select(key, "first", "last", "units", "date", F.explode(F.sequence(F.lit(0), last_step)).alias("step"))
    return dealt.groupBy(key, "first", "last", F.date_add("date", F.col("step")).alias("date")).agg(*[
        F.sum(F.when(F.col("step") == k, F.col("units")).otherwise(0.0)).alias(f"y{k}") for k in range(lags + 1)])


def _long_autoregression(days: DataFrame, key: str, order: int) -> DataFrame:
    """Mean ``m`` and coefficients ``f1`` ... of an autoregression per key, from its autocovariances by Levinson's recursion."""
    age, left = F.datediff("date", "first"), F.datediff("last", "date")
    sums = [F.sum(F.col("y0") * F.col(f"y{k}")).alias(f"p{k}") for k in range(order + 1)]
    heads = [F.sum(F.when(age >= k, F.col("y0")).otherwise(0.0)).alias(f"h{k}") for k in range(order + 1)]
    tails = [F.sum(F.when(left >= k, F.col("y0")).otherwise(0.0)).alias(f"t{k}") for k in range(order + 1)]
    found = days.groupBy(key, "first", "last").agg(*sums, *heads, *tails)
    n = (F.datediff("last", "first") + 1).cast("double")
    found = found.withColumn("n", n).withColumn("m", F.col("h0") / F.col("n"))
    m, n = F.col("m"), F.col("n")
    found = found.withColumns({f"c{k}": (F.col(f"p{k}") - m * (F.col(f"h{k}") + F.col(f"t{k}")) + (n - k) * m * m) / n for k in range(order + 1)})
    found = found.select(key, "first", "last", "n", "m", F.col("c0").alias("v"), *[f"c{k}" for k in range(1, order + 1)])
    for k in range(1, order + 1):
        explained = sum((F.col(f"f{j}") * F.col(f"c{k - j}") for j in range(1, k)), F.lit(0.0))
        found = found.withColumn("r", (F.col(f"c{k}") - explained) / F.nullif("v", F.lit(0.0)))
        found = found.withColumns({
            **{f"f{j}": F.col(f"f{j}") - F.col("r") * F.col(f"f{k - j}") for j in range(1, k)},
            f"f{k}": F.col("r"), "v": F.col("v") * (1.0 - F.col("r") * F.col("r")),
        })
    return found.select(key, "n", "m", *[f"f{j}" for j in range(1, order + 1)])


def arma11_baseline(cells: DataFrame, key: str = "product_id", min_rows: int = 60, order: int = LONG_ORDER) -> DataFrame:
    """Autoregression with one moving-average term of daily units, with its AIC, by two least-squares steps.

    The residuals of a long autoregression stand for the unseen shocks; the units of a day are then
    regressed on the units and the shock of the day before. Days without sales count as 0. Away from
    sales every shock is the same, so both steps need the days within ``order + 1`` of a sale only, at most
    as many per product as the calendar has, and the number of the others. The cells of a product move once, to
    tasks whose number grows with the cells; their days are made, summed and joined there.
    """
    busy = cells.groupBy(key).agg(
        F.sum("n_rows").alias("n_rows"), F.datediff(F.max("date"), F.min("date")).alias("length"), F.count("*").alias("cells_"))
    busy = stage(busy.where((F.col("n_rows") >= min_rows) & (F.col("length") > 2 * order + 4)).select(key, "cells_"))
    n_cells = busy.agg(F.sum("cells_")).first()[0] or 0
    kept = by_key(cells.select(key, "date", "units"), key, -(-n_cells // CELLS_PER_TASK)).join(busy.select(key), key)
    days = _lagged_days(kept, key, order + 1)
    shocked = days.join(_long_autoregression(days, key, order), key)
    m = F.col("m")
    shock = F.col("y1") - m - sum((F.col(f"f{j}") * (F.col(f"y{j + 1}") - m) for j in range(1, order + 1)), F.lit(0.0))
    quiet = -m * (1.0 - sum((F.col(f"f{j}") for j in range(1, order + 1)), F.lit(0.0)))
    # the shock of the day before is known from the (order + 2)-th day on
    used = shocked.where(F.datediff("date", "first") >= order + 1).select(
        key, "n", "date", "last", F.col("y0").alias("y"), F.col("y1").alias("x"), shock.alias("e"), quiet.alias("quiet"))
    y, x, e = F.col("y"), F.col("x"), F.col("e")
    sums = used.groupBy(key).agg(
        F.max("n").alias("days"), F.max("quiet").alias("quiet"), F.count("*").alias("near"), F.max(F.when(F.col("date") == F.col("last"), y)).alias("last_units"),
        *[F.sum(value).alias(name) for name, value in {
            "sy": y, "sx": x, "se": e, "syy": y * y, "sxx": x * x, "see": e * e, "sxy": x * y, "sxe": x * e, "sye": y * e}.items()])
    away = F.col("n") - F.col("near")
    sums = sums.withColumn("n", F.col("days") - (order + 1)).withColumns({
        "se": F.col("se") + away * F.col("quiet"), "see": F.col("see") + away * F.col("quiet") * F.col("quiet")})

    def centred(a: str, b: str):
        return F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") / F.col("n")

    solved = sums.withColumns({f"c{a}{b}": centred(a, b) for a, b in ("yy", "xx", "ee", "xy", "xe", "ye")})
    det = F.nullif(F.col("cxx") * F.col("cee") - F.col("cxe") * F.col("cxe"), F.lit(0.0))
    solved = solved.withColumns({
        "phi": (F.col("cxy") * F.col("cee") - F.col("cye") * F.col("cxe")) / det,
        "theta": (F.col("cye") * F.col("cxx") - F.col("cxy") * F.col("cxe")) / det,
    })
    n, phi, theta = F.col("n"), F.col("phi"), F.col("theta")
    rss = F.col("cyy") - phi * F.col("cxy") - theta * F.col("cye")
    aic = n * (F.log(F.lit(2 * math.pi) * F.nullif(F.greatest(rss, F.lit(0.0)), F.lit(0.0)) / n) + 1.0) + 8.0
    return solved.select(
        key, F.col("days").cast("bigint").alias("days"), phi.alias("phi"), theta.alias("theta"),
        ((F.col("sy") - phi * F.col("sx") - theta * F.col("se")) / n).alias("const"), aic.alias("aic"), "last_units")
