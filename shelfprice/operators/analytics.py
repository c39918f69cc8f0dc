"""Catalogue reports over product-day cells and sales rows.

``cells`` are product-day totals with category and cost: product_id, category, cost,
date, n_rows, units, revenue, price_total (see :func:`catalogue_cells`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfprice.functions import from_cents, holiday_flag, month_name, round_to, safe_ratio, seasonal_factor, to_cents, weekend_flag
from shelfprice.functions.calendar import FESTIVAL_MONTHS
from shelfprice.operators.features import daily_cells
from shelfprice.operators.quantiles import group_medians
from shelfprice.operators.staging import stage

LOW_COVER_DAYS = 7
HIGH_COVER_DAYS = 60


def catalogue_cells(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Product-day cells with category and cost; rows are summed before the join."""
    attributes = products.select("product_id", "category", "cost")
    return daily_cells(rows).join(attributes, "product_id")


def profit() -> Column:
    return F.col("revenue") - to_cents(F.col("cost") * F.col("units"))


def product_totals(cells: DataFrame) -> DataFrame:
    """Units, revenue, profit and sale days per product; money rounded to units."""
    return cells.groupBy("product_id", "category").agg(
        F.sum("units").alias("units"),
        round_to(from_cents(F.sum("revenue")), 0).alias("revenue"),
        round_to(from_cents(F.sum(profit())), 0).alias("profit"),
        F.count("*").alias("days"),
    )


def latest_rows(rows: DataFrame, order: list[str], n: int, key: str = "product_id") -> DataFrame:
    """The ``n`` latest rows per key. Spark cuts each map task's rows to ``n`` per key
    before the shuffle, so a hot key costs no more than a cold one."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= n)


def sales_history(rows: DataFrame, order: list[str], n: int = 30) -> DataFrame:
    return latest_rows(rows, order, n).select("product_id", "date", "units_sold", "price", "recency")


def product_summary(rows: DataFrame, order: list[str]) -> DataFrame:
    """Per product: median prices, recent stock, totals, margin and days of cover.

    ``rows`` are sales rows with category, cost, competitor_price and inventory.
    """
    medians = group_medians(rows, ["product_id"], ["price", "cost", "competitor_price"])
    totals = rows.groupBy("product_id", "category", "date").agg(
        F.sum("units_sold").alias("units"),
        F.sum(to_cents(F.col("price") * F.col("units_sold"))).alias("revenue"),
        F.sum(to_cents((F.col("price") - F.col("cost")) * F.col("units_sold"))).alias("profit"),
    ).groupBy("product_id", "category").agg(
        F.sum("units").alias("units"), from_cents(F.sum("revenue")).alias("revenue"),
        from_cents(F.sum("profit")).alias("profit"), F.count("*").alias("days"),
    )
    recent = latest_rows(rows, order, 30).groupBy("product_id").agg(
        F.percentile("inventory", 0.5).alias("stock30"),
        F.percentile(F.when(F.col("recency") <= 7, F.col("inventory")), 0.5).alias("stock7"),
    )
    per_day = F.col("units") / F.col("days")
    joined = totals.join(medians, "product_id").join(recent, "product_id")
    return joined.select(
        "product_id", "category",
        round_to(F.col("price"), 2).alias("base_price"),
        round_to(F.col("cost"), 2).alias("cost"),
        round_to(F.col("competitor_price"), 2).alias("competitor_price"),
        round_to(F.col("stock30"), 0).alias("inventory"),
        round_to(per_day, 1).alias("avg_daily"),
        round_to(F.col("stock7") / F.greatest(F.lit(0.1), per_day), 0).alias("days_left"),
        "units",
        round_to(F.col("revenue"), 0).alias("revenue"),
        round_to(F.col("profit"), 0).alias("profit"),
        round_to(safe_ratio(F.col("price") - F.col("cost"), F.col("price")) * 100.0, 1).alias("margin_pct"),
    )


def stock_cover(rows: DataFrame, order: list[str]) -> DataFrame:
    """Days until stock-out at the mean sales per sale day, with a low or over flag."""
    per_day = rows.groupBy("product_id", "date").agg(F.sum("units_sold").alias("units"))
    pace = per_day.groupBy("product_id").agg((F.sum("units") / F.count("*")).alias("pace"))
    recent = latest_rows(rows, order, 30).groupBy("product_id").agg(
        F.percentile("inventory", 0.5).alias("stock30"),
        F.percentile(F.when(F.col("recency") <= 7, F.col("inventory")), 0.5).alias("stock7"),
    )
    cover = round_to(F.col("stock7") / F.greatest(F.lit(0.1), F.col("pace")), 0)
    return recent.join(pace, "product_id").select(
        "product_id", round_to(F.col("stock30"), 0).alias("inventory"),
        round_to(F.col("pace"), 1).alias("avg_daily"), cover.alias("days_left"),
        F.when((cover >= 0) & (cover < LOW_COVER_DAYS), "low").when(cover > HIGH_COVER_DAYS, "over").otherwise("ok").alias("stock_flag"),
    )


def stock_alerts(cover: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` shortest-covered low-stock and overstocked products."""
    shortest = [F.asc("days_left"), F.asc("product_id")]
    low = cover.where(F.col("stock_flag") == "low").orderBy(*shortest).limit(n)
    over = cover.where(F.col("stock_flag") == "over").orderBy(*shortest).limit(n)
    return low.unionByName(over)


def daily_series(cells: DataFrame) -> DataFrame:
    return cells.select(
        "product_id", "date", "units", from_cents(F.col("revenue")).alias("revenue"),
        round_to(from_cents(F.col("price_total")) / F.col("n_rows"), 4).alias("avg_price"),
    )


def monthly(cells: DataFrame) -> DataFrame:
    """Units, revenue, profit and mean seasonal factor for each month of the year."""
    month = F.month("date")
    totals = cells.groupBy(month.alias("month")).agg(
        F.sum("units").alias("units"), F.sum("revenue").alias("revenue"), F.sum(profit()).alias("profit"),
        F.sum("n_rows").alias("n_rows"),
    )
    every = cells.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    filled = every.join(F.broadcast(totals), "month", "left")  # twelve rows
    filled = filled.select(
        "month",
        F.coalesce("units", F.lit(0.0)).alias("units"),
        F.coalesce(from_cents(F.col("revenue")), F.lit(0.0)).alias("revenue"),
        F.coalesce(from_cents(F.col("profit")), F.lit(0.0)).alias("profit"),
        F.when(F.col("n_rows") > 0, seasonal_factor(F.col("month"))).otherwise(0.0).alias("seasonal_factor"),
    )
    return flag_extremes(filled, "month", "units", "best_month", "worst_month")


def flag_extremes(groups: DataFrame, name: str, measure: str, best: str, worst: str) -> DataFrame:
    """Mark the groups with the highest and the lowest measure, the first name on ties.

    The two names are aggregates of ``groups``, so no task needs all groups together. The groups
    are staged, so that the table behind them is read once.
    """
    groups = stage(groups)
    ends = groups.agg(
        F.min_by(name, F.struct(-F.col(measure), F.col(name))).alias("hi"),
        F.min_by(name, F.struct(F.col(measure), F.col(name))).alias("lo"),
    ).select(F.struct("hi", "lo")).scalar()
    return groups.withColumns({
        best: F.col(name).eqNullSafe(ends.getField("hi")), worst: F.col(name).eqNullSafe(ends.getField("lo"))})


def seasons(cells: DataFrame) -> DataFrame:
    """Units per quarter and month; month 0 is a quarter's total, quarter 0 the year's."""
    return (
        cells.groupBy(F.quarter("date").alias("quarter"), F.month("date").alias("month")).agg(F.sum("units").alias("units"))
        .rollup("quarter", "month").agg(F.sum("units").alias("units"))
        .fillna(0, ["quarter", "month"])
    )


def season_summary(cells: DataFrame) -> DataFrame:
    """Best and worst quarter and how far apart they are in percent."""
    quarters = cells.groupBy(F.quarter("date").alias("quarter")).agg(F.sum("units").alias("units"))
    return quarters.agg(
        F.min_by("quarter", F.struct(-F.col("units"), F.col("quarter"))).alias("best_season"),
        F.min_by("quarter", F.struct(F.col("units"), F.col("quarter"))).alias("worst_season"),
        round_to((F.max("units") / F.greatest(F.lit(1.0), F.min("units")) - 1.0) * 100.0, 0).alias("gap_pct"),
    )


def calendar_effects(cells: DataFrame) -> DataFrame:
    """Mean units per sale on weekends, holidays and in festival months."""
    month = F.month("date")
    groups = {
        "weekend": weekend_flag(F.col("date")) == 1,
        "weekday": weekend_flag(F.col("date")) == 0,
        "holiday": holiday_flag(month, F.dayofmonth("date")) == 1,
        "nonholiday": holiday_flag(month, F.dayofmonth("date")) == 0,
        "festival": month.isin(*FESTIVAL_MONTHS),
        "regular": ~month.isin(*FESTIVAL_MONTHS),
    }
    means = cells.agg(*[
        safe_ratio(F.sum(F.when(test, F.col("units"))), F.sum(F.when(test, F.col("n_rows")))).alias(name)
        for name, test in groups.items()
    ])
    impact = round_to((F.col("holiday") - F.col("nonholiday")) / F.nullif("nonholiday", F.lit(0.0)) * 100.0, 0)
    return means.select(
        *[F.coalesce(round_to(F.col(name), 1), F.lit(0.0)).alias(f"{name}_units") for name in groups],
        F.coalesce(impact, F.lit(0.0)).alias("holiday_impact_pct"),
    )


def category_totals(totals: DataFrame) -> DataFrame:
    """Revenue and profit per category from product totals, with the leaders marked."""
    groups = totals.groupBy("category").agg(F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"))
    groups = flag_extremes(groups, "category", "revenue", "best_revenue", "worst_revenue")
    return flag_extremes(groups, "category", "profit", "best_profit", "worst_profit")


def top_products(totals: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` products with the highest profit and with the highest revenue, and the lowest of each.

    Each board is a limited sort, of which a task keeps ``n`` rows.
    """
    parts = []
    for measure in ("profit", "revenue"):
        for board, order, size in ((f"top_{measure}", F.desc(measure), n), (f"lowest_{measure}", F.asc(measure), 1)):
            parts.append(
                totals.orderBy(order, "product_id").limit(size)
                .select(F.lit(board).alias("board"), "product_id", "profit", "revenue")
            )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def overview(rows: DataFrame, customers: DataFrame, days: int = 30) -> DataFrame:
    """Headline figures of the sales rows and of their last ``days`` days, in one row.

    The rows are totalled per day; the window over all of them sees calendar days.
    """
    by_day = rows.groupBy("date").agg(
        F.count("*").alias("n_rows"), F.sum("units_sold").alias("units"), F.sum(to_cents(F.col("price"))).alias("price_total")
    )
    last = F.max("date").over(Window.partitionBy(F.lit(1)))
    recent = F.col("date") >= F.date_sub("last", days)
    people = customers.agg(F.count("*").alias("n")).scalar()
    products = rows.select("product_id").distinct().agg(F.count("*").alias("n")).scalar()
    sold = F.sum(F.when(recent, F.col("n_rows")))
    return by_day.withColumn("last", last).agg(
        F.max("last").alias("generated_on"),
        F.sum("n_rows").alias("total_sales_rows"),
        F.sum(F.when(recent, F.col("units"))).alias("sales_last_30d"),
        round_to(safe_ratio(F.sum(F.when(recent, F.col("units"))), sold), 1).alias("avg_daily_units"),
        round_to(safe_ratio(from_cents(F.sum(F.when(recent, F.col("price_total")))), sold), 2).alias("avg_price"),
    ).withColumns({"products": products, "customers": people})


def price_trend(cells: DataFrame) -> DataFrame:
    """Mean selling price per product and month of the year."""
    return cells.groupBy("product_id", F.month("date").alias("month")).agg(
        round_to(from_cents(F.sum("price_total")) / F.sum("n_rows"), 4).alias("avg_price")
    )


def insight(cells: DataFrame, prices: DataFrame) -> DataFrame:
    """One row that tells the story of the catalogue.

    ``prices`` has product_id, current_price and recommended_price.
    """
    totals = product_totals(cells)
    by_month = cells.groupBy(F.month("date").alias("month")).agg(F.sum("units").alias("units"))
    best = totals.agg(F.min_by(F.struct("product_id", "profit"), F.struct(-F.col("profit"), F.col("product_id"))).alias("b")).scalar()
    lead = totals.groupBy("category").agg(F.sum("revenue").alias("revenue")).agg(
        F.min_by(F.struct("category", "revenue"), F.struct(-F.col("revenue"), F.col("category"))).alias("b")
    ).scalar()
    peaks = by_month.agg(F.struct(
        F.min_by(F.struct("month", "units"), F.struct(-F.col("units"), F.col("month"))).alias("hi"),
        F.min_by("month", F.struct(F.col("units"), F.col("month"))).alias("lo"),
        F.count_if(F.col("units") > 0).alias("months"),
    ).alias("p")).scalar()
    first = prices.agg(F.min_by(F.struct("product_id", "current_price", "recommended_price"), "product_id").alias("f")).scalar()
    change = round_to((first["recommended_price"] - first["current_price"]) / first["current_price"] * 100.0, 1)
    size = cells.agg(F.sum("n_rows").alias("records")).scalar()
    products = totals.agg(F.count("*").alias("products")).scalar()
    facts = calendar_effects(cells).select(
        size.alias("records"), products.alias("products"), peaks["months"].alias("months"),
        best["product_id"].alias("top_product"), best["profit"].alias("top_profit"),
        lead["category"].alias("top_category"), lead["revenue"].alias("top_category_revenue"),
        month_name(peaks["hi"]["month"]).alias("peak_month"), peaks["hi"]["units"].alias("peak_units"),
        month_name(peaks["lo"]).alias("weak_month"),
        "holiday_impact_pct", "weekend_units", "weekday_units",
        first["product_id"].alias("example_product"), change.alias("example_change_pct"),
    )
    story = F.concat_ws(
        " ",
        F.format_string("%d sales records across %d products over %d months.", "records", "products", "months"),
        F.format_string("Product %s earns the highest profit (%.0f).", F.col("top_product").cast("string"), "top_profit"),
        F.format_string("%s leads revenue (%.0f).", "top_category", "top_category_revenue"),
        F.format_string("Sales peak in %s (%.0f units) and are weakest in %s.", "peak_month", "peak_units", "weak_month"),
        F.format_string("Holidays move mean sales by %.0f%%.", "holiday_impact_pct"),
        F.format_string("Product %s: recommended price change %.1f%%.", F.col("example_product").cast("string"), "example_change_pct"),
    )
    return facts.withColumn("story", story)
