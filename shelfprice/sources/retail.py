"""The retail tables as the sales, product, customer and till views the operators take.

===================  ==========================================================
view                 meaning
===================  ==========================================================
``lines``            one sold line: product, day, unit price in cents, units
``products``         product attributes; cost is half the list price
``sales``            lines with product attributes and calendar columns
``customers``        customers with order count, mean order value and loyalty
``till``             the same lines as a supermarket receipt table
===================  ==========================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfprice.functions import cents, from_cents, holiday_flag, round_to, seasonal_factor, to_cents, weekend_flag
from shelfprice.operators.joins import lookup
from shelfprice.operators.staging import spread, stage

# Columns that, in this order, make the latest line of a product unambiguous.
LATEST_FIRST = ["date", "order_id", "line_no", "supplier_id", "units_sold", "price"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines(spark: SparkSession, folder: str, shared: bool = False) -> DataFrame:
    """One row per sold line; ``shared`` spreads a scan of few splits over all cores."""
    item = table(spark, folder, "lineitem")
    return (spread(item) if shared else item).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_shipdate").cast("date").alias("date"),
        cents(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("units_sold"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax_rate"),
        F.col("l_returnflag").alias("return_flag"),
        F.col("l_linestatus").alias("line_status"),
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("list_price"),
        cents(F.col("p_retailprice") * 0.5).alias("cost"),
        F.col("p_size").alias("stock"),
    )


def with_product(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Attach category and cost, and the market price and stock at the time of sale."""
    joined = lookup(rows, catalogue, "product_id")
    return joined.withColumns({
        "competitor_price": cents(F.col("list_price") * (F.lit(1.0) + F.col("tax_rate"))),
        "inventory": F.col("stock") + F.col("units_sold"),
    }).drop("list_price", "stock")


def with_calendar(rows: DataFrame) -> DataFrame:
    month = F.month("date")
    return rows.withColumns({
        "is_weekend": weekend_flag(F.col("date")),
        "month": month,
        "seasonal_factor": seasonal_factor(month),
        "holiday": holiday_flag(month, F.dayofmonth("date")),
    })


def sales(spark: SparkSession, folder: str, shared: bool = False) -> DataFrame:
    return with_calendar(with_product(lines(spark, folder, shared), products(spark, folder)))


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with purchase history; orders are aggregated once, before the join."""
    history = stage(table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("customer_id")).agg(
        F.count("*").alias("purchase_count"),
        from_cents(F.sum(to_cents(F.col("o_totalprice")))).alias("spend"),
    ))
    most = history.agg(F.max("purchase_count").alias("most")).scalar()
    people = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_nationkey").alias("n_nationkey"),
        F.col("c_mktsegment").alias("segment_hint"),
    )
    regions = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", F.col("r_name").alias("region"))
    count = F.coalesce("purchase_count", F.lit(0))
    return (
        lookup(people, regions, "n_nationkey", how="left")
        .join(history, "customer_id", "left")
        .select(
            "customer_id", "region", "segment_hint",
            count.alias("purchase_count"),
            F.coalesce(F.col("spend") / F.col("purchase_count"), F.lit(0.0)).alias("avg_sales"),
            round_to(count * F.lit(100.0) / most, 1).alias("loyalty_score"),
        )
    )


def till(spark: SparkSession, folder: str) -> DataFrame:
    """Receipt lines: sales includes tax, goods cost 60 % of the net amount.

    Keys are kept instead of names: reports total the lines per key before they join
    :func:`shelves`, :func:`stores`, :func:`receipts` and :func:`buyers`.
    """
    net = F.col("l_extendedprice")
    gross = net * (F.lit(1.0) + F.col("l_tax"))
    return table(spark, folder, "lineitem").select(
        "l_partkey", "l_suppkey", "l_orderkey",
        F.col("l_returnflag").alias("gender"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_quantity").alias("quantity"),
        cents(net / F.col("l_quantity")).alias("price"),
        cents(gross).alias("sales"),
        cents(net * F.col("l_tax")).alias("tax_5pct"),
        cents(net * 0.6).alias("cogs"),
        cents(gross - net * 0.6).alias("gross_income"),
    )


def shelves(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("product_line"))


def stores(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("branch"))
    return lookup(table(spark, folder, "supplier"), nation, "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "branch")


def receipts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("payment"),
    )


def buyers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("customer_type"))


def messy_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Sales rows with the faults a profile has to find: gaps and negative prices."""
    flag, status = F.col("return_flag"), F.col("line_status")
    return sales(spark, folder).select(
        "product_id", "date", "category",
        F.when((F.col("tax_rate") == 0) & (status == "F"), -F.col("price")).otherwise(F.col("price")).alias("price"),
        F.when(flag != "R", F.col("cost")).alias("cost"),
        F.when((flag != "A") | (status != "O"), F.col("competitor_price")).alias("competitor_price"),
        F.when(F.col("discount") != 0, F.col("inventory")).alias("inventory"),
        "units_sold",
    )


def raw_sales(spark: SparkSession, folder: str) -> DataFrame:
    """The sales rows as an export of mixed text: three date shapes, signs, blanks."""
    flag, status = F.col("return_flag"), F.col("line_status")
    money = F.concat(F.lit("$"), F.format_number("price", 2))
    return with_product(lines(spark, folder, shared=True), products(spark, folder)).select(
        "order_id", "line_no", "supplier_id",
        F.when(F.col("discount") == 0.1, F.lit(" ")).otherwise(F.col("product_id").cast("string")).alias("product_id"),
        F.when(flag == "A", F.date_format("date", "yyyy-MM-dd"))
        .when(flag == "R", F.date_format("date", "dd/MM/yyyy"))
        .otherwise(F.date_format("date", "M.d.yyyy")).alias("date"),
        F.when(F.col("tax_rate") == 0, F.lit("")).otherwise(F.col("category")).alias("category"),
        F.when(status == "O", money).otherwise(F.col("price").cast("decimal(18,2)").cast("string")).alias("price"),
        F.when(flag == "R", F.lit("n/a")).otherwise(F.col("cost").cast("decimal(18,2)").cast("string")).alias("cost"),
        F.when(flag == "A", F.lit("")).otherwise(F.col("competitor_price").cast("decimal(18,2)").cast("string")).alias("competitor_price"),
        F.when(status == "F", F.col("inventory").cast("int").cast("string")).alias("inventory"),
        F.col("units_sold").cast("int").cast("string").alias("units_sold"),
    )


def pricing_rows(spark: SparkSession, folder: str, min_rows: int = 8) -> DataFrame:
    """Market state per product with cost, stock and competitor price.

    Lines are reduced to one row per product before the catalogue is joined.
    """
    from shelfprice.operators.recommend import market_state

    state = market_state(lines(spark, folder), LATEST_FIRST, ["units_sold", "tax_rate", "date"], min_rows=min_rows)
    joined = state.join(products(spark, folder), "product_id")
    return joined.withColumns({
        "competitor_price": cents(F.col("list_price") * (F.lit(1.0) + F.col("tax_rate"))),
        "inventory": F.col("stock") + F.col("units_sold"),
        "month": F.month("date"),
    }).drop("list_price", "stock", "tax_rate", "units_sold")


def order_customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"))


def deal_requests(spark: SparkSession, folder: str, bought: DataFrame | None = None) -> DataFrame:
    """One price request per sold line; the budget is the discounted price once paid.

    ``bought`` has the orders with what is to go along with each request, the customer by default.
    """
    asked = lines(spark, folder).select(
        "order_id", "line_no", "supplier_id", "product_id", "units_sold",
        cents(F.col("price") * (F.lit(1.0) - F.col("discount"))).alias("budget"),
    )
    return lookup(asked, order_customers(spark, folder) if bought is None else bought, "order_id")


def stock_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with the stock at the time of sale and nothing else of the catalogue."""
    stock = products(spark, folder).select("product_id", "stock")
    return lookup(lines(spark, folder), stock, "product_id").withColumn("inventory", F.col("stock") + F.col("units_sold")).drop("stock")
