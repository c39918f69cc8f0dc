"""Sources, mapping, cleaning and profiling."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfprice.functions import from_cents, parse_date, parse_number, round_to, to_cents
from shelfprice.operators import cleaning, profiling
from shelfprice.operators.mapping import apply_mapping, detect_roles, standardize_receipt, suggest_mapping
from shelfprice.plans.registry import query
from shelfprice.plans.views import half_up, sql
from shelfprice.session import scratch_dir
from shelfprice.sources import read_lenient_csv, retail, write_csv

STAT_COLUMNS = ["price", "cost", "competitor_price", "inventory", "units_sold"]
FILL_COLUMNS = ["cost", "competitor_price", "inventory"]
ROW_KEYS = ["order_id", "line_no", "supplier_id"]


@query("""
SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part
""")
def csv_roundtrip(spark, folder):
    part = retail.table(spark, folder, "part")
    path = write_csv(part, f"{scratch_dir(spark)}/csv-{uuid.uuid4().hex}")
    return read_lenient_csv(spark, path, schema=part.schema)


@query(sql("""
SELECT date, price, cost, units_sold, competitor_price, inventory, product_id FROM messy
ORDER BY date DESC, product_id DESC, units_sold DESC, price DESC LIMIT 500
""", "messy"))
def role_sample(spark, folder):
    sales = retail.messy_sales(spark, folder)
    return profiling.latest_sample(sales, detect_roles(sales.columns), ["date", "product_id", "units_sold", "price"])


@query("""
WITH shown AS (
    SELECT o_orderkey, CASE o_orderpriority
        WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d')
        WHEN '2-HIGH' THEN strftime(o_orderdate, '%d/%m/%Y')
        WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%m-%d-%y')
        WHEN '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00')
        ELSE strftime(o_orderdate, '%b %-d, %Y') END AS shown
    FROM orders),
parts AS (
    SELECT *, regexp_matches(shown, '^\\d{4}-') AS iso, regexp_matches(shown, '^\\d{1,2}[/.-]') AS slashed,
           TRY_CAST(regexp_extract(shown, '^(\\d{1,2})[/.-](\\d{1,2})[/.-](\\d{2,4})', 1) AS INTEGER) AS a,
           TRY_CAST(regexp_extract(shown, '^(\\d{1,2})[/.-](\\d{1,2})[/.-](\\d{2,4})', 2) AS INTEGER) AS b,
           TRY_CAST(regexp_extract(shown, '^(\\d{1,2})[/.-](\\d{1,2})[/.-](\\d{2,4})', 3) AS INTEGER) AS y
    FROM shown)
SELECT o_orderkey, shown, CASE
    WHEN iso THEN CAST(substr(shown, 1, 10) AS DATE)
    WHEN slashed THEN make_date(CASE WHEN y < 100 THEN y + 2000 ELSE y END,
                                CASE WHEN a > 12 THEN b ELSE a END, CASE WHEN a > 12 THEN a ELSE b END)
    ELSE CAST(strptime(shown, '%b %-d, %Y') AS DATE) END AS parsed
FROM parts
""")
def date_parse(spark, folder):
    day = F.col("o_orderdate")
    shown = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format(day, "yyyy-MM-dd"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(day, "dd/MM/yyyy"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format(day, "MM-dd-yy"))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(F.date_format(day, "MMM d, yyyy"))
    )
    orders = retail.table(spark, folder, "orders").select("o_orderkey", shown.alias("shown"))
    return orders.withColumn("parsed", parse_date(F.col("shown")))


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '$' || format('{:,.2f}', o_totalprice)
                                      WHEN 'O' THEN '€ ' || format('{:,.2f}', o_totalprice) ELSE 'n/a' END AS shown,
       CASE WHEN o_orderstatus IN ('F', 'O') THEN o_totalprice END AS parsed
FROM orders
""")
def number_parse(spark, folder):
    amount = F.format_number("o_totalprice", 2)
    shown = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("$"), amount))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("€ "), amount))
        .otherwise("n/a")
    )
    orders = retail.table(spark, folder, "orders").select("o_orderkey", shown.alias("shown"))
    return orders.withColumn("parsed", parse_number(F.col("shown")))


NORMALIZED = f"""
SELECT order_id, line_no, supplier_id, product_id, date, category, price, cost, competitor_price, inventory, units_sold,
       CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, month,
       ([1.12, 0.92, 1.0, 1.02, 0.96, 0.84, 0.78, 0.88, 1.08, 1.32, 1.5, 1.24][month])::DOUBLE AS seasonal_factor,
       CAST(month = 11 OR (month = 12 AND day(date) >= 20) OR (month = 1 AND day(date) <= 5)
            OR (month = 4 AND day(date) BETWEEN 10 AND 15) AS INTEGER) AS holiday
FROM (SELECT *, CAST(month(date) AS INTEGER) AS month FROM (
    SELECT order_id, line_no, supplier_id, CAST(product_id AS VARCHAR) AS product_id,
           CASE WHEN return_flag = 'A' OR day(date) > 12 THEN date
                ELSE CASE return_flag WHEN 'R' THEN make_date(CAST(year(date) AS INT), CAST(day(date) AS INT), CAST(month(date) AS INT)) ELSE date END
           END AS date,
           CASE WHEN tax_rate = 0 THEN 'General' ELSE category END AS category, price,
           CASE WHEN return_flag = 'R' THEN price * 0.5 ELSE cost END AS cost,
           CASE WHEN return_flag = 'A' THEN price * 1.03 ELSE competitor_price END AS competitor_price,
           CASE WHEN line_status = 'F' THEN inventory ELSE 0.0 END AS inventory, units_sold
    FROM sales WHERE discount <> 0.1))
"""


@query(sql(NORMALIZED, "sales"))
def normalize_sales(spark, folder):
    return cleaning.normalize_sales(retail.raw_sales(spark, folder), keep=ROW_KEYS)


#: The raw columns under the names another shop gives them.
FOREIGN_HEADERS = {
    "product_id": "SKU", "date": "Order-Date", "category": "Department", "price": "Selling Price", "cost": "Unit Cost",
    "competitor_price": "Market_Price", "inventory": "Stock level", "units_sold": "QTY",
}


@query(sql(f"SELECT * EXCLUDE (order_id, line_no, supplier_id) FROM ({NORMALIZED})", "sales"))
def mapped_sales(spark, folder):
    """A table with foreign headers: columns recognised, required ones checked, rows normalised."""
    raw = retail.raw_sales(spark, folder).drop(*ROW_KEYS)
    foreign = raw.select(*[F.col(c).alias(FOREIGN_HEADERS[c]) for c in reversed(raw.columns)])
    return cleaning.normalize_sales(apply_mapping(foreign, suggest_mapping(foreign.columns)))


RECEIPT_HEADERS = {"gender": "Gender", "quantity": "Quantity", "price": "Unit price", "sales": "Sales", "tax_5pct": "Tax 5%", "cogs": "Cost of goods sold",
                   "gross_income": "gross income"}


@query(sql(f"""
SELECT gender, CAST(sum(quantity) AS DOUBLE) AS units, {half_up("sum(CAST(tax_5pct AS DECIMAL(18,2)))::DOUBLE", 2)} AS tax,
       {half_up("sum(CAST(cogs AS DECIMAL(18,2)))::DOUBLE", 2)} AS cogs, {half_up("sum(CAST(gross_income AS DECIMAL(18,2)))::DOUBLE", 2)} AS gross_income,
       max(price) AS top_price FROM till GROUP BY gender
""", "till"))
def receipt_totals(spark, folder):
    """Totals of a receipt table that comes with the headers of a till export."""
    export = retail.till(spark, folder).select(*[F.col(c).alias(h) for c, h in RECEIPT_HEADERS.items()])
    receipts = standardize_receipt(export)

    def total(c):
        return from_cents(F.sum(to_cents(F.col(c))))

    return receipts.groupBy("gender").agg(
        F.sum("units").alias("units"), total("tax_5pct").alias("tax"), total("cogs").alias("cogs"),
        total("gross_income").alias("gross_income"), F.max("price").alias("top_price"))


def _gappy(spark, folder):
    flag, status = F.col("return_flag"), F.col("line_status")
    return retail.sales(spark, folder).select(
        *ROW_KEYS, "product_id",
        F.when(flag != "R", F.col("cost")).alias("cost"),
        F.when((flag != "A") | (status != "O"), F.col("competitor_price")).alias("competitor_price"),
        F.when(F.col("discount") != 0, F.col("inventory")).alias("inventory"),
    )


GAPPY = """
    SELECT order_id, line_no, supplier_id, product_id, CASE WHEN return_flag <> 'R' THEN cost END AS cost,
           CASE WHEN return_flag <> 'A' OR line_status <> 'O' THEN competitor_price END AS competitor_price,
           CASE WHEN discount <> 0 THEN inventory END AS inventory
    FROM sales"""


@query(sql(f"""
SELECT order_id, line_no, supplier_id, product_id,
       {half_up("coalesce(cost, (SELECT quantile_cont(cost, 0.5) FROM gappy))", 6)} AS cost,
       {half_up("coalesce(competitor_price, (SELECT quantile_cont(competitor_price, 0.5) FROM gappy))", 6)} AS competitor_price,
       {half_up("coalesce(inventory, (SELECT quantile_cont(inventory, 0.5) FROM gappy))", 6)} AS inventory
FROM gappy
""", "sales", gappy=GAPPY))
def median_fill(spark, folder):
    filled = cleaning.median_fill(_gappy(spark, folder), FILL_COLUMNS)
    return filled.withColumns({c: round_to(F.col(c), 6) for c in FILL_COLUMNS})


@query(sql("""
SELECT count(*) AS n_rows, count(units) AS rows_used, count(*) - count(units) AS rows_dropped,
       CASE WHEN min(currency) = max(currency) THEN 'currency' ELSE '' END AS constant_columns,
       CASE WHEN count(DISTINCT brand) > 30 THEN 'brand' ELSE '' END
         || CASE WHEN count(DISTINCT day) > 30 THEN 'day' ELSE '' END AS wide_columns,
       count(units) >= 30 AS enough_rows
FROM (SELECT CASE WHEN return_flag = 'R' AND discount = 0 THEN NULL ELSE units_sold END AS units, price, brand, category,
             strftime(date, '%Y-%m-%d') AS day, 'USD' AS currency FROM sales)
""", "sales"))
def usable_rows(spark, folder):
    rows = retail.sales(spark, folder).select(
        F.when((F.col("return_flag") == "R") & (F.col("discount") == 0), F.lit("bad"))
        .otherwise(F.col("units_sold").cast("string")).alias("units"),
        "price", "brand", "category", F.date_format("date", "yyyy-MM-dd").alias("day"), F.lit("USD").alias("currency"),
    )
    return cleaning.usable_rows(rows, "units")


@query("""
SELECT p_partkey, p_retailprice,
       CAST(p_type = 'ECONOMY' AS DOUBLE) AS "p_type_ECONOMY", CAST(p_type = 'LARGE' AS DOUBLE) AS "p_type_LARGE",
       CAST(p_type = 'MEDIUM' AS DOUBLE) AS "p_type_MEDIUM", CAST(p_type = 'PROMO' AS DOUBLE) AS "p_type_PROMO",
       CAST(p_type = 'SMALL' AS DOUBLE) AS "p_type_SMALL", CAST(p_type = 'STANDARD' AS DOUBLE) AS "p_type_STANDARD"
FROM part
""")
def one_hot(spark, folder):
    part = retail.table(spark, folder, "part").select("p_partkey", "p_retailprice", "p_type")
    return cleaning.one_hot(part, "p_type")


@query("""
WITH gappy AS (
    SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice,
           CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority
    FROM orders)
SELECT o_orderkey, coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM gappy)) AS o_totalprice,
       coalesce(o_orderpriority, (SELECT o_orderpriority FROM gappy WHERE o_orderpriority IS NOT NULL
                                  GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1)) AS o_orderpriority
FROM gappy
""")
def impute(spark, folder):
    orders = retail.table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("o_totalprice"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    return cleaning.impute(orders, ["o_totalprice"], ["o_orderpriority"])


RECEIPT_NUMBERS = ["quantity", "price", "tax_5pct", "cogs", "gross_income"]
UNION = "\nUNION ALL\n"


def _leak_sql(column: str) -> str:
    by_name = "TRUE" if column in ("tax_5pct", "cogs", "gross_income") else "FALSE"
    corr = half_up(f"corr({column}, sales)", 6)
    return f"SELECT '{column}' AS \"column\", {corr} AS corr, {by_name} AS by_name, abs(corr({column}, sales)) >= 0.98 AS by_value FROM till"


@query(sql(UNION.join(_leak_sql(c) for c in RECEIPT_NUMBERS), "till"))
def leakage_scan(spark, folder):
    receipts = retail.till(spark, folder).select("sales", *RECEIPT_NUMBERS)
    return cleaning.leakage_scan(receipts, "sales").withColumn("corr", round_to(F.col("corr"), 6))


MESSY_COLUMNS = {
    "product_id": "numeric", "date": "datetime", "category": "categorical", "price": "numeric", "cost": "numeric",
    "competitor_price": "numeric", "inventory": "numeric", "units_sold": "numeric",
}
MESSY_NUMBERS = [c for c, kind in MESSY_COLUMNS.items() if kind == "numeric"]
MESSY_KEYS = ", ".join(MESSY_COLUMNS)


@query(sql(UNION.join(
    f"SELECT '{c}' AS \"column\", '{kind}' AS kind, count(*) AS n_rows, count(*) - count({c}) AS n_missing FROM messy"
    for c, kind in MESSY_COLUMNS.items()
), "messy"))
def profile_missing(spark, folder):
    return profiling.profile_missing(retail.messy_sales(spark, folder))


@query(sql(f"""
SELECT CAST(sum(n) AS BIGINT) AS n_rows, 8 AS n_columns, 6 AS numeric_columns, 1 AS categorical_columns, 1 AS datetime_columns,
       (SELECT count(*) * 3 - count(cost) - count(competitor_price) - count(inventory) FROM messy) AS total_missing,
       CAST(sum(n - 1) AS BIGINT) AS duplicates
FROM (SELECT count(*) AS n FROM messy GROUP BY {MESSY_KEYS})
""", "messy"))
def profile_summary(spark, folder):
    return profiling.profile_summary(retail.messy_sales(spark, folder))


@query(sql("""
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS duplicates
FROM (SELECT count(*) AS n FROM lines GROUP BY product_id, date, units_sold, discount)
""", "lines"))
def duplicate_count(spark, folder):
    return profiling.duplicate_count(retail.lines(spark, folder), ["product_id", "date", "units_sold", "discount"])


def _stats_sql(column: str) -> str:
    mean = half_up(f"avg({column})", 2)
    low, high = half_up(f"min({column})", 2), half_up(f"max({column})", 2)
    return f"SELECT '{column}' AS \"column\", {low} AS min, {high} AS max, {mean} AS avg, count({column}) AS count FROM messy"


@query(sql(UNION.join(_stats_sql(c) for c in STAT_COLUMNS), "messy"))
def basic_stats(spark, folder):
    return profiling.basic_stats(retail.messy_sales(spark, folder), STAT_COLUMNS)


def _target_sql(column: str) -> str:
    points = -0.25 if column in ("price", "cost", "competitor_price", "inventory") else 0.0
    boost = 0.3 if column == "units_sold" else 0.0
    raw = f"""greatest(
          CASE WHEN cv < 0.05 THEN 0.15::DOUBLE WHEN cv < 0.5 THEN 0.4::DOUBLE ELSE 0.55::DOUBLE END
        + CASE WHEN cardinality >= 100 THEN 0.3::DOUBLE WHEN cardinality >= 20 THEN 0.2::DOUBLE ELSE 0.05::DOUBLE END
        + CASE WHEN n > n_rows * 0.9 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + {points}::DOUBLE, 0.0::DOUBLE)"""
    return f"""
SELECT '{column}' AS "column", cardinality, least({half_up(f"score + {boost}::DOUBLE", 2)}, 1.0) AS suitability
FROM (SELECT cardinality, CASE WHEN cv < 1e-4 THEN 0.0 ELSE {half_up(raw, 2)} END AS score
      FROM (SELECT count(*) AS n_rows, count({column}) AS n, count(DISTINCT {column}) AS cardinality,
                   coalesce(stddev_samp({column}) / nullif(avg({column}), 0), 0) AS cv FROM messy))"""


@query(sql(UNION.join(_target_sql(c) for c in MESSY_NUMBERS), "messy"))
def target_candidates(spark, folder):
    sales = retail.messy_sales(spark, folder)
    return profiling.target_candidates(sales, detect_roles(sales.columns)["units"])


def _outside(column: str) -> str:
    return f"(SELECT count(*) FROM messy WHERE q3 > q1 AND ({column} < q1 - 3 * (q3 - q1) OR {column} > q3 + 3 * (q3 - q1)))"


def _quartiles(column: str) -> str:
    return f"(SELECT quantile_cont({column}, 0.25)::DOUBLE AS q1, quantile_cont({column}, 0.75)::DOUBLE AS q3 FROM messy)"


@query(sql(UNION.join(
    f"SELECT '{c}' AS \"column\", {half_up('q1', 6)} AS q1, {half_up('q3', 6)} AS q3, {half_up('q3 - q1', 6)} AS iqr, "
    f"{_outside(c)} AS outliers FROM {_quartiles(c)}"
    for c in MESSY_NUMBERS
), "messy"))
def iqr_outliers(spark, folder):
    found = profiling.iqr_outliers(retail.messy_sales(spark, folder), MESSY_NUMBERS)
    return found.withColumns({c: round_to(F.col(c), 6) for c in ("q1", "q3", "iqr")})


ISSUE_STATS = """
    SELECT count(*) AS n, (count(*) * 3 - count(cost) - count(competitor_price) - count(inventory)) / (count(*) * 8.0) AS missing,
           count(*) FILTER (price < 0) AS neg_price, count(*) FILTER (price <= 0) AS zero_price,
           count(*) FILTER (cost < 0) AS neg_cost, count(*) FILTER (price > 0 AND cost > 0 AND price < cost) AS under
    FROM messy"""
ISSUE_COPIES = f"SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS dups FROM (SELECT count(*) AS n FROM messy GROUP BY {MESSY_KEYS})"
ISSUE_OUTLIERS = UNION.join(
    f"SELECT '{c}' AS name, {_outside(c)} AS k FROM {_quartiles(c)}" for c in MESSY_NUMBERS if c not in ("price", "cost")
)
ISSUES = """
    SELECT CAST(floor(missing * 100 + 0.5) AS BIGINT) || '% of all cells are missing' AS issue, 25 AS penalty, 0 AS bad_cells
        FROM stats WHERE missing > 0.2
    UNION ALL SELECT CAST(floor(missing * 100 + 0.5) AS BIGINT) || '% of cells are missing', 8, 0 FROM stats WHERE missing > 0.05 AND missing <= 0.2
    UNION ALL SELECT 'only ' || format('{:,}', n) || ' rows', 20, 0 FROM stats WHERE n < 50
    UNION ALL SELECT format('{:,}', n) || ' rows are few', 8, 0 FROM stats WHERE n >= 50 AND n < 200
    UNION ALL SELECT 'price: ' || format('{:,}', neg_price) || ' negative values', 10, neg_price FROM stats WHERE neg_price > 0
    UNION ALL SELECT 'price: ' || format('{:,}', zero_price) || ' zero or negative prices', 5, zero_price FROM stats WHERE zero_price > 0
    UNION ALL SELECT 'cost: ' || format('{:,}', neg_cost) || ' negative values', 10, neg_cost FROM stats WHERE neg_cost > 0
    UNION ALL SELECT format('{:,}', under) || ' rows priced below cost', 8, 0 FROM stats WHERE under > 0
    UNION ALL SELECT format('{:,}', dups) || ' duplicate rows', CASE WHEN dups > 0.1 * n THEN 10 ELSE 3 END, 0 FROM copies, stats WHERE dups > 0
    UNION ALL SELECT name || ': ' || format('{:,}', k) || ' extreme outliers', 4, k FROM outside WHERE k > 0"""


@query(sql("""
SELECT score, bad_cells, issues, CASE WHEN score >= 85 THEN 'Excellent' WHEN score >= 70 THEN 'Good'
                                      WHEN score >= 50 THEN 'Fair' ELSE 'Poor' END AS label
FROM (SELECT CAST(greatest(100 - coalesce(sum(penalty), 0), 0) AS INTEGER) AS score,
             CAST(coalesce(sum(bad_cells), 0) AS BIGINT) AS bad_cells, string_agg(issue, '; ' ORDER BY issue) AS issues FROM issues)
""", "messy", stats=ISSUE_STATS, copies=ISSUE_COPIES, outside=ISSUE_OUTLIERS, issues=ISSUES))
def quality_score(spark, folder):
    scored = profiling.quality_score(retail.messy_sales(spark, folder))
    return scored.withColumn("issues", F.array_join("issues", "; "))


@query(sql("SELECT product_id, date, category, price, cost, competitor_price, inventory, units_sold FROM messy "
           "ORDER BY product_id, date, units_sold, price LIMIT 10", "messy"))
def preview(spark, folder):
    return profiling.preview(retail.messy_sales(spark, folder), ["product_id", "date", "units_sold", "price"])


@query("SELECT DISTINCT l_partkey AS product_id FROM lineitem")
def product_list(spark, folder):
    return retail.lines(spark, folder).select("product_id").distinct()


@query("SELECT DISTINCT c_custkey AS customer_id FROM customer")
def customer_list(spark, folder):
    return retail.table(spark, folder, "customer").select(F.col("c_custkey").alias("customer_id")).distinct()
