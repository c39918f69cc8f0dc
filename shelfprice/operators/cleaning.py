"""From raw rows to canonical sales rows, and from gaps to filled values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfprice.functions import holiday_flag, parse_date, parse_number, seasonal_factor, weekend_flag
from shelfprice.operators.profiling import column_kinds, numeric_columns, spaced
from shelfprice.operators.quantiles import column_quantiles

# Stand-ins for absent optional columns.
COST_SHARE = 0.5
COMPETITOR_SHARE = 1.03
DEFAULT_CATEGORY = "General"
MISSING_LEVEL = "__missing__"
MAX_LEVELS = 30
MIN_TRAINING_ROWS = 30

# Names of columns computed from the sales amount.
LEAKING_NAMES = (
    "tax 5%", "tax 5 pct", "tax", "tax pct", "tax5", "tax 5pct",
    "cogs", "cost of goods sold", "cost",
    "gross income", "gross profit", "profit",
)
SUSPECT_CORRELATION = 0.98


def normalize_sales(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Canonical sales rows from raw text columns named by :func:`apply_mapping`.

    Rows without a product, date, price or units are dropped; absent optional values
    are derived. ``keep`` names extra columns to carry along. The texts of a row are parsed into one struct, so
    that no later filter or column parses them again.
    """

    def text(name: str) -> Column:
        return F.trim(F.col(name).cast("string")) if name in raw.columns else F.lit(None).cast("string")

    def number(name: str) -> Column:
        return parse_number(text(name)) if name in raw.columns else F.lit(None).cast("double")

    parsed = raw.select(*(keep or []), F.inline(F.array(F.struct(
        text("product_id").alias("product_id"), parse_date(text("date")).alias("date"),
        F.coalesce(F.nullif(text("category"), F.lit("")), F.lit(DEFAULT_CATEGORY)).alias("category"),
        *[number(c).alias(c) for c in (
            "price", "cost", "competitor_price", "inventory", "units_sold",
            "is_weekend", "month", "seasonal_factor", "holiday",
        )],
    )))).where(
        (F.col("product_id") != "") & F.col("date").isNotNull()
        & F.col("price").isNotNull() & F.col("units_sold").isNotNull()
    )
    month = F.coalesce("month", F.month("date").cast("double"))
    return parsed.select(
        *(keep or []),
        "product_id", "date", "category", "price",
        F.coalesce("cost", F.col("price") * COST_SHARE).alias("cost"),
        F.coalesce("competitor_price", F.col("price") * COMPETITOR_SHARE).alias("competitor_price"),
        F.coalesce("inventory", F.lit(0.0)).alias("inventory"),
        "units_sold",
        F.coalesce((F.col("is_weekend") != 0).cast("int"), weekend_flag(F.col("date"))).alias("is_weekend"),
        month.cast("int").alias("month"),
        F.coalesce("seasonal_factor", seasonal_factor(month)).alias("seasonal_factor"),
        F.coalesce((F.col("holiday") != 0).cast("int"), holiday_flag(month, F.dayofmonth("date"))).alias("holiday"),
    )


def _fill_from(df: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """Replace NULL and NaN by the one-row ``values``, read as a scalar subquery."""
    value = values.select(F.struct(*columns)).scalar()
    filled = {}
    for c in columns:
        present = F.col(c)
        if df.schema[c].dataType.simpleString() == "double":
            present = F.when(~F.isnan(c), F.col(c))
        filled[c] = F.coalesce(present, value.getField(c))
    return df.withColumns(filled)


def column_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the exact median of each column."""
    medians = column_quantiles(df, columns, [0.5])
    return medians.agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns])


def column_modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the most frequent value of each column, the smallest one on ties."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    counted = (
        df.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count("*").alias("n"))
    )
    best = F.struct(-F.col("n"), F.col("value"))
    return counted.agg(*[
        F.min_by(F.when(F.col("column") == c, F.col("value")), F.when(F.col("column") == c, best)).alias(c)
        for c in columns
    ])


def median_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    return _fill_from(df, column_medians(df, columns), columns)


def mode_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    return _fill_from(df, column_modes(df, columns), columns)


def impute(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Numeric gaps by the median, categorical gaps by the mode."""
    if numeric:
        df = median_fill(df, numeric)
    return mode_fill(df, categorical) if categorical else df


def one_hot(df: DataFrame, column: str, max_levels: int = MAX_LEVELS) -> DataFrame:
    """Indicator columns for a categorical column, which is dropped when it is too wide.

    Only up to ``max_levels + 1`` level names come to the driver.
    """
    level = F.coalesce(F.col(column).cast("string"), F.lit(MISSING_LEVEL))
    levels = sorted(r[0] for r in df.select(level).distinct().limit(max_levels + 1).collect())
    if len(levels) > max_levels:
        return df.drop(column)
    return df.withColumns({f"{column}_{v}": (level == v).cast("double") for v in levels}).drop(column)


def drop_duplicates(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return df.dropDuplicates(keys)


def usable_rows(df: DataFrame, target: str) -> DataFrame:
    """What training would use: rows with a numeric target, and columns that vary.

    One row: row counts, constant columns, categorical columns with too many levels,
    and whether enough rows are left.
    """
    kinds = column_kinds(df)
    features = [c for c in df.columns if c != target]
    value = F.col(target).cast("string").try_cast("double")
    valid = df.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    stats = df.agg(F.count("*").alias("n_rows")).select("n_rows")
    spread = valid.agg(
        F.count("*").alias("rows_used"),
        F.array_compact(F.array(*[
            F.when(F.coalesce(F.min(c) == F.max(c), F.lit(True)), F.lit(c)) for c in features
        ])).alias("constant"),
    )
    wordy = [c for c in features if kinds[c] == "categorical"]
    wide = F.lit("")
    if wordy:
        pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in wordy]
        levels = (
            valid.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull()).distinct()
            .groupBy("column").agg(F.count("*").alias("levels")).where(F.col("levels") > MAX_LEVELS)
        )
        wide = levels.agg(F.array_join(F.sort_array(F.collect_list("column")), ",").alias("wide")).scalar()
    return spread.select(
        stats.scalar().alias("n_rows"),
        "rows_used",
        (stats.scalar() - F.col("rows_used")).alias("rows_dropped"),
        F.array_join(F.sort_array("constant"), ",").alias("constant_columns"),
        wide.alias("wide_columns"),
        (F.col("rows_used") >= MIN_TRAINING_ROWS).alias("enough_rows"),
    )


def leakage_scan(df: DataFrame, target: str) -> DataFrame:
    """Columns that give the target away, by name and by correlation.

    ``(column, corr, by_name, by_value)``; all correlations come from one aggregation.
    """
    columns = [c for c in numeric_columns(df) if c != target]
    found = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in columns])
    return found.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.col(c).alias("corr"),
            F.lit(spaced(c) in LEAKING_NAMES).alias("by_name"),
            F.coalesce(F.abs(F.col(c)) >= SUSPECT_CORRELATION, F.lit(False)).alias("by_value"),
        )
        for c in columns
    ])))


def split_features(df: DataFrame, target: str) -> tuple[list[str], list[str]]:
    """``(safe, leaked)`` column names; the leaked ones stay in the table as flagged."""
    leaked = [c for c in df.columns if c != target and spaced(c) in LEAKING_NAMES]
    return [c for c in df.columns if c != target and c not in leaked], leaked


def flag_leakage(df: DataFrame, target: str) -> DataFrame:
    """Mark every row with the leaked column names, or ``none``."""
    _, leaked = split_features(df, target)
    return df.withColumn("leakage_columns", F.lit(",".join(leaked) if leaked else "none"))
