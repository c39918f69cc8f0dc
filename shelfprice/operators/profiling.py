"""Dataset profile: missing values, duplicates, statistics, targets and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampType

from shelfprice.functions import cents, round_to
from shelfprice.operators.quantiles import QUARTILES, bracket_aggregates, quartiles_and_far, unpivot_numbers
from shelfprice.operators.staging import stage

# Column names treated as a price or a cost.
PRICE_COST_NAMES = (
    "price", "selling price", "unit price", "prc",
    "cost", "cogs", "unit cost", "product cost",
)
# Name parts that make a column a feature rather than a target.
FEATURE_NAME_PARTS = ("price", "cost", "competitor", "inventory")
MIN_TARGET_VALUES = 5
TARGET_ROLE_BOOST = 0.3
OUTLIER_IQRS = 3.0


def spaced(name: str) -> str:
    return name.lower().replace("_", " ")


def column_kinds(df: DataFrame) -> dict[str, str]:
    def kind(data_type) -> str:
        if isinstance(data_type, NumericType):
            return "numeric"
        if isinstance(data_type, (DateType, TimestampType)):
            return "datetime"
        return "categorical"

    return {field.name: kind(field.dataType) for field in df.schema.fields}


def numeric_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in column_kinds(df).items() if kind == "numeric"]


def _absent(df: DataFrame, name: str) -> Column:
    if df.schema[name].dataType.simpleString() in ("double", "float"):
        return F.col(name).isNull() | F.isnan(name)
    return F.col(name).isNull()


def profile_missing(df: DataFrame) -> DataFrame:
    """``(column, kind, n_rows, n_missing)`` from one aggregation over the table."""
    kinds = column_kinds(df)
    counts = df.agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(_absent(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)],
    )
    rows = [
        F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("kind"), F.col("n_rows"), F.col(f"m{i}").alias("n_missing"))
        for i, c in enumerate(df.columns)
    ]
    return counts.select(F.inline(F.array(*rows)))


def duplicate_count(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows, distinct rows and duplicates, over all columns or the given keys."""
    copies = df.groupBy(*(keys or df.columns)).agg(F.count("*").alias("n"))
    return copies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count("*").alias("distinct_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
    )


def basic_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Minimum, maximum, mean and count per numeric column, rounded to cents."""
    columns = columns or numeric_columns(df)
    total = df.agg(*[
        F.struct(
            F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"),
            F.avg(c).alias("mean"), F.count(c).alias("n"),
        ).alias(c)
        for c in columns
    ])
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.coalesce(cents(F.col(c)["low"]), F.lit(0.0)).alias("min"),
            F.coalesce(cents(F.col(c)["high"]), F.lit(0.0)).alias("max"),
            F.coalesce(cents(F.col(c)["mean"]), F.lit(0.0)).alias("avg"),
            F.col(c)["n"].alias("count"),
        )
        for c in columns
    ]
    return total.select(F.inline(F.array(*rows)))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact distinct values per numeric column; values are deduplicated before the shuffle."""
    return unpivot_numbers(df, columns).distinct().groupBy("column").agg(F.count("*").alias("cardinality"))


def target_candidates(df: DataFrame, units_role: str | None = None) -> DataFrame:
    """Numeric columns ranked by how well they would serve as a training target."""
    columns = numeric_columns(df)
    stats = df.agg(
        F.count("*").alias("n_rows"),
        *[F.struct(F.count(c).alias("n"), F.stddev_samp(c).alias("sd"), F.avg(c).alias("mean")).alias(c) for c in columns],
    )
    stats = stats.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.col("n_rows"), F.col(c)["n"].alias("n"),
            F.col(c)["sd"].alias("sd"), F.col(c)["mean"].alias("mean"),
            F.lit(-0.25 if any(p in spaced(c) for p in FEATURE_NAME_PARTS) else 0.0).alias("name_points"),
            F.lit(TARGET_ROLE_BOOST if c == units_role else 0.0).alias("boost"),
        )
        for c in columns
    ])))
    variation = F.coalesce(F.col("sd") / F.nullif(F.col("mean"), F.lit(0.0)), F.lit(0.0))
    spread = F.when(variation < 0.05, 0.15).when(variation < 0.5, 0.4).otherwise(0.55)
    values = F.when(F.col("cardinality") >= 100, 0.3).when(F.col("cardinality") >= 20, 0.2).otherwise(0.05)
    filled = F.when(F.col("n") > F.col("n_rows") * 0.9, 0.15).otherwise(0.0)
    score = F.when(variation < 1e-4, 0.0).otherwise(
        cents(F.greatest(spread + values + filled + F.col("name_points"), F.lit(0.0)))
    )
    return (
        stats.join(distinct_counts(df, columns), "column")
        .where((F.col("n") >= MIN_TARGET_VALUES) & (F.col("cardinality") >= MIN_TARGET_VALUES))
        .select("column", "cardinality", F.least(cents(score + F.col("boost")), F.lit(1.0)).alias("suitability"))
        .orderBy(F.desc("suitability"), "column")
    )


def iqr_outliers(df: DataFrame, columns: list[str] | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Quartiles and the number of values beyond three inter-quartile ranges."""
    return quartiles_and_far(df, columns or numeric_columns(df), OUTLIER_IQRS, stats)


def _count_text(count: Column) -> Column:
    return F.format_number(count, 0)


def _percent_text(share: Column) -> Column:
    return round_to(share * 100.0, 0).cast("bigint").cast("string")


def quality_issues(df: DataFrame) -> DataFrame:
    """One row per finding: ``(issue, penalty, bad_cells)``.

    The table is read three times: for all counts and sketches, for the ranks and far values, and for duplicates.
    """
    numeric = numeric_columns(df)
    priced = [c for c in numeric if spaced(c) in PRICE_COST_NAMES]
    others = [c for c in numeric if c not in priced]
    price = next((c for c in numeric if spaced(c) == "price"), None)
    cost = next((c for c in numeric if "cost" in spaced(c)), None)

    aggs = [F.count("*").alias("rows")]
    missing = sum((F.count_if(_absent(df, c)) for c in df.columns), F.lit(0))
    aggs.append(missing.alias("missing"))
    for i, c in enumerate(numeric):
        aggs += [F.count_if(F.col(c) < 0).alias(f"neg{i}"), F.count_if(F.col(c) <= 0).alias(f"zero{i}"),
                 (F.min(c) == F.max(c)).alias(f"const{i}")]
    if price and cost:
        aggs.append(F.count_if((F.col(price) > 0) & (F.col(cost) > 0) & (F.col(price) < F.col(cost))).alias("under"))
    stats = stage(df.agg(*aggs, *bracket_aggregates(others, QUARTILES)))  # one row
    rows = F.col("rows")

    found: list[Column] = []

    def finding(condition: Column, text: Column, penalty: int, bad: Column | None = None) -> None:
        found.append(F.when(condition, F.struct(
            text.alias("issue"), F.lit(penalty).alias("penalty"),
            (bad if bad is not None else F.lit(0)).cast("bigint").alias("bad_cells"),
        )))

    share = F.coalesce(F.col("missing") / F.nullif(rows * F.lit(len(df.columns)), F.lit(0)), F.lit(0.0))
    finding(share > 0.2, F.concat(_percent_text(share), F.lit("% of all cells are missing")), 25)
    finding((share > 0.05) & (share <= 0.2), F.concat(_percent_text(share), F.lit("% of cells are missing")), 8)
    finding(rows < 50, F.concat(F.lit("only "), _count_text(rows), F.lit(" rows")), 20)
    finding((rows >= 50) & (rows < 200), F.concat(_count_text(rows), F.lit(" rows are few")), 8)
    finding(F.lit(not numeric), F.lit("no numeric columns"), 40)
    for i, c in enumerate(numeric):
        if c in priced:
            neg, zero = F.col(f"neg{i}"), F.col(f"zero{i}")
            finding(neg > 0, F.concat(F.lit(f"{c}: "), _count_text(neg), F.lit(" negative values")), 10, neg)
            if "price" in spaced(c) and "competitor" not in spaced(c):
                finding(zero > 0, F.concat(F.lit(f"{c}: "), _count_text(zero), F.lit(" zero or negative prices")), 5, zero)
        finding(F.coalesce(F.col(f"const{i}"), F.lit(False)), F.lit(f"{c}: constant"), 3)
    if price and cost:
        finding(F.col("under") > 0, F.concat(_count_text(F.col("under")), F.lit(" rows priced below cost")), 8)
    issues = stats.select(F.inline(F.array_compact(F.array(*found))))

    copies = duplicate_count(df)
    share = F.col("duplicates") / F.nullif(F.col("n_rows"), F.lit(0))
    issues = issues.unionByName(copies.where(F.col("duplicates") > 0).select(
        F.concat(_count_text(F.col("duplicates")), F.lit(" duplicate rows")).alias("issue"),
        F.when(share > 0.1, 10).otherwise(3).alias("penalty"), F.lit(0).cast("bigint").alias("bad_cells"),
    ))
    if others:
        issues = issues.unionByName(iqr_outliers(df, others, stats).where(F.col("outliers") > 0).select(
            F.concat(F.col("column"), F.lit(": "), _count_text(F.col("outliers")), F.lit(" extreme outliers")).alias("issue"),
            F.lit(4).alias("penalty"), F.col("outliers").alias("bad_cells"),
        ))
    return issues


def quality_score(df: DataFrame) -> DataFrame:
    """Score from 0 to 100 with its label and the sorted findings behind it."""
    score = F.greatest(F.lit(100) - F.coalesce(F.sum("penalty"), F.lit(0)), F.lit(0))
    summary = quality_issues(df).agg(
        score.cast("int").alias("score"),
        F.coalesce(F.sum("bad_cells"), F.lit(0)).alias("bad_cells"),
        F.sort_array(F.collect_list("issue")).alias("issues"),
    )
    label = (
        F.when(F.col("score") >= 85, "Excellent").when(F.col("score") >= 70, "Good")
        .when(F.col("score") >= 50, "Fair").otherwise("Poor")
    )
    return summary.withColumn("label", label)


def latest_sample(df: DataFrame, roles: dict[str, str | None], order: list[str], n: int = 500) -> DataFrame:
    """The ``n`` latest rows (20 to 2,000) with the role columns and the first date column."""
    if not 20 <= n <= 2000:
        raise ValueError("a sample has 20 to 2,000 rows")
    keep = [c for c in roles.values() if c]
    dated = next((c for c in df.columns if "date" in c.lower() and c not in keep), None)
    keep = [c for c in df.columns if c in keep or c == dated]
    finite = [
        F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c)
        if df.schema[c].dataType.simpleString() == "double" else F.col(c)
        for c in keep
    ]
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).select(*finite)


def preview(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)


def profile_summary(df: DataFrame) -> DataFrame:
    """Rows, columns per kind, missing cells and duplicates in one row."""
    kinds = list(column_kinds(df).values())
    cells = profile_missing(df).agg(F.sum("n_missing").alias("total_missing"))
    return duplicate_count(df).select(
        F.col("n_rows"),
        F.lit(len(kinds)).alias("n_columns"),
        F.lit(kinds.count("numeric")).alias("numeric_columns"),
        F.lit(kinds.count("categorical")).alias("categorical_columns"),
        F.lit(kinds.count("datetime")).alias("datetime_columns"),
        cells.scalar().alias("total_missing"),
        F.col("duplicates"),
    )
