"""Exact percentiles that never gather a column or a large group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfprice.operators.staging import stage

# Below this many values the whole range is searched; above it, only a bracket
# around the percentile that is wide enough for the sketch's rank error.
WHOLE_RANGE = 100_000
SKETCH_ACCURACY = 10_000
BRACKET = 4.0 / SKETCH_ACCURACY
CELLS = 1024
QUARTILES = [0.25, 0.75]


def _number(name: str):
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def unpivot_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value)`` for every non-null number, without a shuffle."""
    pairs = [F.struct(F.lit(c).alias("column"), _number(c).alias("value")) for c in columns]
    return df.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull())


def bracket_aggregates(columns: list[str], probs: list[float]) -> list[Column]:
    """Aggregates ``s0``, ``s1``, ... that ``brackets_of`` reads, to be computed beside others in one pass."""
    edges = [F.lit(min(max(p + side * BRACKET, 0.0), 1.0)) for p in probs for side in (-1, 1)]
    return [
        F.struct(
            F.count(_number(c)).alias("n"), F.min(_number(c)).alias("low"), F.max(_number(c)).alias("high"),
            F.percentile_approx(_number(c), F.array(*edges), SKETCH_ACCURACY).alias("edges"),
        ).alias(f"s{i}")
        for i, c in enumerate(columns)
    ]


def brackets_of(stats: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """One row per column and probability: value count and the bracket to search."""
    rows = []
    for i, c in enumerate(columns):
        stat = F.col(f"s{i}")
        whole = stat["n"] < WHOLE_RANGE
        for k, p in enumerate(probs):
            rows.append(F.struct(
                F.lit(c).alias("column"), F.lit(float(p)).alias("prob"), stat["n"].alias("n"),
                F.when(whole, stat["low"]).otherwise(stat["edges"][2 * k]).alias("low"),
                F.when(whole, stat["high"]).otherwise(stat["edges"][2 * k + 1]).alias("high"),
            ))
    return stats.select(F.inline(F.array(*rows)))


def _brackets(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    return brackets_of(df.agg(*bracket_aggregates(columns, probs)), columns, probs)


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """Interpolated percentiles per column: ``(column, prob, n, value)``.

    A mergeable sketch brackets each percentile; rows under the bracket are only
    counted, rows inside it are counted per value and per grid cell, and one grid
    cell is finally ranked. What reaches a single task is a cell, not the column.
    """
    return _ranked(_counted(df, columns, _brackets(df, columns, probs)))


def _counted(df: DataFrame, columns: list[str], brackets: DataFrame, also: Column | None = None) -> DataFrame:
    """Values under each bracket and per value inside it, and per value for the rows that ``also`` takes."""
    # values under the bracket are counted at its lower end, so both uses of the counts
    # in _ranked are the same aggregation and Spark runs it once
    wanted = F.col("value") <= F.col("high")
    inside = (
        unpivot_numbers(df, columns).join(F.broadcast(brackets), "column")  # a few rows per column
        .where(wanted if also is None else F.coalesce(also, wanted))
        .withColumn("spot", F.greatest("value", "low"))
    )
    under = F.col("value") < F.col("low")
    return inside.groupBy("column", "prob", "n", "low", "high", "spot").agg(
        F.count_if(under).alias("below"), F.count_if(~under).alias("cnt")
    )


def _ranked(counted: DataFrame) -> DataFrame:
    """The percentiles of what ``_counted`` counted."""
    position = F.col("prob") * (F.col("n") - 1)
    width = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    cell = F.coalesce(F.least(F.floor((F.col("spot") - F.col("low")) / width * CELLS), F.lit(CELLS - 1)), F.lit(0))
    counted = counted.withColumns({
        "cell": cell, "first_rank": F.floor(position), "last_rank": F.ceil(position), "part": position - F.floor(position),
    })
    by_cell = Window.partitionBy("column", "prob").orderBy("cell")  # CELLS rows at most
    wanted = (
        counted.groupBy("column", "prob", "cell", "first_rank", "last_rank")
        .agg(F.sum("cnt").alias("size"), F.sum("below").alias("below"))
        .withColumn("size", F.col("size") + F.col("below"))
        .withColumn("before", F.sum("size").over(by_cell) - F.col("size"))
        .where((F.col("before") <= F.col("last_rank")) & (F.col("before") + F.col("size") > F.col("first_rank")))
        .select("column", "prob", "cell", "before")
    )
    by_value = Window.partitionBy("column", "prob", "cell").orderBy("spot")
    ranked = (
        counted.join(F.broadcast(wanted), ["column", "prob", "cell"])  # the few cells that hold a rank
        .withColumn("start", F.col("before") + F.sum(F.col("below") + F.col("cnt")).over(by_value) - F.col("cnt"))
    )

    def at(rank: str):
        holds = (F.col("start") <= F.col(rank)) & (F.col(rank) < F.col("start") + F.col("cnt"))
        return F.max(F.when(holds, F.col("spot")))

    found = ranked.groupBy("column", "prob", "n", "part").agg(at("first_rank").alias("v0"), at("last_rank").alias("v1"))
    missed = F.col("v0").isNull() | F.col("v1").isNull()
    value = F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("part")
    return found.select(
        "column", "prob", "n",
        F.when(missed, F.raise_error(F.concat(F.lit("no value at the rank of a percentile of "), F.col("column"))).cast("double"))
        .otherwise(value).alias("value"))


def quartiles_and_far(df: DataFrame, columns: list[str], reach: float, stats: DataFrame | None = None) -> DataFrame:
    """Quartiles per column and the values more than ``reach`` inter-quartile ranges outside.

    ``(column, q1, q3, iqr, outliers)``; none lies outside where the range is 0. The table is read
    twice: once for the sketch (not at all if ``stats`` holds its ``bracket_aggregates``), which bounds the
    quartiles and so how near a value must be to be surely inside, and once to count the others.
    """
    found = stage(df.agg(*bracket_aggregates(columns, QUARTILES))) if stats is None else stats
    brackets = brackets_of(found, columns, QUARTILES)
    ends = brackets.groupBy("column").agg(
        F.max("n").alias("n"),
        F.max(F.when(F.col("prob") == QUARTILES[0], F.col("high"))).alias("q1_most"),
        F.max(F.when(F.col("prob") == QUARTILES[1], F.col("low"))).alias("q3_least"))
    surely = F.greatest(F.col("q3_least") - F.col("q1_most"), F.lit(0.0)) * reach
    nothing = F.lit(None).cast("double")
    search = brackets.select("*", nothing.alias("inner_low"), nothing.alias("inner_high")).unionByName(ends.select(
        "column", nothing.alias("prob"), "n", F.lit(float("-inf")).alias("low"), nothing.alias("high"),
        (F.col("q1_most") - surely).alias("inner_low"), (F.col("q3_least") + surely).alias("inner_high")))
    far = F.when(F.col("prob").isNull(), (F.col("value") < F.col("inner_low")) | (F.col("value") > F.col("inner_high")))
    counted = stage(_counted(df, columns, search, far))
    quartiles = _ranked(counted.where("prob is not null")).groupBy("column").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name) for p, name in zip(QUARTILES, ("q1", "q3"), strict=True)
    ]).withColumn("iqr", F.col("q3") - F.col("q1"))
    beyond = (F.col("spot") < F.col("q1") - F.col("iqr") * reach) | (F.col("spot") > F.col("q3") + F.col("iqr") * reach)
    outside = (
        counted.where("prob is null").join(F.broadcast(quartiles), "column").where(beyond & (F.col("iqr") > 0))  # a row per column
        .groupBy("column").agg(F.sum("cnt").alias("outside"))
    )
    return quartiles.join(F.broadcast(outside), "column", "left").select(
        "column", "q1", "q3", "iqr", F.coalesce("outside", F.lit(0)).alias("outliers"))


def group_medians(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Exact median of each column per group, for columns with a bounded value domain.

    Money in cents and stock counts repeat: rows are first counted per (group,
    value), which spreads a hot group over its values and combines map-side. The
    running count then sorts the distinct values of a group, not its rows.
    """
    pairs = [F.struct(F.lit(c).alias("field"), _number(c).alias("value")) for c in columns]
    counted = (
        df.select(*keys, F.inline(F.array(*pairs))).where(F.col("value").isNotNull())
        .groupBy(*keys, "field", "value").agg(F.count("*").alias("cnt"))
    )
    group = Window.partitionBy(*keys, "field")
    ranked = counted.withColumns({
        "end": F.sum("cnt").over(group.orderBy("value")), "n": F.sum("cnt").over(group),
    })
    start = F.col("end") - F.col("cnt")
    middles = [F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)]
    low, high = (F.when((start <= m) & (m < F.col("end")), F.col("value")) for m in middles)
    picked = ranked.select(*keys, "field", low.alias("low"), high.alias("high")).where("low is not null or high is not null")
    return picked.groupBy(*keys).agg(*[
        ((F.max(F.when(F.col("field") == c, F.col("low"))) + F.max(F.when(F.col("field") == c, F.col("high")))) / 2).alias(c)
        for c in columns
    ])
