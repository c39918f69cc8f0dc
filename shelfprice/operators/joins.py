"""Many-to-one joins that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than this share of the rows, so at most
# 1 / HOT_SHARE keys are hot. The sketch tracks ten times as many.
HOT_SHARE = 1e-3
SKETCH_ITEMS = 10_000
SPREAD = 64


def fits_broadcast(df: DataFrame) -> bool:
    """True when Spark's own size estimate is within the broadcast threshold."""
    spark = df.sparkSession
    limit = int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 0 <= size <= limit


def lookup(rows: DataFrame, dimension: DataFrame, key: str, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """Join ``rows`` to a table that is unique by ``key``.

    A dimension within the broadcast threshold is broadcast, which moves no rows.
    Any larger one is joined by shuffle, with the hot keys of ``rows`` spread over
    ``SPREAD`` sub-keys and the matching dimension rows repeated once per sub-key. Where ``rows`` come from a
    join themselves, ``counted`` names a table with nearly the same keys to find the hot ones in without it.
    """
    if how not in ("inner", "left"):
        raise ValueError("lookup supports inner and left joins")
    if fits_broadcast(dimension):
        return rows.join(F.broadcast(dimension), key, how)
    return spread_lookup(rows, dimension, key, how, counted)


def hot_keys(rows: DataFrame, key: str) -> list:
    """The keys that hold more than ``HOT_SHARE`` of the rows, from a frequent-items sketch.

    One pass over the key column without a shuffle. The list decides only how rows are
    spread, never which rows match, so a sketch is exact enough.
    """
    most = int(1 / HOT_SHARE)
    seen = rows.agg(F.expr(f"approx_top_k(`{key}`, {most}, {SKETCH_ITEMS})").alias("top"), F.count(key).alias("n")).first()
    return [entry["item"] for entry in seen["top"] if entry["count"] > seen["n"] * HOT_SHARE]


def spread_lookup(rows: DataFrame, dimension: DataFrame, key: str, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """The shuffled form of :func:`lookup`; the result is the same as a plain join.

    Rows without a key match nothing and are spread as well.
    """
    hot = F.col(key).isin(hot_keys(rows if counted is None else counted, key))
    place = F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD)).cast("int")
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    left = rows.withColumn("_salt", F.when(hot | F.col(key).isNull(), place).otherwise(0))
    right = dimension.withColumn("_salt", F.explode(copies))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def rollup_through(rows: DataFrame, dimension: DataFrame, key: str, by: list[str], sums: dict) -> DataFrame:
    """Totals of ``rows`` by attributes that live in ``dimension``.

    Rows are summed per ``key`` first, so the join sees one row per key however
    unevenly the rows are spread, and the shuffle carries totals, not rows. Besides
    ``sums`` the result has ``n_rows``.
    """
    per_key = rows.groupBy(key).agg(
        F.count("*").alias("n_rows"), *[F.sum(value).alias(name) for name, value in sums.items()]
    )
    return per_key.join(dimension, key).groupBy(*by).agg(
        *[F.sum(name).alias(name) for name in ["n_rows", *sums]]
    )
