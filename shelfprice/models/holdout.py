"""Train and test rows by a hash of their key, and metrics of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: keys whose hash starts below this hexadecimal byte are test rows (51 of 256).
TEST_BELOW = "33"
# Where the second and later of five folds start in the next byte.
FOLD_STARTS = ("33", "66", "99", "cc")


def is_test(*keys: str) -> Column:
    """True for about a fifth of the keys, whatever the partitioning or order of the rows."""
    return F.substring(F.md5(F.concat_ws("-", *keys)), 1, 2) < TEST_BELOW


def fold(folds: int, *keys: str) -> Column:
    """Cross-validation fold of a key, from 0 to ``folds - 1``."""
    return F.pmod(F.xxhash64(*keys), F.lit(folds)).cast("int")


def even_fold(*keys: str) -> Column:
    """One of five folds from the second byte of a key's hash, which the hold-out does not use."""
    byte = F.substring(F.md5(F.concat_ws("-", *keys)), 3, 2)
    return sum(((byte >= start).cast("int") for start in FOLD_STARTS), F.lit(0))


def regression_metrics(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """R², MAE and RMSE of a scored table in one aggregation."""
    error = F.col(label) - F.col(prediction)
    return scored.agg(
        F.count("*").alias("n_rows"),
        (F.lit(1.0) - F.avg(error * error) / F.nullif(F.var_pop(label), F.lit(0.0))).alias("r2"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
    )


def line_baseline(rows: DataFrame, feature: str, label: str, *keys: str) -> DataFrame:
    """Hold-out rows with the prediction of a straight line fitted on the training rows."""
    marked = rows.withColumn("is_test", is_test(*keys))
    line = marked.where(~F.col("is_test")).agg(F.struct(
        F.regr_slope(label, feature).alias("slope"), F.regr_intercept(label, feature).alias("level")
    )).scalar()
    predicted = line.getField("level") + line.getField("slope") * F.col(feature)
    return marked.where("is_test").withColumn("predicted", predicted)
