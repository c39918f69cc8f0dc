"""Customer segments by K-means, named in order of spend."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfprice.operators.deals import loyalty_tier

# Inputs, and segment names from low to high spend.
SEGMENT_FEATURES = ["loyalty_score", "purchase_count", "avg_sales"]
SEGMENT_NAMES = ("Bargain seeker", "Regular", "Loyal", "Premium")


def fit_segments(customers: DataFrame, seed: int = 42) -> PipelineModel:
    stages = [
        VectorAssembler(inputCols=SEGMENT_FEATURES, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="scaled", withMean=True, withStd=True),
        KMeans(featuresCol="scaled", predictionCol="cluster", k=len(SEGMENT_NAMES), seed=seed),
    ]
    return Pipeline(stages=stages).fit(customers)


def segment(customers: DataFrame, model: PipelineModel | None = None) -> DataFrame:
    """Customers with segment number (0 spends least), segment name and loyalty tier."""
    model = model or fit_segments(customers)
    spend = SEGMENT_FEATURES.index("avg_sales")
    centres = model.stages[-1].clusterCenters()
    order = sorted(range(len(centres)), key=lambda i: centres[i][spend])
    rank = F.array(*[F.lit(order.index(i)) for i in range(len(centres))])
    names = F.array(*[F.lit(n) for n in SEGMENT_NAMES])
    return (
        model.transform(customers)
        .withColumn("segment", F.element_at(rank, F.col("cluster") + 1))
        .withColumns({"segment_label": F.element_at(names, F.col("segment") + 1), "loyalty_tier": loyalty_tier(F.col("loyalty_score"))})
        .drop("raw_features", "scaled", "cluster")
    )


def segment_counts(segmented: DataFrame) -> DataFrame:
    return segmented.groupBy("segment", "segment_label").agg(F.count("*").alias("customers"))
