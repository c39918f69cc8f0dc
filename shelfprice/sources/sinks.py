"""Writers for result tables, reports and fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "error") -> str:
    df.write.mode(mode).option("escape", '"').csv(path, header=True)
    return path


def write_json(df: DataFrame, path: str, mode: str = "error") -> str:
    df.write.mode(mode).json(path)
    return path


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "error") -> str:
    """Parquet table; rows are clustered by the partition columns to keep files few.

    Clustering is a rebalance, not a hash by key: a partition value holding most of
    the rows is split over several tasks and files.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
        df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)
    return path


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
