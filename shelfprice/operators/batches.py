"""Statistics kept per batch of rows, so that a refit reads new rows only.

A folder holds one partition per batch. Putting a batch again replaces it, so a load that was cut
off can be repeated; removing one takes its rows out of every later result. What is kept must
merge: counts, moments, sums of products, extremes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Batches:
    """The statistics of the batches in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")

    def _path(self, batch: str):
        if not batch or any(c in batch for c in "/=\\"):
            raise ValueError(f"not a name of a batch: {batch!r}")
        path = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/batch={batch}")
        return path, path.getFileSystem(self._spark._jsc.hadoopConfiguration())

    def put(self, batch: str, statistics: DataFrame) -> None:
        path, _ = self._path(batch)
        statistics.write.mode("overwrite").parquet(path.toString())

    def put_each(self, statistics: DataFrame, by: str) -> None:
        """One batch per value of ``by``, all in one pass; other batches stay."""
        named = statistics.withColumn("batch", F.col(by).cast("string")).drop(by)
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self._folder)

    def remove(self, batch: str) -> bool:
        """False if there is no such batch."""
        path, files = self._path(batch)
        return files.delete(path, True)

    def read(self) -> DataFrame:
        """All statistics with the name of their ``batch``."""
        found = self._spark.read.parquet(self._folder)
        return found.withColumn("batch", F.col("batch").cast("string"))
