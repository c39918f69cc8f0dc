"""Intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shelfprice.session import scratch_dir


def spread(scan: DataFrame) -> DataFrame:
    """Share out a scan that has fewer splits than there are cores.

    A small file in one row group is read by one task, which would then do all the
    work per row. Inputs with enough splits are left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def by_key(rows: DataFrame, key: str, tasks: int = 0) -> DataFrame:
    """``rows`` dealt by ``key`` to more tasks than a shuffle has, and to ``tasks`` at least.

    Adaptive execution merges the partitions of a small shuffle. These stay as they are, for work that
    makes many rows of one or holds much per row: their number is never that of a shuffle, which Spark would
    put in their place.
    """
    spark = rows.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(max(least + 1, tasks), key)


def _folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/stages-{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_stages(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once nothing that reads them is needed any more."""
    delete(spark, _folder(spark))


def new_path(spark: SparkSession) -> str:
    """A path of the shared folder that nothing has used yet, deleted with the stages of the application."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For a result that several parts of one plan need: it is computed once, survives
    the loss of executors, and its size is known to the joins that follow. The tables of an
    application share a folder, which ``clear_stages`` deletes.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
