"""Reading the crawl tables and the corpus from a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One Parquet table; with columns given, only these are read."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """A scan's rows over all cores: a table of fewer files than cores is dealt out, any other is left as it lies, without a shuffle.

    For stages whose work is far dearer than moving their input once; only for scans, as the number of partitions of anything
    else is known after it has run.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
