"""Scans of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.session import utc


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over as many tasks as there are cores, if its scan has fewer.

    A file of one row group is one task however much work its rows are. Scans that have enough tasks, as those of any
    large table, aren't moved. ``keys`` should tell rows apart, so that no task gets more than its share.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
