"""Partition layout of inputs, and the store a path lies in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` when the source has fewer splits than the cluster has cores.

    A gzip file or a Parquet file of one row group is a single split, and every expression over it
    would run in one task. An input that already has enough splits is left as it is, without a shuffle.
    The keys make the placement repeatable when a lost task is run again.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Spark's own file layer, for folders on any store it knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where
