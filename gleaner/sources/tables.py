"""Readers for the columnar tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Plain scan; filters and column selection reach the Parquet reader."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


SPREAD = "spark.gleaner.scan.partitions"


def spread(df: DataFrame) -> DataFrame:
    """One round-robin exchange after a scan, only where the session asks for it with ``SPREAD`` (off on clusters).

    Tests and the benchmark read files of a single row group, whose heavy text rules would run in one task.
    """
    wanted = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(wanted)) if wanted else df
