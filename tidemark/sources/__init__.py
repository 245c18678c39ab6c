"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder; column pruning and filters reach its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
