"""Parquet readers of the engine's tables: one folder, one parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The stored table, all columns; callers select early so that the scan reads only what they use."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
