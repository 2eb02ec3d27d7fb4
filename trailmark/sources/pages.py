"""Stored pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows with long text; the session's `spark.sql.files.maxPartitionBytes` says how finely they are split."""
    return spark.read.parquet(path)
