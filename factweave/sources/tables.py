"""Reading the parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` (one file or a folder of parts) below ``folder``."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
