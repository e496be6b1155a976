"""Readers for the engine's own Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table ``name`` stored as ``<base>/<name>.parquet`` (a file or a folder)."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")
