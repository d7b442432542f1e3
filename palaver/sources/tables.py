"""Scans of stored canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palaver import schema


def messages(spark: SparkSession, path: str) -> DataFrame:
    """All channels at once; selection by channel or month becomes a pushed-down filter."""
    return spark.read.parquet(path)


def replies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.SNAPSHOTS).parquet(path)
