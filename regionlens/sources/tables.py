"""Parquet table access by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


def load(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Read ``<base>/<name>.parquet``; projections and filters reach the scan."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")
