"""Parquet table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` below ``sf_dir``; any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
