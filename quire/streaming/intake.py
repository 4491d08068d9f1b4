"""An extension of batch intake: new JSONL records as a stream, each digest once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def intake(spark: SparkSession, directory: str, schema: str = "path string, sha256 string, seen timestamp", late: str = "1 hour") -> DataFrame:
    """Records of JSONL files as they appear, the first of each digest within the watermark.

    State is bounded by the watermark; a digest that comes again after it passes again.
    """
    return spark.readStream.schema(schema).json(directory).withWatermark("seen", late).dropDuplicatesWithinWatermark(["sha256"])
