"""Chunk folders as a stream: an extension, results are those of the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def chunk_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def volumes(voxels: DataFrame) -> DataFrame:
    """Running volume of each label; use with the update or complete mode."""
    return voxels.groupBy("brain", "label").agg(F.count("*").alias("volume"))
