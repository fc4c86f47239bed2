"""Incremental landing of documents as a stream: an extension of the batch sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def landed(spark: SparkSession, path: str, schema: str, key: str = "id", at: str = "fetched_at", late: str = "1 day") -> DataFrame:
    """New files of a folder, each key once within the watermark."""
    rows = spark.readStream.schema(schema).json(path)
    return rows.where(f"{key} is not null").withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def land(rows: DataFrame, path: str, checkpoint: str):
    """Write what is there and stop; the next call goes on from here."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
