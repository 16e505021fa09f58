"""The sensor feed as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from millwatch.schemas import TABLES, WATERMARK


def read_sensor_stream(
    spark: SparkSession,
    path: str,
    source: str = "json",
    schema: StructType | None = None,
    watermark: str = WATERMARK,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Readings as files arrive, watermarked on their own time."""
    reader = spark.readStream.schema(schema or TABLES["sensor_readings"]).format(source)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return event_time(reader.load(path), "timestamp", watermark)


def event_time(stream: DataFrame, column: str, watermark: str = WATERMARK) -> DataFrame:
    """Watermarks need a zoned timestamp, so zone-less ones are read in the session zone."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, watermark)
