"""The log parser as a stream: text in, batched Parquet out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.loglines import parse_lines, without_table_art


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.format("text").load(folder).withColumnRenamed("value", "message")


def write(lines: DataFrame, folder: str, checkpoint: str, every: str = "60 seconds", once: bool = False) -> StreamingQuery:
    """Parsed lines, without table art, in batches of ``every``."""
    writer = without_table_art(parse_lines(lines)).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start(folder)
