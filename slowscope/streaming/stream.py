"""Streaming reads: new log files in a folder, or files that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slowscope.operators import entries
from slowscope.sources import slowlog


def stream_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """Entries of log files as they appear in a folder (rotated logs).  options: those of entries.parse."""
    lines = spark.readStream.option("lineSep", slowlog.SEPARATOR).text(path)
    return entries.parse(lines.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("record")), **options)


def stream_tail(spark: SparkSession, path: str, **options) -> DataFrame:
    """Entries of logs that grow, each once its statement has ended."""
    slowlog.register(spark)
    return entries.parse(spark.readStream.format("slowlog").option("path", path).load(), **options)


def type_counts_by_window(stream: DataFrame, *, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by statement type in tumbling windows of the log time; late entries wait for the watermark."""
    own = stream.withWatermark("log_time", late)
    return own.groupBy(F.window("log_time", every).alias("window"), F.coalesce("sql_type", F.lit("NULL")).alias("sql_type")).count()
