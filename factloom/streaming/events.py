"""Streaming forms of the matching and merging operators, over any stream of rows with an event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.joins import first_literal_match


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, with the schema of what is there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """events with a watermark; event times without a zone are taken in the session's."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def matched_counts(events: DataFrame, column: str, patterns: list[tuple[str, str]], time: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of the first pattern that matches, by tumbling window; rows later than `late` are left out."""
    matched = first_literal_match(timed(events, time, late), column, patterns)
    counted = matched.groupBy(F.window(time, window), "match").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), "match", "n")


def distinct_rows(events: DataFrame, key: list[str], time: str = "ts", late: str = "2 hours") -> DataFrame:
    """The first row of each key within the watermark."""
    return timed(events, time, late).dropDuplicatesWithinWatermark(key)


def sessions(events: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Session windows of each key with counts."""
    grouped = timed(events, time, late).groupBy(F.session_window(time, gap).alias("s"), key)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
