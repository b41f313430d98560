"""Trace lines as a stream: deduplicated spans, sessions and late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.sources.otlp import spans


def span_stream(spark: SparkSession, folder: str, delay: str = "10 minutes", max_files: int = 100) -> DataFrame:
    """Spans of OTLP JSON lines that arrive in ``folder``, each once within ``delay``."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(folder)
    flat = spans(lines.select(F.lit(folder).alias("file"), F.col("value").alias("text"))).withColumn("started_at", F.timestamp_micros(F.expr("start_unix_nano div 1000")))
    return flat.withWatermark("started_at", delay).dropDuplicatesWithinWatermark(["trace_id", "span_id"])


def boundary_counts(stream: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Spans and errors per window, boundary and kind; late spans beyond the watermark are dropped."""
    return stream.groupBy(F.window("started_at", window), "boundary", "kind").agg(F.count("*").alias("spans"), F.count_if(F.col("status_code") == "ERROR").alias("errors"))


def sessions(stream: DataFrame, user_key: str, gap: str = "30 minutes") -> DataFrame:
    """Session windows per value of an attribute."""
    user = F.try_element_at("attrs", F.lit(user_key))
    return stream.where(user.isNotNull()).groupBy(F.session_window("started_at", gap), user.alias("user")).agg(F.count("*").alias("spans"))
