"""Incremental ingest of landed files: everything new since the last run, exactly once, then stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lawmill.operators.segments import clauses


def clause_stream(spark: SparkSession, landing: str) -> DataFrame:
    """Clauses of markdown files as they land: file, article, chapter, body, line. No state, so late files are fine."""
    texts = spark.readStream.text(landing, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return clauses(texts, "text")


def ingest_available(spark: SparkSession, landing: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append the clauses of files not seen before to a parquet table; the checkpoint remembers what was seen."""
    query = clause_stream(spark, landing).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def event_windows(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts and sums per event type and tumbling window of event time, closed `late` after the newest event."""
    w = F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
