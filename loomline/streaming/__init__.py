"""Streaming ingest of judges' answers: an extension beside the batch cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def fresh_answers(answers: DataFrame, late: str = "1 hour") -> DataFrame:
    """Usable answers of a stream, the first of each request within the watermark."""
    good = answers.filter(F.col("error").isNull() & F.col("request_hash").isNotNull())
    return good.withWatermark("received", late).dropDuplicatesWithinWatermark(["request_hash"])


def ingest(answers: DataFrame, cache_path: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Append ``fresh_answers`` to a Parquet cache; exactly once by the stream's checkpoint."""
    return fresh_answers(answers, late).writeStream.format("parquet").option("path", cache_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def answer_rates(answers: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Answers and failures per model and tumbling window."""
    w = answers.withWatermark("received", late).groupBy(F.window("received", window), "model")
    return w.agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("failed")).select("window.start", "model", "n", "failed")
