"""Rolling metrics of a comment stream by event time, with late rows up to a delay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions import bands, numbers

WIDTHS = {"minute": "1 minute", "hour": "1 hour", "day": "24 hours"}


def rolling(comments: DataFrame, width: str = "minute", delay: str = "10 minutes", per_event: bool = True,
            slide: str | None = None) -> DataFrame:
    """Per window (and event): comments, likes, score sum and scored rows, bands. Works on batch and stream; the
    mean is avg_sentiment = exact sum / count. Partial sums form before the shuffle, so a hot event is one row
    per task."""
    stamp = F.col("publish_time").cast("timestamp")
    rows = comments.withColumn("publish_time", stamp)
    if comments.isStreaming:
        rows = rows.withWatermark("publish_time", delay)
    window = F.window("publish_time", WIDTHS[width], slide) if slide else F.window("publish_time", WIDTHS[width])
    keys = [window, F.col("event_id")] if per_event else [window]
    score = F.col("sentiment_score").cast("decimal(4,3)")
    grouped = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("like_count", F.lit(0))).alias("likes"),
        F.sum(numbers.wide_score(score)).alias("_sum"), F.count(score).alias("_scored"), *bands.counts(score))
    mean = F.try_divide(F.col("_sum").cast("double"), F.col("_scored").cast("double"))
    start = F.date_format(F.col("window.start"), "yyyy-MM-dd HH:mm").alias("start")
    return grouped.select(start, *(["event_id"] if per_event else []), "n", "likes",
                          F.round(mean, 6).alias("avg_sentiment"), "positive_count", "neutral_count", "negative_count")


def start_rolling(comments: DataFrame, folder: str, checkpoint: str, available_now: bool = False,
                  trigger: str = "5 seconds", **options):
    """Writes every window once, when the delay has passed over it."""
    writer = (rolling(comments, **options).writeStream.outputMode("append").format("parquet")
              .option("path", folder).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    return writer.start()


def late_rows(query) -> int:
    """Rows that came after the delay had passed over their window and were left out, as far as the query's recent
    progress tells. The delay is an argument of rolling and of decode.distinct_stream."""
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)
