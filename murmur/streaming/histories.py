"""Histories kept up by the comment stream.

Each batch leaves signed changes by event and hour (ingest.history_changes), and tables.read_history adds them up. The
reports below read that table only, whose size follows the events and hours and not the comments, and give what the
operators of the same kind in `metrics` give for all comments. A window is one of whole days.

Defined results: a comment counts in the hour it was first published in, with its last score and likes; comments without
a publication time are in no history; a missing score counts as 0.5 where the report over comments does so, else it is
left out; without rows a history is empty.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import times
from murmur.operators import metrics

NEUTRAL = 0.5


def _mean(total: Column, n: Column, digits: int) -> Column:
    return F.round(F.try_divide(total.cast("double"), n.cast("double")), digits)


def within(history: DataFrame, first=None, last=None) -> DataFrame:
    """The hours of the days from first to last, both included."""
    rows = history.filter(F.col("hour").isNotNull())
    if first is not None:
        rows = rows.filter(F.col("hour") >= times.moment(times.as_datetime(first).date()))
    if last is not None:
        rows = rows.filter(F.col("hour") < times.moment(times.as_datetime(last).date() + dt.timedelta(days=1)))
    return rows


def hourly(history: DataFrame, first=None, last=None, digits: int = 3) -> DataFrame:
    """(hour, avg_sentiment, spread) as metrics.hourly_history."""
    filled = F.sum("total") + F.sum(F.col("n") - F.col("scored")).cast("decimal(18,0)") * F.lit(NEUTRAL).cast("decimal(2,1)")
    return within(history, first, last).groupBy(times.hour_label(F.col("hour")).alias("hour")).agg(
        _mean(filled, F.sum("n"), digits).alias("avg_sentiment"), F.sum(F.col("n") + F.col("likes")).alias("spread"))


def daily(history: DataFrame, first=None, last=None, digits: int = 6) -> DataFrame:
    """(date, avg_sentiment, comment_count) of the comments with a score, as metrics.daily_history."""
    return within(history, first, last).groupBy(times.day(F.col("hour")).alias("date")).agg(
        _mean(F.sum("total"), F.sum("scored"), digits).alias("avg_sentiment"),
        F.sum("scored").alias("comment_count")).filter("comment_count > 0")


def daily_bands(history: DataFrame, first=None, last=None) -> DataFrame:
    """(date, n, positive_count, neutral_count, negative_count)."""
    names = ("positive", "neutral", "negative")
    return within(history, first, last).groupBy(times.day(F.col("hour")).alias("date")).agg(
        F.sum("n").alias("n"), *[F.sum(c).alias(f"{c}_count") for c in names])


def event_days(history: DataFrame, first=None, last=None, digits: int = 6) -> DataFrame:
    """(id, date, n, avg_sentiment, likes): the days of every event; the mean is null where no comment has a score."""
    return within(history, first, last).groupBy("id", times.day(F.col("hour")).alias("date")).agg(
        F.sum("n").alias("n"), _mean(F.sum("total"), F.sum("scored"), digits).alias("avg_sentiment"),
        F.sum("likes").alias("likes"))


def trend(history: DataFrame, n_dates: int = 7, digits: int = 2) -> DataFrame:
    """(date, avg_sentiment, label) of the last dates with valid content, as metrics.sentiment_trend."""
    mean = F.coalesce(_mean(F.sum("total"), F.sum("scored"), digits), F.lit(NEUTRAL))
    days = within(history).filter("valid").groupBy(times.day(F.col("hour")).alias("date")).agg(mean.alias("avg_sentiment"))
    return metrics.last_active_days(days, n_dates).withColumn("label", F.substring("date", 6, 5))
