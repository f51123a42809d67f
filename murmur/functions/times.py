"""Time helpers. The reference time is always an argument, never the clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_DECAY = 0.1


def as_datetime(value: str | dt.date | dt.datetime) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    return dt.datetime.fromisoformat(value)


def moment(value: str | dt.date | dt.datetime) -> Column:
    """A timestamp literal without zone; compares with stored columns without a cast on them."""
    return F.lit(as_datetime(value).isoformat(sep=" ")).cast("timestamp_ntz")


def since(column: Column, as_of, **ago) -> Column:
    """From as_of - ago to as_of, both ends included, with ago in datetime.timedelta terms (days=7, hours=24). What lies
    after as_of is outside, so a replay at an earlier as_of sees what was there then."""
    return (column >= moment(as_datetime(as_of) - dt.timedelta(**ago))) & (column <= moment(as_of))


def until(column: Column, as_of) -> Column:
    """Up to as_of, or without a time."""
    return column.isNull() | (column <= moment(as_of))


def on_day(column: Column, day) -> Column:
    start = dt.datetime.combine(as_datetime(day).date(), dt.time())
    return (column >= moment(start)) & (column < moment(start + dt.timedelta(days=1)))


def between_days(column: Column, start, end) -> Column:
    """Both days included; written as a half-open range so that it reaches the scan."""
    first = dt.datetime.combine(as_datetime(start).date(), dt.time())
    last = dt.datetime.combine(as_datetime(end).date(), dt.time())
    return (column >= moment(first)) & (column < moment(last + dt.timedelta(days=1)))


def day(column: Column) -> Column:
    return F.to_date(column).cast("string")


def minute_label(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm")


def hour_label(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:00")


def month_day(column: Column) -> Column:
    return F.date_format(column, "MM-dd")


def calendar(spark, start, end):
    """One row per date, both ends included."""
    first, last = as_datetime(start).date(), as_datetime(end).date()
    dates = F.sequence(F.lit(first), F.lit(last))
    return spark.range(1).select(F.explode(dates).alias("date")).select(F.col("date").cast("string").alias("date"))


def hours_between(later: Column, earlier: Column) -> Column:
    seconds = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return seconds.cast("double") / F.lit(3.6e9)


def time_factor(column: Column, as_of, when_null: float = 0.5, decay: float = DEFAULT_DECAY) -> Column:
    """Exponential decay by day, never below 0.1; 1 for what lies after as_of."""
    hours = F.greatest(hours_between(moment(as_of), column), F.lit(0.0))
    aged = F.greatest(F.exp(F.lit(-decay) * hours / F.lit(24.0)), F.lit(0.1))
    return F.when(column.isNull(), F.lit(when_null)).otherwise(aged)
