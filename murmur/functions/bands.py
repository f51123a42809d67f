"""Score bands: which scores count as positive, neutral, negative, and how risky they are."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Band(NamedTuple):
    lo: float
    hi: float
    hi_is_positive: bool = False


# The thresholds each report uses.
T1 = Band(0.3, 0.7)
T2 = Band(0.3, 0.7, hi_is_positive=True)
T3 = Band(0.35, 0.65)
T4 = Band(0.4, 0.6)
T5 = Band(-0.1, 0.1)
RISK_HIGH_BELOW = 0.3
RISK_MEDIUM_BELOW = 0.6


def _number(value: float) -> Column:
    # A decimal literal keeps decimal(4,3) scores exact; doubles are compared as doubles.
    return F.lit(value).cast("decimal(4,3)")


def is_positive(score: Column, band: Band = T1) -> Column:
    return score >= _number(band.hi) if band.hi_is_positive else score > _number(band.hi)


def is_negative(score: Column, band: Band = T1) -> Column:
    return score < _number(band.lo)


def is_neutral(score: Column, band: Band = T1) -> Column:
    return score.isNotNull() & ~is_positive(score, band) & ~is_negative(score, band)


def label(score: Column, band: Band = T1) -> Column:
    """positive / negative / neutral; a missing score is neutral."""
    return (F.when(is_positive(score, band), "positive")
            .when(is_negative(score, band), "negative")
            .otherwise("neutral"))


def counts(score: Column, band: Band = T1, null_is_neutral: bool = False) -> list[Column]:
    """Three aggregates: positive_count, neutral_count, negative_count."""
    neutral = is_neutral(score, band)
    if null_is_neutral:
        neutral = neutral | score.isNull()
    return [
        F.count_if(is_positive(score, band)).alias("positive_count"),
        F.count_if(neutral).alias("neutral_count"),
        F.count_if(is_negative(score, band)).alias("negative_count"),
    ]


def risk_level(score: Column) -> Column:
    """high below 0.3, medium below 0.6, else low; a missing score is low, a true 0 is high."""
    return (F.when(score < _number(RISK_HIGH_BELOW), "high")
            .when(score < _number(RISK_MEDIUM_BELOW), "medium")
            .otherwise("low"))
