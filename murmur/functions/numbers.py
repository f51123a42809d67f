"""Aggregates and small numeric expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean(column: Column) -> Column:
    """Exact sum divided once, so the result does not depend on the order of the rows. Null when empty."""
    return F.try_divide(F.sum(column).cast("double"), F.count(column).cast("double"))


def wide_score(score: Column) -> Column:
    """A score whose sum still fits a long-backed decimal(18,3) at 10^15 rows; decimal(4,3) would end at 10^11."""
    return score.cast("decimal(8,3)")


def mean_score(score: Column) -> Column:
    """Exact mean of three-decimal scores."""
    return mean(wide_score(score))


def mean_or(score: Column, missing: float) -> Column:
    """Mean score with nulls counted as `missing`, and `missing` when there is no row."""
    filled = F.coalesce(wide_score(score), wide_score(F.lit(missing)))
    return F.coalesce(mean(filled), F.lit(missing))


def percent(part: Column, total: Column, digits: int | None = None) -> Column:
    value = F.try_divide(F.lit(100.0) * part.cast("double"), total.cast("double"))
    return value if digits is None else F.round(value, digits)


def sum_or_zero(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")
