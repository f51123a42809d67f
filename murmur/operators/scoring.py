"""Influence, standardised features, anomaly reasons and risk signals of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import numbers, times
from murmur.operators import joins, metrics, ranking

# Weights of the influence factors.
WEIGHTS = {"heat_factor": 0.25, "comment_factor": 0.20, "engagement_factor": 0.25, "sentiment_factor": 0.15,
           "time_factor": 0.15}
FULL_HEAT, FULL_COMMENTS, FULL_LIKES = 1000.0, 100.0, 10.0

FEATURES = ("heat", "comment_count", "avg_sentiment", "avg_likes", "hour")
FEATURE_DEFAULTS = {"heat": 0.0, "comment_count": 0.0, "avg_sentiment": 0.5, "avg_likes": 0.0, "hour": 0.0}
REASON_BEYOND = 1.5


def _capped(value: Column) -> Column:
    return F.least(value, F.lit(1.0))


def influence(events: DataFrame, comments: DataFrame, as_of, per_comment_polarization: bool = False,
              prune: bool = False, digits: int = 2) -> DataFrame:
    """Score 0..100 of every event from heat, number of comments, likes, polarisation and age.

    Polarisation is the distance of the mean score from 0.5, or, per comment, the mean of the distances; in
    that form an event without crawl time counts as old instead of half fresh.
    """
    rows = joins.only_events(comments, events) if prune else comments
    half = F.lit(0.5).cast("decimal(4,3)")
    n, likes = F.coalesce("comment_count", F.lit(0)).cast("double"), F.coalesce("_likes", F.lit(0)).cast("double")
    if per_comment_polarization:
        distance = F.abs(F.coalesce("sentiment_score", half) - half)
        stats = joins.per_event(rows, F.count(F.lit(1)).alias("comment_count"), numbers.sum_or_zero(F.col("like_count")).alias("_likes"),
                                numbers.mean_score(distance).alias("_mean"))
        polarization = F.coalesce("_mean", F.lit(0.0))
    else:
        # The sums of metrics.event_features, all of them in use, so that a plan with both reads the comments once.
        score = numbers.wide_score(F.col("sentiment_score"))
        stats = joins.per_event(rows, F.count(F.lit(1)).alias("comment_count"), F.sum(score).alias("_total"), F.count(score).alias("_scored"),
                                F.sum("like_count").alias("_sum"), F.count("like_count").alias("_liked"))
        without = (F.col("comment_count") - F.col("_scored")).cast("decimal(18,0)")
        total = F.when(F.col("_scored") > 0, F.col("_total")).otherwise(F.lit(0)) + without * half
        stats = stats.select("id", "comment_count", F.when(F.col("_liked") > 0, F.col("_sum")).otherwise(F.lit(0)).alias("_likes"),
                             F.try_divide(total.cast("double"), F.col("comment_count").cast("double")).alias("_mean"))
        polarization = F.abs(F.coalesce("_mean", F.lit(0.5)) - F.lit(0.5))
    factors = {
        "heat_factor": _capped(F.coalesce("heat", F.lit(0)).cast("double") / FULL_HEAT),
        "comment_factor": _capped(n / FULL_COMMENTS),
        "engagement_factor": _capped(F.when(n > 0, likes / n).otherwise(F.lit(0.0)) / FULL_LIKES),
        "sentiment_factor": F.lit(0.5) + polarization,
        "time_factor": times.time_factor(F.col("crawl_time"), as_of, 0.0 if per_comment_polarization else 0.5),
    }
    out = events.join(stats, "id", "left")
    for name, value in factors.items():
        out = out.withColumn(name, value)
    total = None
    for name, weight in WEIGHTS.items():
        part = F.col(name) * F.lit(weight)
        total = part if total is None else total + part
    return (out.withColumn("influence_score", F.round(total * 100, digits))
            .withColumn("comment_count", F.coalesce("comment_count", F.lit(0).cast("bigint")))
            .drop("_likes", "_mean"))


def influential(events: DataFrame, comments: DataFrame, as_of, k: int = 10, days: int | None = None,
                digits: int = 2, pool: int | None = None) -> DataFrame:
    """The k most influential events, of the last days; `pool` looks at the hottest events only."""
    if pool is not None:
        rows = ranking.hottest(events, pool, as_of, days)
    else:
        rows = events if days is None else events.filter(times.since(F.col("crawl_time"), as_of, days=days))
    scored = influence(rows, comments, as_of, prune=pool is not None or days is not None, digits=digits)
    return scored.orderBy(F.col("influence_score").desc(), F.col("heat").desc(), F.col("id").asc()).limit(k)


def influence_summary(scored: DataFrame, digits: int = 2) -> DataFrame:
    """One row: how many, mean and best score, best title."""
    s = F.col("influence_score")
    return scored.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.round(F.coalesce(F.avg(s), F.lit(0.0)), digits).alias("avg_influence_score"),
        F.coalesce(F.max(s), F.lit(0.0)).alias("max_score"),
        F.max_by("title", F.struct(s, "heat", -F.col("id"))).alias("top_event"))


def factor_breakdown(scored: DataFrame, digits: int = 3) -> DataFrame:
    """(id, factor, value, weight): one row per event and factor."""
    parts = F.array(*[F.struct(F.lit(name).alias("factor"), F.round(name, digits).alias("value"),
                               F.lit(weight).alias("weight")) for name, weight in WEIGHTS.items()])
    return scored.select("id", F.explode(parts).alias("p")).select("id", "p.factor", "p.value", "p.weight")


def features(events: DataFrame, comments: DataFrame, as_of=None, days: int | None = None) -> DataFrame:
    """Five numbers per event, with a default where something is missing."""
    rows = metrics.event_features(events, comments, as_of, days)
    raw = rows.withColumn("hour", F.hour("crawl_time"))
    filled = [F.coalesce(F.col(f).cast("double"), F.lit(FEATURE_DEFAULTS[f])).alias(f) for f in FEATURES]
    return raw.select("id", "title", *filled)


def standardised(df: DataFrame, columns=FEATURES, digits: int | None = None) -> DataFrame:
    """Adds z_<column>: distance from the mean in population deviations; 0 for a constant column. Sums are decimals, so
    the last digit does not depend on the order of the rows."""
    means = df.agg(F.struct(*[_mean(c).alias(c) for c in columns])).scalar()
    out = df.withColumn("_m", means)
    squares = out.agg(F.struct(*[_mean_square(c, F.col(f"_m.{c}")).alias(c) for c in columns])).scalar()
    out = out.withColumn("_v", squares)
    for c in columns:
        out = out.withColumn(f"z_{c}", _z(c, F.col(f"_m.{c}"), F.col(f"_v.{c}"), digits))
    return out.drop("_m", "_v")


def _mean(c: str) -> Column:
    return numbers.mean(F.col(c).cast("decimal(28,9)"))


def _mean_square(c: str, mean: Column) -> Column:
    away = F.col(c) - mean
    return numbers.mean((away * away).cast("decimal(38,12)"))


def _z(c: str, mean: Column, square: Column, digits: int | None) -> Column:
    z = (F.col(c) - mean) / F.when(square > 0, F.sqrt(square)).otherwise(F.lit(1.0))
    return z if digits is None else F.round(z, digits)


def counted_and_standardised(df: DataFrame, columns=FEATURES) -> tuple[int, DataFrame]:
    """The number of rows, and the same as `standardised` with means and deviations put in as numbers: two jobs that give
    one row each, after which df is read once by whatever reads the result. For a table that is stored."""
    means = df.agg(F.count(F.lit(1)).alias("_n"), *[_mean(c).alias(c) for c in columns]).first()
    at = {c: F.lit(means[c]).cast("double") for c in columns}
    squares = df.agg(*[_mean_square(c, at[c]).alias(c) for c in columns]).first()
    zs = [_z(c, at[c], F.lit(squares[c]).cast("double"), None).alias(f"z_{c}") for c in columns]
    return means["_n"], df.select("*", *zs)


def reasons(df: DataFrame, beyond: float = REASON_BEYOND) -> DataFrame:
    """Adds `anomaly_types`: which of the first four features lie beyond the bound."""
    def far(c: str) -> Column:
        return F.abs(F.col(f"z_{c}")) > beyond

    found = F.array(
        F.when(far("heat"), "heat_spike"),
        F.when(far("comment_count"), "comment_spike"),
        F.when(far("avg_sentiment"), F.when(F.col("z_avg_sentiment") < 0, "sentiment_drop").otherwise("sentiment_spike")),
        F.when(far("avg_likes"), "engagement_spike"))
    return df.withColumn("anomaly_types", F.array_compact(found))


def signals(df: DataFrame) -> DataFrame:
    """Adds level and risk flag of sentiment, heat and comments, and the overall level of the flags."""
    s, h, c = F.col("avg_sentiment"), F.col("heat"), F.col("comment_count")
    out = (df
           .withColumn("sentiment_level", F.when(s > 0.7, "low").when(s < 0.3, "high").otherwise("medium"))
           .withColumn("sentiment_is_risk", s < 0.4)
           .withColumn("heat_level", F.when(h > 50_000, "high").when(h > 10_000, "medium").otherwise("low"))
           .withColumn("heat_is_risk", h > 80_000)
           .withColumn("comment_level", F.when(c > 1_000, "high").when(c > 100, "medium").otherwise("low"))
           .withColumn("comment_is_risk", c > 2_000))
    n = sum(F.col(f"{x}_is_risk").cast("int") for x in ("sentiment", "heat", "comment"))
    return (out.withColumn("risk_count", n)
            .withColumn("signal_level", F.when(F.col("risk_count") >= 3, "critical")
                        .when(F.col("risk_count") >= 2, "high")
                        .when(F.col("risk_count") >= 1, "medium").otherwise("low")))


def severity(score: Column, high_below: float = -0.5, medium_below: float = -0.2) -> Column:
    return F.when(score < high_below, "high").when(score < medium_below, "medium").otherwise("low")
