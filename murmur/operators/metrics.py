"""Aggregates over events and comments. Every per-event question is answered for all events in one plan.

`digits` is display rounding only; the default is what the dashboards show.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import bands, numbers, scalars, times
from murmur.operators import filters, joins

SCORE = "sentiment_score"


def _count() -> Column:
    return F.count(F.lit(1))


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(_count().alias(name))


def event_count(events: DataFrame, text: str | None = None, only_high_heat: bool = False) -> DataFrame:
    return row_count(filters.titled(events, text, only_high_heat), "n_events")


def comment_count(comments: DataFrame, per_event: bool = False) -> DataFrame:
    if per_event:
        return joins.counts_of(comments, "comment_count")
    return row_count(comments, "comment_count")


def _by(df: DataFrame, per_event: bool, *aggregates: Column) -> DataFrame:
    return joins.per_event(df, *aggregates) if per_event else df.agg(*aggregates)


def mean_likes(comments: DataFrame, per_event: bool = False, digits: int = 1) -> DataFrame:
    likes = numbers.mean(F.coalesce("like_count", F.lit(0)))
    return _by(comments, per_event, F.round(F.coalesce(likes, F.lit(0.0)), digits).alias("avg_likes"))


def mean_sentiment(comments: DataFrame, per_event: bool = False, digits: int = 3) -> DataFrame:
    """Null scores count as 0.5; 0.5 when there is no row."""
    return _by(comments, per_event,
               F.round(numbers.mean_or(F.col(SCORE), 0.5), digits).alias("avg_sentiment"))


def known_mean_sentiment(comments: DataFrame, digits: int = 2) -> DataFrame:
    """Null scores are skipped; valid content only; 0.5 when there is no row."""
    valid = comments.filter(scalars.valid_content(F.col("content")))
    return valid.agg(F.round(F.coalesce(numbers.mean_score(F.col(SCORE)), F.lit(0.5)), digits).alias("avg_sentiment"))


def band_counts(comments: DataFrame, band: bands.Band = bands.T1, per_event: bool = False,
                null_is_neutral: bool = False) -> DataFrame:
    return _by(comments, per_event, *bands.counts(F.col(SCORE), band, null_is_neutral), _count().alias("total"))


def with_band_percents(df: DataFrame, digits: int = 1) -> DataFrame:
    """Percentages of total; 0 / 100 / 0 when total is 0 or missing."""
    for name, empty in (("positive", 0.0), ("neutral", 100.0), ("negative", 0.0)):
        share = numbers.percent(F.coalesce(f"{name}_count", F.lit(0)), F.col("total"), digits)
        df = df.withColumn(f"{name}_pct", F.coalesce(share, F.lit(empty)))
    return df


def event_bands(events: DataFrame, comments: DataFrame, digits: int = 1, columns=("id",)) -> DataFrame:
    """Band counts and percentages of every event, events without comments included. `columns` of the event are
    kept."""
    out = events.select(*columns).join(band_counts(comments, per_event=True), "id", "left")
    names = ("positive_count", "neutral_count", "negative_count", "total")
    out = out.fillna(0, list(names))
    return with_band_percents(out, digits)


def whole_percents(comments: DataFrame, default: tuple[int, int, int] = (35, 50, 15)) -> DataFrame:
    """Whole percentages that add up to 100; the neutral share takes the remainder."""
    valid = comments.filter(scalars.valid_content(F.col("content")))
    total = F.col("total")

    def share(name: str) -> Column:
        return F.bround(numbers.percent(F.col(f"{name}_count"), total), 0).cast("bigint")

    counted = valid.agg(*bands.counts(F.col(SCORE), bands.T2), _count().alias("total"))
    some = total > 0
    positive = F.when(some, share("positive")).otherwise(F.lit(default[0]))
    negative = F.when(some, share("negative")).otherwise(F.lit(default[2]))
    return (counted.select(positive.cast("bigint").alias("positive"), negative.cast("bigint").alias("negative"))
            .select("positive", (F.lit(100) - F.col("positive") - F.col("negative")).cast("bigint").alias("neutral"),
                    "negative"))


def mean_heat(events: DataFrame, digits: int = 0) -> DataFrame:
    heat = numbers.mean(F.coalesce("heat", F.lit(0).cast("bigint")))
    return events.agg(F.round(F.coalesce(heat, F.lit(0.0)), digits).alias("avg_heat"))


def risk_index(events: DataFrame, comments: DataFrame, as_of, digits: int = 0) -> DataFrame:
    """Share of events that have a low-scored comment, its level, and how many of them are new this hour."""
    lows = (comments.filter(bands.is_negative(F.col(SCORE)) & F.col("event_id").isNotNull())
            .select(F.col("event_id").alias("id")).distinct().withColumn("is_negative", F.lit(True)))
    fresh = times.since(F.col("crawl_time"), as_of, hours=1)
    counted = events.join(lows, "id", "left").agg(
        _count().alias("n_events"),
        F.count_if(F.col("is_negative")).alias("n_negative"),
        F.count_if(F.col("is_negative") & fresh).alias("n_negative_hour"))
    share = numbers.percent(F.col("n_negative"), F.col("n_events"))
    index = F.coalesce(F.round(share, digits), F.lit(0.0))
    return (counted.withColumn("risk_index", index)
            .withColumn("risk_level", F.when(F.round(F.coalesce(share, F.lit(0.0)), 0) >= 70, "high")
                        .when(F.round(F.coalesce(share, F.lit(0.0)), 0) >= 30, "medium").otherwise("low"))
            .withColumn("risk_text", F.when(
                F.col("risk_level") == "high",
                F.concat(F.col("n_negative_hour").cast("string"), F.lit(" new high-risk events in the last hour")))
                .when(F.col("risk_level") == "medium",
                      F.concat(F.lit("about "), F.round(share, 0).cast("bigint").cast("string"),
                               F.lit("% of events are negative")))
                .otherwise("no event of obvious high risk")))


def event_coverage(events: DataFrame, comments: DataFrame, as_of) -> DataFrame:
    """Events crawled on the day of as_of, and events that have any comment."""
    covered = (comments.filter(F.col("event_id").isNotNull()).select("event_id").distinct()
               .agg(_count().alias("n")))
    return events.agg(
        F.count_if(times.on_day(F.col("crawl_time"), as_of)).alias("new_today"),
    ).withColumn("covered_events", covered.scalar())


def likes_trend(comments: DataFrame, as_of, digits: int = 1) -> DataFrame:
    """All-time mean of likes against the mean of the day before as_of."""
    yesterday = times.as_datetime(as_of) - dt.timedelta(days=1)
    on = times.on_day(F.col("publish_time"), yesterday)
    pair = comments.agg(
        F.round(F.coalesce(numbers.mean(F.coalesce("like_count", F.lit(0))), F.lit(0.0)), digits).alias("mean_all"),
        F.round(F.coalesce(numbers.mean(F.when(on, F.col("like_count"))), F.lit(0.0)), digits).alias("mean_yesterday"))
    a, y = F.col("mean_all"), F.col("mean_yesterday")
    return pair.withColumn("trend", F.when(y == 0, "none").when(a > y, "up").when(a < y, "down").otherwise("flat")
                           ).withColumn("difference", F.when(y == 0, F.lit(0.0)).otherwise(F.round(F.abs(a - y), digits)))


def negative_ratio_and_spread(comments: DataFrame, digits: int = 1) -> DataFrame:
    """Per event: share of low scores, and comments plus likes."""
    low = F.count_if(bands.is_negative(F.col(SCORE)))
    return joins.per_event(
        comments,
        F.round(numbers.percent(low, _count()), digits).alias("negative_ratio"),
        (_count() + numbers.sum_or_zero(F.col("like_count"))).alias("spread"))


def hourly_history(comments: DataFrame, digits: int = 3) -> DataFrame:
    """Mean score and spread by hour over the whole history."""
    return comments.filter(F.col("publish_time").isNotNull()).groupBy(
        times.hour_label(F.col("publish_time")).alias("hour")).agg(
        F.round(numbers.mean_or(F.col(SCORE), 0.5), digits).alias("avg_sentiment"),
        (_count() + numbers.sum_or_zero(F.col("like_count"))).alias("spread"))


def all_hours(df: DataFrame, **fills) -> DataFrame:
    """Completes rows keyed by `hour` to 0..23."""
    hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(df, "hour", "left").fillna(fills)


def day_profile(comments: DataFrame, as_of, hours: int = 24, digits: int = 3) -> DataFrame:
    """Hour-of-day profile of the last hours: mean score 0.5 and spread 0 where nothing was said."""
    recent = comments.filter(times.since(F.col("publish_time"), as_of, hours=hours))
    seen = recent.groupBy(F.hour("publish_time").alias("hour")).agg(
        F.round(numbers.mean_or(F.col(SCORE), 0.5), digits).alias("avg_sentiment"),
        (_count() + numbers.sum_or_zero(F.col("like_count"))).alias("spread"))
    return all_hours(seen, avg_sentiment=0.5, spread=0)


def hour_counts(comments: DataFrame, as_of=None, days: int | None = None) -> DataFrame:
    """Comments by hour of day, all 24 hours."""
    rows = comments if days is None else comments.filter(times.since(F.col("publish_time"), as_of, days=days))
    return all_hours(rows.groupBy(F.hour("publish_time").alias("hour")).agg(_count().alias("n")), n=0)


def daily(df: DataFrame, *aggregates: Column, time: str = "publish_time") -> DataFrame:
    return df.filter(F.col(time).isNotNull()).groupBy(times.day(F.col(time)).alias("date")).agg(*aggregates)


def titled_by_day(events: DataFrame, keyword: str, band: bands.Band = bands.T4) -> DataFrame:
    """Per date: events whose title holds the keyword, and how many of them are positive, neutral, negative."""
    return daily(filters.titled(events, keyword), _count().alias("n"), *bands.counts(F.col(SCORE), band),
                 time="crawl_time")


def last_active_days(by_day: DataFrame, n: int, date: str = "date") -> DataFrame:
    """The n latest dates that have data. `by_day` holds one row per date."""
    return by_day.orderBy(F.col(date).desc()).limit(n)


def sentiment_trend(comments: DataFrame, n_dates: int = 7, digits: int = 2) -> DataFrame:
    """Mean score of the last dates that have data (not calendar days)."""
    valid = comments.filter(scalars.valid_content(F.col("content")))
    means = daily(valid, F.round(F.coalesce(numbers.mean_score(F.col(SCORE)), F.lit(0.5)), digits).alias("avg_sentiment"))
    return last_active_days(means, n_dates).withColumn("label", F.substring("date", 6, 5))


def daily_sentiment(comments: DataFrame, as_of, days: int, digits: int = 3) -> DataFrame:
    recent = comments.filter(times.since(F.col("publish_time"), as_of, days=days))
    return daily(recent, F.round(numbers.mean_score(F.col(SCORE)), digits).alias("avg_sentiment"))


def daily_heat(events: DataFrame, as_of, days: int, digits: int = 2) -> DataFrame:
    recent = events.filter(times.since(F.col("crawl_time"), as_of, days=days))
    return daily(recent, numbers.sum_or_zero(F.col("heat")).alias("total_heat"),
                 F.round(numbers.mean(F.col("heat")), digits).alias("avg_heat"), time="crawl_time")


def like_histogram(comments: DataFrame) -> DataFrame:
    likes = F.coalesce("like_count", F.lit(0))
    return comments.agg(
        F.count_if(likes == 0).alias("likes_0"),
        F.count_if(likes.between(1, 10)).alias("likes_1_10"),
        F.count_if(likes.between(11, 100)).alias("likes_11_100"),
        F.count_if(likes > 100).alias("likes_over_100"))


def by_location(comments: DataFrame, sentiment: bool = False, unknown: str = "unknown", digits: int = 6) -> DataFrame:
    known = comments.filter(F.col("location").isNotNull() & ~F.col("location").isin("", unknown))
    if not sentiment:
        return known.groupBy("location").agg(_count().alias("value"))
    scored = known.filter(F.col(SCORE).isNotNull())
    return scored.groupBy("location").agg(F.round(numbers.mean_score(F.col(SCORE)), digits).alias("value"))


def event_score_bands(events: DataFrame) -> DataFrame:
    return events.agg(*bands.counts(F.col(SCORE), bands.T3), _count().alias("total"))


def minute_series(comments: DataFrame, as_of, hours: int = 2, digits: int = 3) -> DataFrame:
    """Per event and minute: number of comments and mean score over the last hours."""
    recent = comments.filter(times.since(F.col("publish_time"), as_of, hours=hours))
    return recent.groupBy("event_id", times.minute_label(F.col("publish_time")).alias("minute")).agg(
        _count().alias("n"), F.round(numbers.mean_score(F.col(SCORE)), digits).alias("avg_sentiment"))


def system_stats(events: DataFrame, comments: DataFrame, as_of, hours: int = 24, hot: int = 1_000_000,
                 user: str = "username", digits: int = 6) -> DataFrame:
    """One row over the last hours of both tables."""
    heat = F.col("heat")
    left = events.filter(times.since(F.col("crawl_time"), as_of, hours=hours)).agg(
        _count().alias("total_events"), F.count_if(heat > hot).alias("high_heat_events"),
        F.round(numbers.mean(heat), digits).alias("avg_heat"))
    recent = comments.filter(times.since(F.col("publish_time"), as_of, hours=hours))
    names = ["total_comments", "unique_users", "avg_sentiment", "positive_count", "neutral_count", "negative_count"]
    talk = recent.agg(_count().alias("total_comments"), F.count_distinct(user).alias("unique_users"),
                      F.round(numbers.mean_score(F.col(SCORE)), digits).alias("avg_sentiment"),
                      *bands.counts(F.col(SCORE)))
    right = talk.agg(F.first(F.struct(*names)).alias("r")).scalar()
    return left.withColumn("_r", right).select("*", *[F.col("_r")[n].alias(n) for n in names]).drop("_r")


def period_bands(comments: DataFrame, as_of, days: int = 30, band: bands.Band = bands.T4) -> DataFrame:
    rows = comments.filter(times.since(F.col("publish_time"), as_of, days=days) & F.col(SCORE).isNotNull())
    return rows.agg(*bands.counts(F.col(SCORE), band), _count().alias("total"))


def daily_history(comments: DataFrame, as_of=None, days: int | None = None, digits: int = 6) -> DataFrame:
    """Mean score and count by publication date, crawl date where the first is missing; up to as_of where it is
    given, and not older than `days`."""
    stamps = [F.col(c) for c in ("publish_time", "crawl_time") if c in comments.columns]
    rows = comments.filter(F.col(SCORE).isNotNull())
    if days is not None:
        recent = [times.since(c, as_of, days=days) for c in stamps]
        rows = rows.filter(recent[0] | recent[1] if len(recent) == 2 else recent[0])
    elif as_of is not None:
        rows = rows.filter(times.until(F.coalesce(*stamps), as_of))
    return rows.groupBy(F.coalesce(*[times.day(c) for c in stamps]).alias("date")).agg(
        F.round(numbers.mean_score(F.col(SCORE)), digits).alias("avg_sentiment"), _count().alias("comment_count"))


def event_features(events: DataFrame, comments: DataFrame, as_of=None, days: int | None = None,
                   digits: int = 6) -> DataFrame:
    """Per event: comment count, mean score, mean likes; only events crawled up to as_of, in the last days."""
    rows = events
    if as_of is not None:
        crawled = F.col("crawl_time")
        rows = events.filter(times.until(crawled, as_of) if days is None else times.since(crawled, as_of, days=days))
    stats = joins.per_event(comments, _count().alias("comment_count"),
                            F.round(numbers.mean_score(F.col(SCORE)), digits).alias("avg_sentiment"),
                            F.round(numbers.mean(F.col("like_count")), digits).alias("avg_likes"))
    zero = F.lit(0).cast("bigint")
    return (rows.select("id", "title", "heat", "crawl_time").join(stats, "id", "left")
            .withColumn("comment_count", F.coalesce("comment_count", zero)))


def comment_stats(comments: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Per event: comment count, mean score with null as 0.5, total likes; optionally of given events only."""
    rows = comments if events is None else joins.only_events(comments, events)
    return joins.per_event(rows, _count().alias("comment_count"),
                           numbers.mean_or(F.col(SCORE), 0.5).alias("avg_sentiment"),
                           numbers.sum_or_zero(F.col("like_count")).alias("total_likes"))


def event_hours(comments: DataFrame, by: str = "hour", digits: int = 3) -> DataFrame:
    """Per event and hour (or day): mean score and number of comments."""
    stamp = F.col("publish_time")
    bucket = times.hour_label(stamp) if by == "hour" else times.day(stamp)
    return (comments.filter(stamp.isNotNull()).groupBy(F.col("event_id").alias("id"), bucket.alias("bucket"))
            .agg(F.round(numbers.mean_score(F.col(SCORE)), digits).alias("avg_sentiment"), _count().alias("n")))


def deep_stats(comments: DataFrame, beyond: float = 0.1, digits: int = 6) -> DataFrame:
    """Per event: likes, bands, mean, and the direction from its first to its last active hour. The comments are
    read once, into sums by event and hour; the rest works on those."""
    score, filled = F.col(SCORE), numbers.wide_score(F.coalesce(SCORE, F.lit(0.5).cast("decimal(4,3)")))
    hours = comments.filter(F.col("event_id").isNotNull()).groupBy(
        F.col("event_id").alias("id"), F.date_trunc("hour", "publish_time").alias("hour")).agg(
        _count().alias("n"), numbers.sum_or_zero(F.col("like_count")).alias("likes"),
        F.sum(filled).alias("filled"), F.round(numbers.mean_score(score), 3).alias("mean"),
        *bands.counts(score, null_is_neutral=True))
    active = F.when(F.col("mean").isNotNull(), times.hour_label(F.col("hour")))

    def total(name: str) -> Column:
        return F.sum(name).cast("bigint")

    stats = hours.groupBy("id").agg(
        total("n").alias("total"), total("likes").alias("total_likes"),
        *[total(f"{b}_count").alias(f"{b}_count") for b in ("positive", "neutral", "negative")],
        F.round(F.try_divide(F.sum("filled").cast("double"), total("n").cast("double")), digits).alias("avg_sentiment"),
        F.min_by("mean", active).alias("first_hour"), F.max_by("mean", active).alias("last_hour"),
        F.count(active).alias("active_hours"))
    moved = F.round(F.col("last_hour") - F.col("first_hour"), 3)
    direction = F.when(moved > beyond, "up").when(moved < -beyond, "down").otherwise("stable")
    return with_band_percents(stats, digits).withColumn("direction", direction)


def daily_availability(comments: DataFrame, as_of, windows=(7, 14, 30, 60, 90, 180)) -> DataFrame:
    """How many days with data lie in each window that ends at as_of."""
    by_day = daily_history(comments, as_of)
    last = times.as_datetime(as_of)
    return by_day.agg(*[F.count_if(F.col("date") >= (last - dt.timedelta(days=w)).date().isoformat())
                        .alias(f"days_{w}") for w in windows])


def duplicate_groups(comments: DataFrame, keys=("event_id", "user_id", "content")) -> DataFrame:
    """How many groups share the keys, and how many rows are surplus."""
    groups = comments.groupBy(*keys).agg(_count().alias("n")).filter(F.col("n") > 1)
    return groups.agg(_count().alias("groups"), numbers.sum_or_zero(F.col("n") - 1).alias("surplus"))


def duplicate_examples(comments: DataFrame, keys=("event_id", "user_id", "content"), k: int = 5) -> DataFrame:
    groups = comments.groupBy(*keys).agg(_count().alias("n")).filter(F.col("n") > 1)
    return groups.orderBy(F.col("n").desc(), *[F.col(c).asc() for c in keys]).limit(k)


def refreshed_scores(events: DataFrame, comments: DataFrame, title_score: Column, digits: int = 3) -> DataFrame:
    """Event score = mean comment score; the score of its own title where nothing was said."""
    avg = joins.per_event(comments, F.round(numbers.mean_score(F.col(SCORE)), digits).alias("_avg"))
    return (events.join(avg, "id", "left")
            .withColumn(SCORE, F.coalesce("_avg", title_score.cast("double"))).drop("_avg"))


def batch_quality(df: DataFrame) -> DataFrame:
    """Rows and missing times of one batch, in one pass."""
    return df.agg(_count().alias("rows"), F.count_if(F.col("publish_time").isNull()).alias("null_publish_time"),
                  F.count_if(F.col("crawl_time").isNull()).alias("null_crawl_time"))
