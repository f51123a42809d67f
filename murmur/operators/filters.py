"""Row selection and view projections over events, comments and articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmur.functions import bands, scalars, times


def contains(text: Column, part: str, ignore_case: bool = True) -> Column:
    """Literal substring test; % and _ have no special meaning."""
    if ignore_case:
        return F.contains(F.lower(text), F.lit(part.lower()))
    return F.contains(text, F.lit(part))


def newest(time: str, key: str) -> list[Column]:
    return [F.col(time).desc(), F.col(key).asc()]


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of `size` rows. `order` must end in a unique column."""
    out = df.orderBy(*order)
    skip = (max(number, 1) - 1) * size
    return out.offset(skip).limit(size) if skip else out.limit(size)


def page_after(df: DataFrame, time: str, key: str, last_time, last_key, size: int) -> DataFrame:
    """The page, newest first, that follows the row with the given time and key. No task keeps more than `size` rows,
    however deep the page lies."""
    stamp, at = F.col(time), times.moment(last_time)
    rest = df.filter((stamp <= at) & ((stamp < at) | (F.col(key) > F.lit(last_key))))
    return rest.orderBy(*newest(time, key)).limit(size)


def valid_count(df: DataFrame, text: str = "content") -> DataFrame:
    """One row: rows with valid content, and all rows."""
    return df.agg(F.count_if(scalars.valid_content(F.col(text))).alias("valid"), F.count(F.lit(1)).alias("total"))


def page_count(df: DataFrame, size: int) -> DataFrame:
    """One row: total rows and number of pages."""
    total = F.count(F.lit(1))
    return df.agg(total.alias("total"), F.ceil(total / size).cast("bigint").alias("total_pages"))


def clamp_page(number: int, total_pages: int) -> int:
    return max(1, min(number, max(1, total_pages)))


def event_view(events: DataFrame) -> DataFrame:
    score = F.col("sentiment_score")
    return events.select(
        "id", "title",
        scalars.clip(F.col("title"), 50).alias("summary"),
        F.date_format("crawl_time", "yyyy-MM-dd HH:mm:ss").alias("crawl_time"),
        F.coalesce("heat", F.lit(0)).cast("bigint").alias("heat"),
        (F.coalesce("heat", F.lit(0)) >= scalars.HIGH_HEAT).alias("is_high_heat"),
        F.round(score, 3).alias("sentiment_score"),
        bands.label(score).alias("sentiment_type"),
        bands.risk_level(score).alias("risk_level"))


def comment_view(comments: DataFrame) -> DataFrame:
    shown = [c for c in ("comment_id", "event_id", "user_id", "username", "location", "like_count", "hot_title")
             if c in comments.columns]
    return comments.select(
        *shown, "content",
        F.date_format("publish_time", "yyyy-MM-dd HH:mm:ss").alias("publish_time"),
        F.round("sentiment_score", 3).alias("sentiment_score"),
        bands.label(F.col("sentiment_score")).alias("sentiment_type"),
        F.coalesce(F.trim("content") != "", F.lit(False)).alias("is_valid_content"))


def article_view(articles: DataFrame) -> DataFrame:
    shown = [c for c in ("article_id", "event_id", "author", "like_count", "repost_count", "comment_count")
             if c in articles.columns]
    return articles.select(
        *shown,
        scalars.clip(F.col("content"), 200).alias("preview"),
        F.date_format("publish_time", "yyyy-MM-dd HH:mm:ss").alias("publish_time"),
        F.round("sentiment_score", 3).alias("sentiment_score"),
        bands.label(F.col("sentiment_score")).alias("sentiment_type"))


def high_heat(events: DataFrame, least: int = scalars.HIGH_HEAT) -> DataFrame:
    return events.filter(F.col("heat") >= least)


def titled(events: DataFrame, text: str | None = None, only_high_heat: bool = False,
           exact: bool = False, ignore_case: bool = True) -> DataFrame:
    """Events whose title equals or holds a text, optionally only the hot ones."""
    out = events
    if text:
        out = out.filter(F.col("title") == text if exact else contains(F.col("title"), text, ignore_case))
    return high_heat(out) if only_high_heat else out


def crawled_between(events: DataFrame, start, end, only_high_heat: bool = False) -> DataFrame:
    out = events.filter(times.between_days(F.col("crawl_time"), start, end))
    return high_heat(out) if only_high_heat else out


def published_between(comments: DataFrame, start, end) -> DataFrame:
    return comments.filter(scalars.valid_content(F.col("content"))
                           & times.between_days(F.col("publish_time"), start, end))


def scored_between(comments: DataFrame, lo: float, hi: float) -> DataFrame:
    """Valid comments in a score interval; bounds are clamped to 0..1 and swapped when reversed."""
    lo, hi = sorted(min(max(x, 0.0), 1.0) for x in (lo, hi))
    score = F.col("sentiment_score")
    return comments.filter(scalars.valid_content(F.col("content"))
                           & score.between(F.lit(lo).cast("decimal(4,3)"), F.lit(hi).cast("decimal(4,3)")))


def by_id(df: DataFrame, value, key: str = "id") -> DataFrame:
    return df.filter(F.col(key) == value)


def mentioning(events: DataFrame, comments: DataFrame, articles: DataFrame, keyword: str,
               ignore_case: bool = True) -> DataFrame:
    """Events with at least one comment or article that holds the keyword."""
    hits = [t.filter(contains(F.col("content"), keyword, ignore_case)).select("event_id")
            for t in (comments, articles)]
    ids = hits[0].unionByName(hits[1]).distinct()
    return events.join(ids, events["id"] == ids["event_id"], "left_semi")


def newest_per_event(df: DataFrame, k: int, key: str, event: str = "event_id",
                     time: str = "publish_time") -> DataFrame:
    """The k newest rows of every event. The rank filter is applied before the shuffle as well, so at
    most k rows per event leave a task however large the event is."""
    order = Window.partitionBy(event).orderBy(F.col(time).desc(), F.col(key).asc())
    return df.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def at_risk(events: DataFrame, level: str) -> DataFrame:
    return events.filter(bands.risk_level(F.col("sentiment_score")) == level)


def saved_sorted(saved: DataFrame, by: str = "created_at", descending: bool = True) -> DataFrame:
    column = F.col(by).desc() if descending else F.col(by).asc()
    return saved.orderBy(column, F.col("id").asc())
