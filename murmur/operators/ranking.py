"""Top-k lists. Each ordering ends in the id, so equal measures give one answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmur.functions import bands, numbers, scalars, times
from murmur.operators import filters, joins, metrics


def hottest_first() -> list[Column]:
    return [F.col("heat").desc(), F.col("id").asc()]


def hottest(events: DataFrame, k: int, as_of=None, days: int | None = None) -> DataFrame:
    rows = events if days is None else events.filter(times.since(F.col("crawl_time"), as_of, days=days))
    return rows.orderBy(*hottest_first()).limit(k)


def latest(events: DataFrame, k: int) -> DataFrame:
    return events.orderBy(F.col("crawl_time").desc(), F.col("id").asc()).limit(k)


def heat_ranking(events: DataFrame, comments: DataFrame, k: int) -> DataFrame:
    """The hottest events and how often each was commented on."""
    return joins.with_counts(hottest(events, k), prune=True, comment_count=comments)


def with_category(events: DataFrame, rules: Sequence[tuple[str, str]],
                  other: str = "other") -> DataFrame:
    """Adds the category of the title, cleaned once for all rules."""
    rows = events.withColumn("_clean", scalars.clean_text(F.col("title")))
    return rows.withColumn("category", scalars.category(F.col("_clean"), rules, other)).drop("_clean")


def _among(events: DataFrame, pool: int | None) -> DataFrame:
    """All events, or the `pool` hottest."""
    return events if pool is None else hottest(events, pool)


def heat_rank_of_category(events: DataFrame, rules, name: str | None, k: int, pool: int | None = None) -> DataFrame:
    """The hottest of one category, or of all; `pool` looks at the hottest events only."""
    rows = with_category(_among(events, pool), rules)
    if name is not None:
        rows = rows.filter(F.col("category") == name)
    return rows.orderBy(*hottest_first()).limit(k)


def heat_rank_per_category(events: DataFrame, rules, k: int, pool: int | None = None) -> DataFrame:
    """The k hottest of every category. The rank filter also runs before the shuffle, so a task sends k rows for a
    category at most."""
    order = Window.partitionBy("category").orderBy(*hottest_first())
    rows = with_category(_among(events, pool), rules)
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def category_counts(events: DataFrame, rules) -> DataFrame:
    titled = events.filter(F.trim("title") != "")
    return with_category(titled, rules).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def category_heat(events: DataFrame, rules, pool: int | None = None,
                  digits: int = 2) -> DataFrame:
    """Count, total and mean heat of every category, empty categories kept."""
    names = [name for name, _ in rules] + ["other"]
    seen = with_category(_among(events, pool), rules).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), numbers.sum_or_zero(F.col("heat")).alias("total_heat"))
    every = events.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("category"))
    filled = every.join(seen, "category", "left").fillna(0, ["n", "total_heat"])
    avg = F.coalesce(F.try_divide(F.col("total_heat").cast("double"), F.col("n").cast("double")), F.lit(0.0))
    return filled.withColumn("avg_heat", F.round(avg, digits))


def heat_and_sentiment(events: DataFrame, k: int) -> DataFrame:
    rows = events.filter(F.col("heat") > 0).orderBy(*hottest_first()).limit(k)
    return rows.select("id", "title", "heat",
                       F.coalesce("sentiment_score", F.lit(0.5).cast("decimal(4,3)")).alias("sentiment_score"))


def high_risk(events: DataFrame, comments: DataFrame, k: int, threshold: float = 0.3, digits: int = 6) -> DataFrame:
    """Events low by their own score or by the mean of their comments."""
    avg = joins.per_event(comments, F.count(F.lit(1)).alias("comment_count"),
                          F.round(numbers.mean_score(F.col("sentiment_score")), digits).alias("avg_score"))
    low_own = F.coalesce(bands.is_negative(F.col("sentiment_score"), bands.Band(threshold, 1.0)), F.lit(False))
    low_avg = F.coalesce(F.col("avg_score") < threshold, F.lit(False))
    rows = events.join(avg, "id", "left").filter(low_own | low_avg)
    return (rows.orderBy(*hottest_first()).limit(k)
            .withColumn("comment_count", F.coalesce("comment_count", F.lit(0).cast("bigint"))))


def related_titles(events: DataFrame, keyword: str, k: int = 20) -> DataFrame:
    rows = filters.titled(events, keyword).filter(F.col("title") != keyword)
    return rows.orderBy(*hottest_first()).limit(k)


def newest_comments(comments: DataFrame, k: int = 20, key: str = "comment_id", preview: int = 100) -> DataFrame:
    """The newest comments of every event with a short preview."""
    top = filters.newest_per_event(comments, k, key)
    return top.withColumn("preview", scalars.clip(F.col("content"), preview))


def heatmap(events: DataFrame, comments: DataFrame, articles: DataFrame, as_of, days: int, k: int) -> DataFrame:
    """Hottest events of the last days with both counts. The list is cut before the counting."""
    return joins.with_counts(hottest(events, k, as_of, days), prune=True,
                             comment_count=comments, article_count=articles)


def opinions_on(events: DataFrame, articles: DataFrame, keyword: str, k: int = 20, longer_than: int = 10,
                preview: int = 200) -> DataFrame:
    """Articles of events titled with the keyword, hottest event and most liked first."""
    rows = joins.articles_of_titled(articles, events, filters.titled(events, keyword))
    usable = rows.filter(F.length("content") > longer_than)
    top = usable.orderBy(F.col("heat").desc(), F.col("like_count").desc(), F.col("article_id").asc(),
                         F.col("event_id").asc(), F.col("content").asc()).limit(k)
    score = F.coalesce("sentiment_score", F.lit(0.5).cast("decimal(4,3)"))
    return (top.select("article_id", scalars.clip(F.col("content"), preview).alias("summary"),
                    bands.label(score, bands.T4).alias("sentiment"),
                    F.col("publish_time").cast("string").alias("publish_time")))


def event_board(events: DataFrame, comments: DataFrame, digits: int = 1) -> DataFrame:
    """Every event with comment count, band counts, percentages and risk, in one plan."""
    kept = ("id", "title", "crawl_time", "heat", "sentiment_score")
    board = metrics.event_bands(events, comments, digits, kept).withColumnRenamed("total", "comment_count")
    return board.withColumn("risk_level", bands.risk_level(F.col("sentiment_score")))


def event_board_page(events: DataFrame, comments: DataFrame, number: int, size: int, digits: int = 1) -> DataFrame:
    """One page of the board: the page is cut first, then only its comments are read into the aggregate."""
    rows = filters.page(events, hottest_first(), number, size)
    return event_board(rows, joins.only_events(comments, rows), digits)


def hot_cards(events: DataFrame, comments: DataFrame, k: int = 6, digits: int = 1) -> DataFrame:
    """The hottest events with bands, risk, and likes estimated from the overall mean."""
    avg = metrics.mean_likes(comments, digits=1).scalar()
    board = event_board_page(events, comments, 1, k, digits)
    shown = F.greatest(F.col("comment_count"), F.lit(1)).cast("double")
    return (board.withColumn("_avg", avg)
            .withColumn("estimated_likes", F.bround(F.col("_avg") * shown, 0)).drop("_avg"))


def monitored(monitors: DataFrame, user_id, k: int = 50) -> DataFrame:
    return (monitors.filter(F.col("user_id") == user_id)
            .orderBy(F.col("created_at").desc(), F.col("keyword").asc(), F.col("id").asc()).limit(k))


def present(pairs: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Which of the asked pairs (user, keyword) or (user, event) are stored; all pairs at once."""
    known = stored.select(*keys).distinct().withColumn("is_present", F.lit(True))
    return pairs.join(known, list(keys), "left").withColumn("is_present", F.coalesce("is_present", F.lit(False)))
