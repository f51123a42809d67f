"""Reports that put several operators together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions import bands, numbers, times
from murmur.operators import (filters, forecast, forest, keywords, metrics, ranking, scoring, sets)


def summary(events: DataFrame, comments: DataFrame, as_of, days: int = 30, anomaly_days: int | None = 7,
            ahead: int = 7, anomalies: DataFrame | None = None) -> DataFrame:
    """One row: totals, mood, band counts, most influential event, anomalies and forecast, as they stood at as_of.
    `anomalies` may be given, such as a stored result of forest.detect; else it is computed, once."""
    events = events.filter(times.until(F.col("crawl_time"), as_of))
    comments = comments.filter(times.until(F.col("publish_time"), as_of))
    score, names = F.col("sentiment_score"), ("positive", "neutral", "negative")
    recent = F.when(times.since(F.col("publish_time"), as_of, days=days), score)
    talk = comments.agg(
        F.count(F.lit(1)).alias("total_comments"), F.round(numbers.mean_or(score, 0.5), 3).alias("avg_sentiment"),
        *bands.counts(recent, bands.T4), F.count(recent).alias("total"))
    base = talk.select(
        metrics.row_count(events).scalar().alias("total_events"), "total_comments", "avg_sentiment",
        F.when(F.col("avg_sentiment") > 0.6, "positive").when(F.col("avg_sentiment") < 0.4, "negative")
        .otherwise("neutral").alias("mood"),
        F.struct(*[f"{n}_count" for n in names], "total").alias("bands"))
    best = scoring.influential(events, comments, as_of, 5)
    ordered = F.sort_array(F.collect_list(F.struct("influence_score", "heat", "title")), asc=False)
    base = base.withColumn("top_influential", best.agg(ordered).scalar())
    odd = forest.detect(events, comments, as_of, anomaly_days) if anomalies is None else anomalies
    base = base.withColumn("anomalies", forest.severity_counts(odd).agg(
        F.first(F.struct("total", "high", "medium", "low"))).scalar())
    worst = odd.orderBy("anomaly_score", "id").limit(3).agg(F.sort_array(F.collect_list(F.struct("anomaly_score", "id", "title", "severity"))))
    base = base.withColumn("recent_anomalies", worst.scalar())
    steps = forecast.forecast(metrics.daily_history(comments, as_of), ahead)
    base = base.withColumn("predictions", steps.agg(F.sort_array(F.collect_list(F.struct("step", "prediction")))).scalar())
    base = base.withColumn("current_trend", F.coalesce(steps.agg(F.max("current_trend")).scalar(), F.lit("flat")))
    return (base.withColumn("high_severity_count", F.col("anomalies.high"))
            .withColumn("top_title", F.col("top_influential")[0]["title"])
            .withColumn("top_influence", F.col("top_influential")[0]["influence_score"]))


def evolution(events: DataFrame, comments: DataFrame, articles: DataFrame, as_of, event_as_of=None, days: int = 180,
              count: int = 10, stopwords: Sequence[str] = (), title_days: int = 7, score: str = "sentiment_score",
              ) -> dict[str, DataFrame]:
    """How the current hot words developed: timeline, burst and long-tail words, daily mood, polarity.

    The texts are read once per table below, whatever the number of words; callers that want all tables may
    persist the texts they pass in.
    """
    texts = sets.recent_or_wider(sets.all_texts(comments, articles), as_of, days)
    hot = keywords.fixed(keywords.hot_words(events, event_as_of or as_of, title_days, k=2 * count, stopwords=stopwords))
    ranked = [r["word"] for r in hot.orderBy(F.col("weight").desc(), "word").collect()]
    half = count // 2
    chosen = ranked[:half] + ranked[-half:] if len(ranked) >= count else ranked
    long = keywords.timeline(texts, chosen, as_of, days)
    polarity = keywords.polarity(one_row_per_text(texts, score), chosen, score)
    return {
        "keywords": polarity.join(hot.withColumnRenamed("word", "keyword"), "keyword").select(
            "keyword", F.round(F.col("weight") * 100, 2).alias("frequency"), "sentiment"),
        "timeline": long,
        "burst": keywords.burst_words(long),
        "longtail": keywords.longtail_words(long),
        "mood": keywords.sentiment_by_date(texts, as_of, days, score),
    }


def one_row_per_text(texts: DataFrame, score: str) -> DataFrame:
    """One row per distinct text with its lowest score."""
    return texts.groupBy("content").agg(F.min(score).alias(score))


def hotword_profile(events: DataFrame, articles: DataFrame, keyword: str) -> dict[str, DataFrame]:
    """Timeline, bands, co-occurring words and opinions of the events titled with a keyword."""
    by_day = metrics.titled_by_day(events, keyword)
    return {
        "timeline": by_day.select("date", "n"),
        "bands": by_day.drop("n"),
        "co_words": keywords.co_words(articles, events, keyword),
        "opinions": ranking.opinions_on(events, articles, keyword),
        "total": metrics.row_count(filters.titled(events, keyword), "total"),
    }
