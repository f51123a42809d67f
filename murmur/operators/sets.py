"""Union, distinct and duplicate removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions import scalars, times
from murmur.operators import joins

TEXT_COLUMNS = ("event_id", "content", "publish_time", "sentiment_score")


def all_texts(comments: DataFrame, articles: DataFrame, events: DataFrame | None = None, as_of=None,
              days: int | None = None, columns=TEXT_COLUMNS) -> DataFrame:
    """Comments and articles as one table of texts, blanks dropped, optionally of given events or a window."""
    parts = []
    for kind, table, key in (("comment", comments, "comment_id"), ("article", articles, "article_id")):
        rows = table.filter(scalars.valid_content(F.col("content")))
        if days is not None:
            rows = rows.filter(times.since(F.col("publish_time"), as_of, days=days))
        if events is not None:
            rows = joins.only_events(rows, events)
        kept = [F.col(c) for c in columns if c in table.columns]
        parts.append(rows.select(F.lit(kind).alias("kind"), F.col(key).alias("text_id"), *kept))
    return parts[0].unionByName(parts[1])


def distinct_texts(df: DataFrame, text: str = "content") -> DataFrame:
    return df.filter(F.trim(text) != "").select(text).distinct()


def without_duplicates(comments: DataFrame, keys=("event_id", "user_id", "content"), key: str = "id") -> DataFrame:
    """Keeps the smallest id of each group; null keys group together. The grouping combines in the map tasks,
    so a group of any size costs one row per task, and the wide rows meet only the surviving ids."""
    kept = comments.groupBy(*keys).agg(F.min(key).alias(key)).select(key)
    return comments.join(kept, key, "left_semi")


def distinct_by_id(df: DataFrame, key: str) -> DataFrame:
    """Valid rows, one per id: the newest, among equals the one with most likes, then the greatest in all columns."""
    valid = df.filter(scalars.valid_content(F.col("content")))
    rest = [c for c in df.columns if c != key]
    first = ["publish_time", "like_count", "content"]
    order = F.struct(*first, *[c for c in rest if c not in first])
    best = F.max_by(F.struct(*rest), order).alias("r")
    return valid.groupBy(key).agg(best).select(key, *[F.col("r")[c].alias(c) for c in rest])


def active_dates(df: DataFrame, time: str = "publish_time") -> DataFrame:
    return (df.filter(scalars.valid_content(F.col("content")) & F.col(time).isNotNull())
            .select(times.day(F.col(time)).alias("date")).distinct())


def recent_or_wider(df: DataFrame, as_of, days: int, fallback_days: int = 365, least: int = 100,
                    time: str = "publish_time") -> DataFrame:
    """Rows of the last `days`; of a wider window when there are fewer than `least`; of `fallback_days` when
    there are none. The count is part of the plan: nothing runs while it is built. The widest cut is a literal and
    reaches the scan."""
    stamp = F.col(time)
    n = df.filter(times.since(stamp, as_of, days=days)).agg(F.count(F.lit(1))).scalar()
    none, few = max(days, fallback_days), max(days * 2, 180)
    length = F.when(n == 0, F.lit(none)).when(n < least, F.lit(few)).otherwise(F.lit(days))
    fits = [(length == d) & times.since(stamp, as_of, days=d) for d in sorted({none, few, days})]
    inside = fits[0]
    for f in fits[1:]:
        inside = inside | f
    return df.filter(times.since(stamp, as_of, days=max(none, few, days)) & inside)


def texts_of_events(events: DataFrame, comments: DataFrame, articles: DataFrame, keyword: str, as_of=None,
                    days: int | None = None, k: int | None = None) -> DataFrame:
    """Comments and articles of the given events that hold a keyword, newest first; the k newest where k is given."""
    rows = all_texts(comments, articles, events, as_of, days)
    hits = rows.filter(F.contains(F.lower("content"), F.lit(keyword.lower())))
    if k is None:
        return hits
    return hits.orderBy(F.col("publish_time").desc(), "kind", "text_id", "content").limit(k)


def stubs_and_known(rows: DataFrame, known: DataFrame, title: str = "hot_title") -> DataFrame:
    """Rows whose title is known united with those whose title is not, told apart by is_stub. One join: the rows keep
    their place."""
    names = known.select(F.col(title).alias("_title")).distinct()
    return (rows.join(names, F.col(title) == F.col("_title"), "left")
            .withColumn("is_stub", F.col("_title").isNull()).drop("_title"))
