"""Joins between events and what is written about them.

Comments and articles are aggregated by event before any join, so a hot event costs one row in the join
and its rows are combined inside the map tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import bands, marks, numbers, times


def per_event(df: DataFrame, *aggregates: Column, event: str = "event_id") -> DataFrame:
    return df.filter(F.col(event).isNotNull()).groupBy(F.col(event).alias("id")).agg(*aggregates)


def counts_of(df: DataFrame, name: str) -> DataFrame:
    return per_event(df, F.count(F.lit(1)).alias(name))


def only_events(df: DataFrame, events: DataFrame, event: str = "event_id") -> DataFrame:
    """Rows that belong to the given events."""
    ids = events.select(F.col("id").alias("_event"))
    return df.join(ids, df[event] == ids["_event"], "left_semi")


def with_counts(events: DataFrame, prune: bool = False, **tables: DataFrame) -> DataFrame:
    """Adds one count column per table, 0 where an event has no row.

    `prune=True` first drops the rows of other events; use it when `events` is a short page.
    """
    out = events
    for name, table in tables.items():
        rows = only_events(table, events) if prune else table
        out = out.join(counts_of(rows, name), "id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    return out


def articles_of_titled(articles: DataFrame, events: DataFrame, keyword_events: DataFrame) -> DataFrame:
    """Articles of the chosen events, with title and heat of the event."""
    picked = keyword_events.select(F.col("id").alias("_event"), F.col("title"), F.col("heat"))
    return articles.join(picked, articles["event_id"] == picked["_event"]).drop("_event")


def live_board(events: DataFrame, comments: DataFrame, articles: DataFrame, as_of, k: int = 20,
               hours: int = 1) -> DataFrame:
    """Hottest events crawled in the last hours with both counts and the mean comment score."""
    recent = (events.filter(times.since(F.col("crawl_time"), as_of, hours=hours))
              .orderBy(F.col("heat").desc(), F.col("crawl_time").desc(), F.col("id").asc()).limit(k))
    score = F.col("sentiment_score")
    talk = per_event(only_events(comments, recent), F.count(F.lit(1)).alias("comment_count"),
                     numbers.mean_or(score, 0.5).alias("avg_sentiment"))
    posts = counts_of(only_events(articles, recent), "article_count")
    zero = F.lit(0).cast("bigint")
    out = recent.drop("sentiment_score").join(talk, "id", "left").join(posts, "id", "left")
    return (out.withColumn("comment_count", F.coalesce("comment_count", zero))
            .withColumn("article_count", F.coalesce("article_count", zero))
            .withColumn("avg_sentiment", F.coalesce("avg_sentiment", F.lit(0.5)))
            .withColumn("sentiment_type", bands.label(F.col("avg_sentiment"))))


def low_mean_events(events: DataFrame, comments: DataFrame, below: float = 0.3, k: int | None = 5,
                    digits: int = 6) -> DataFrame:
    """Events whose mean comment score is under the bound, hottest first. The mean is rounded before the
    comparison so that it does not depend on the order of summation."""
    avg = per_event(comments, F.round(numbers.mean_score(F.col("sentiment_score")), digits).alias("avg_score"))
    out = events.join(avg.filter(F.col("avg_score") < below), "id")
    return out if k is None else out.orderBy(F.col("heat").desc(), F.col("id").asc()).limit(k)


def saved_events(favorites: DataFrame, events: DataFrame, comments: DataFrame, user_id, k: int = 50) -> DataFrame:
    """A user's saved events with event detail and comment count, newest saved first."""
    mine = (favorites.filter(F.col("user_id") == user_id)
            .select(F.col("id").alias("favorite_id"), F.col("event_id").alias("id"), "created_at"))
    rows = (mine.join(events, "id").orderBy(F.col("created_at").desc(), F.col("favorite_id").asc()).limit(k))
    return with_counts(rows, prune=True, comment_count=comments)


def negative_events(events: DataFrame, comments: DataFrame, below: float = 0.3, as_of=None,
                    hours: int | None = None) -> DataFrame:
    """Events with at least one comment under the bound."""
    low = comments.filter(bands.is_negative(F.col("sentiment_score"), bands.Band(below, 1.0)))
    base = events if hours is None else events.filter(times.since(F.col("crawl_time"), as_of, hours=hours))
    ids = low.filter(F.col("event_id").isNotNull()).select("event_id").distinct()
    return base.join(ids, base["id"] == ids["event_id"], "left_semi")


def risky_or_silent_events(events: DataFrame, comments: DataFrame, as_of, least_heat: int = 5000,
                           below: float = 0.4) -> DataFrame:
    """Hot events of one day that have a low or unscored comment, or no comment at all."""
    today = events.filter(times.on_day(F.col("crawl_time"), as_of) & (F.col("heat") >= least_heat))
    low = bands.is_negative(F.col("sentiment_score"), bands.Band(below, 1.0)) | F.col("sentiment_score").isNull()
    talk = per_event(only_events(comments, today), F.count_if(low).alias("low"))
    return today.join(talk, "id", "left").filter(F.col("low").isNull() | (F.col("low") > 0)).drop("low")


def not_stored(incoming: DataFrame, stored: DataFrame, key: str = "comment_id") -> DataFrame:
    return incoming.join(stored.select(key).distinct(), key, "left_anti")


def keyword_hits(df: DataFrame, keywords, text: str = "content", ignore_case: bool = False) -> DataFrame:
    """One row per (row, keyword found in it). Keywords are a short list or an array column; the text is read
    once."""
    array = keywords if isinstance(keywords, Column) else F.array(*[F.lit(k) for k in keywords])
    body = F.lower(F.col(text)) if ignore_case else F.col(text)

    def found(k: Column) -> Column:
        return F.contains(F.col("_body"), F.lower(k) if ignore_case else k)

    return (df.withColumn("_keys", array).withColumn("_body", body)
            .withColumn("keyword", F.explode(F.filter("_keys", found))).drop("_keys", "_body"))


STARTS = (1, 2, 3, 4, 6, 8, 12, 16)  # a keyword is looked up by its first characters, the most of these that it has
FEW_TEXTS = 64  # a key with more different texts is counted pair by pair


def _units(text: Column) -> Column:
    """Four bytes for each character, so that a piece is cut out without a walk from the start of the text."""
    return F.encode(text, "UTF-32")


def keyword_starts(keywords: DataFrame) -> DataFrame:
    """(keyword, gram): every keyword once, with the characters it is looked up by."""
    most = F.array_max(F.filter(F.array(*[F.lit(n) for n in STARTS]), lambda n: n <= F.length("keyword")))
    return (keywords.select("keyword").filter(F.col("keyword") != "").distinct()
            .withColumn("gram", _units(F.substring(F.col("keyword"), F.lit(1), most))))


def marked_pieces(bodies: DataFrame, starts: DataFrame) -> DataFrame:
    """(_hash, gram): the pieces of the texts (_hash, _body) whose bit is set, each once for a text; few others go on to
    the join with the keywords."""
    sizes = starts.agg(F.sort_array(F.collect_set(F.octet_length("gram"))).alias("n")).scalar()  # as many as STARTS at most

    # Positions are rows, not elements of an array: so the pieces are cut and tested in compiled code.
    sized = (bodies.select("_hash", _units(F.col("_body")).alias("_units"), F.explode(sizes).alias("_n"))
             .filter(F.octet_length("_units") >= F.col("_n")))
    last = (F.octet_length("_units") - F.col("_n")).cast("int")
    at = sized.select("_hash", "_units", "_n", F.explode(F.sequence(F.lit(1), last + 1, F.lit(4))).alias("_i"))
    pieces = at.select("_hash", F.substring(F.col("_units"), F.col("_i"), F.col("_n")).alias("gram"))
    return pieces.filter(marks.is_marked(F.col("gram"), marks.of(starts, "gram"))).distinct()


def _text_hits(bodies: DataFrame, keywords: DataFrame) -> DataFrame:
    """(_of, keyword) for texts (_hash, _body), each hash once."""
    starts = keyword_starts(keywords)
    near = marked_pieces(bodies, starts).join(starts, "gram").select(F.col("_hash").alias("_of"), "keyword")
    return (near.join(bodies, F.col("_of") == F.col("_hash")).filter(F.contains(F.col("_body"), F.col("keyword")))
            .select("_of", "keyword"))


def _hashed(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows that have a text, and the texts, each once; both with the hash of the text."""
    rows = df.filter(F.col(text).isNotNull()).select(
        F.col(key), F.md5(F.col(text).cast("binary")).alias("_hash"), F.col(text).alias("_body"))
    return rows, rows.select("_hash", "_body").dropDuplicates(["_hash"])


def keyword_hits_by_join(df: DataFrame, key: str, keywords: DataFrame, text: str = "content") -> DataFrame:
    """(key, keyword) for a keyword table of any size, a row for every row of df and keyword found in it; a keyword may
    be any substring.

    A keyword can only be in a text that holds the keyword's first characters, as many of them as STARTS tells. Pieces
    of each text whose bit is set among those of all keywords meet the keywords in an equal join on that beginning.
    Candidates are found and tested once for each distinct text, known by its hash, and then given to all rows with that
    text, whatever their keys.
    """
    rows, bodies = _hashed(df, key, text)
    found = _text_hits(bodies, keywords)
    return rows.select(key, "_hash").join(found, F.col("_hash") == F.col("_of")).select(key, "keyword")


def keyword_counts_by_join(df: DataFrame, key: str, keywords: DataFrame, text: str = "content") -> DataFrame:
    """(keyword, n, n_ids): the rows that hold each keyword that is found, and the different keys among them, as counted
    from keyword_hits_by_join, without a row for every hit.

    Rows are counted by text. Keys are first grouped by the set of their texts, so a keyword is counted once for each
    distinct set; a key of more than FEW_TEXTS texts gives a row for every keyword in them.
    """
    rows, bodies = _hashed(df, key, text)
    found = _text_hits(bodies, keywords)
    on_text = F.col("_hash") == F.col("_of")
    n = (rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("n")).join(found, on_text)
         .groupBy("keyword").agg(F.sum("n").alias("n")))

    pairs = rows.filter(F.col(key).isNotNull()).select(key, "_hash").distinct()
    wide = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("_texts")).filter(F.col("_texts") > FEW_TEXTS).select(key)
    sets = (pairs.join(wide, key, "left_anti").groupBy(key).agg(F.sort_array(F.collect_list("_hash")).alias("_set"))
            .groupBy("_set").agg(F.count(F.lit(1)).alias("_ids")))
    by_set = (sets.select(F.md5(F.array_join("_set", "")).alias("_name"), "_ids", F.explode("_set").alias("_hash"))
              .join(found, on_text).select("_name", "_ids", "keyword").distinct().select("keyword", "_ids"))
    by_key = (pairs.join(wide, key, "left_semi").join(found, on_text).select(key, "keyword").distinct()
              .select("keyword", F.lit(1).cast("bigint").alias("_ids")))
    ids = by_set.unionByName(by_key).groupBy("keyword").agg(F.sum("_ids").alias("n_ids"))
    return (n.join(ids, "keyword", "left")
            .select("keyword", "n", F.coalesce("n_ids", F.lit(0).cast("bigint")).alias("n_ids")))
