"""Message schemas, table schemas, and the fill values of each stream."""

from __future__ import annotations

from pyspark.sql import types as T

# Message fields, as the producers send them.
EVENT_MESSAGE = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("crawl_time", T.StringType()),
    T.StructField("heat", T.LongType()),
    T.StructField("sentiment_score", T.DoubleType()),
])

ARTICLE_MESSAGE = T.StructType([
    T.StructField("article_id", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("publish_time", T.StringType()),
    T.StructField("like_count", T.IntegerType()),
    T.StructField("repost_count", T.IntegerType()),
    T.StructField("comment_count", T.IntegerType()),
    T.StructField("crawl_time", T.StringType()),
    T.StructField("hot_rank", T.IntegerType()),
    T.StructField("hot_title", T.StringType()),
    T.StructField("sentiment_score", T.DoubleType()),
    T.StructField("sentiment_type", T.StringType()),
])

COMMENT_MESSAGE = T.StructType([
    T.StructField("comment_id", T.StringType()),
    T.StructField("username", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("publish_time", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("like_count", T.IntegerType()),
    T.StructField("crawl_time", T.StringType()),
    T.StructField("hot_rank", T.IntegerType()),
    T.StructField("hot_title", T.StringType()),
    T.StructField("sentiment_score", T.DoubleType()),
    T.StructField("sentiment_type", T.StringType()),
    T.StructField("event_id", T.LongType()),
])

RANK_MESSAGE = T.StructType([
    T.StructField("rank", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("heat", T.LongType()),
    T.StructField("crawl_time", T.StringType()),
])

# The elements of `data` travel as JSON text and are parsed with the schemas above.
ENVELOPE = T.StructType([
    T.StructField("send_time", T.StringType()),
    T.StructField("data", T.ArrayType(T.StringType())),
])

# A producer may also send one bare object instead of a list.
ENVELOPE_ONE = T.StructType([
    T.StructField("send_time", T.StringType()),
    T.StructField("data", T.StringType()),
])

CORRUPT = "_corrupt"


def whole_envelope(message: T.StructType) -> T.StructType:
    """An envelope with its elements as fields, and its text where any part does not fit."""
    return T.StructType([T.StructField("data", T.ArrayType(message)), T.StructField(CORRUPT, T.StringType())])


REQUIRED = {
    "event": ["title", "crawl_time"],
    "article": ["hot_title", "article_id", "publish_time", "crawl_time"],
    "comment": ["hot_title", "comment_id", "publish_time", "crawl_time"],
    "rank": ["title", "crawl_time"],
}

# What a missing field becomes.
FILLS = {
    "event": {"heat": 0},
    "article": {"like_count": 0, "repost_count": 0, "comment_count": 0, "sentiment_score": 0.5,
                "sentiment_type": "neutral", "author": "unknown", "content": "no content"},
    "comment": {"like_count": 0, "sentiment_score": 0.5, "sentiment_type": "neutral", "username": "unknown",
                "user_id": "unknown", "location": "unknown", "content": "no content"},
    "rank": {"heat": 0},
}

MESSAGES = {"event": EVENT_MESSAGE, "article": ARTICLE_MESSAGE, "comment": COMMENT_MESSAGE, "rank": RANK_MESSAGE}

SCORE = T.DecimalType(4, 3)

HOT_EVENTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("crawl_time", T.TimestampNTZType()),
    T.StructField("heat", T.LongType()),
    T.StructField("sentiment_score", SCORE),
])

ARTICLES = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("article_id", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("publish_time", T.TimestampNTZType()),
    T.StructField("like_count", T.IntegerType()),
    T.StructField("repost_count", T.IntegerType()),
    T.StructField("comment_count", T.IntegerType()),
    T.StructField("crawl_time", T.TimestampNTZType()),
    T.StructField("hot_title", T.StringType()),
    T.StructField("sentiment_score", SCORE),
    T.StructField("sentiment_type", T.StringType()),
])

COMMENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("comment_id", T.StringType()),
    T.StructField("username", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("publish_time", T.TimestampNTZType()),
    T.StructField("location", T.StringType()),
    T.StructField("like_count", T.IntegerType()),
    T.StructField("crawl_time", T.TimestampNTZType()),
    T.StructField("hot_title", T.StringType()),
    T.StructField("sentiment_score", SCORE),
    T.StructField("sentiment_type", T.StringType()),
])
