"""Views that give the star-schema tables the shape of events, comments, articles and replies.

Each view is written for Spark and for DuckDB; both give the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()

_HOT_EVENTS = """
SELECT o.o_orderkey AS id, concat(p.p_name, ' ', o.o_orderpriority) AS title,
       CAST(round(o.o_totalprice / 100) AS BIGINT) AS heat, o.o_orderdate AS crawl_time,
       CAST(round((o.o_orderkey % 11) / 10.0, 3) AS DECIMAL(4,3)) AS sentiment_score
FROM orders o JOIN part p ON p.p_partkey = o.o_orderkey % 200"""

_COMMENTS = """
SELECT l.l_orderkey * 10 + l.l_linenumber AS comment_id, l.l_orderkey AS event_id, l.l_suppkey AS user_id,
       p.p_name AS content, CAST(l.l_quantity AS INT) AS like_count, n.n_name AS location,
       CAST(round(l.l_discount * 10, 3) AS DECIMAL(4,3)) AS sentiment_score,
       l.l_shipdate AS publish_time, l.l_extendedprice AS tie
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey"""

_LIVE_COMMENTS = """
SELECT event_id AS comment_id, user_id % 50 AS event_id, user_id, event_type AS content,
       CAST(floor(value) AS INT) AS like_count,
       CAST(CAST({json}(props, '$.k') AS INT) / 100.0 AS DECIMAL(4,3)) AS sentiment_score, ts AS publish_time
FROM events"""

_ARTICLES = """
SELECT d.doc_id AS article_id, d.doc_id % 50 AS event_id, d.source AS author, d.text AS content, d.lang AS location,
       l.quality, l.toxic, d.n_chars AS like_count,
       CAST((d.n_chars % 101) / 100.0 AS DECIMAL(4,3)) AS sentiment_score,
       {publish} AS publish_time
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""

_REPLIES = """
SELECT c.conv_id * 100 + c.turn AS comment_id, c.conv_id % 50 AS event_id, c.role AS username, c.text AS content,
       CAST((length(c.text) % 101) / 100.0 AS DECIMAL(4,3)) AS sentiment_score,
       {publish} AS publish_time
FROM conversations c"""

_FAVORITES = """
SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS user_id, c_custkey * 10 AS event_id,
       {created} AS created_at
FROM customer"""

_MONITORS = """
SELECT p_partkey AS id, p_partkey % 50 AS user_id, p_name AS keyword, {created} AS created_at
FROM part"""

_SPARK_HOURS = "CAST('2024-01-01 00:00:00' AS TIMESTAMP_NTZ) + make_dt_interval(0, CAST({n} AS INT))"
_DUCK_HOURS = "TIMESTAMP '2024-01-01 00:00:00' + to_hours({n})"
_DOC_HOUR = "d.doc_id % 720"
_REPLY_HOUR = "(c.conv_id * 7 + c.turn) % 720"

SPARK_VIEWS = {
    "hot_events": _HOT_EVENTS,
    "comments": _COMMENTS,
    "live_comments": _LIVE_COMMENTS.format(json="get_json_object"),
    "articles": _ARTICLES.format(publish=_SPARK_HOURS.format(n=_DOC_HOUR)),
    "replies": _REPLIES.format(publish=_SPARK_HOURS.format(n=_REPLY_HOUR)),
    "favorites": _FAVORITES.format(created=_SPARK_HOURS.format(n="c_custkey % 999")),
    "monitors": _MONITORS.format(created=_SPARK_HOURS.format(n="p_partkey % 999")),
}

DUCK_VIEWS = {
    "hot_events": _HOT_EVENTS,
    "comments": _COMMENTS,
    "live_comments": _LIVE_COMMENTS.format(json="json_extract_string"),
    "articles": _ARTICLES.format(publish=_DUCK_HOURS.format(n=_DOC_HOUR)),
    "replies": _REPLIES.format(publish=_DUCK_HOURS.format(n=_REPLY_HOUR)),
    "favorites": _FAVORITES.format(created=_DUCK_HOURS.format(n="c_custkey % 999")),
    "monitors": _MONITORS.format(created=_DUCK_HOURS.format(n="p_partkey % 999")),
}


# Text tables and the column they are dealt out by where the caller asks for it.
TEXT_TABLES = {"documents": "doc_id", "conversations": "conv_id"}
TEXT_PARTS = "murmur.text.parts"


class Tables:
    """The tables of one directory and the views over them. Everything is lazy. Work on texts is bound by the
    processor; `parts`, or the setting murmur.text.parts of the session, deals the text tables out into so many
    partitions. Without it a table is read in the splits of its files, as is right for large ones."""

    def __init__(self, spark: SparkSession, folder: str, parts: int | None = None):
        self.spark = spark
        self.folder = folder
        self.parts = parts or int(spark.conf.get(TEXT_PARTS, "0"))

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return df.repartition(self.parts, TEXT_TABLES[name]) if self.parts and name in TEXT_TABLES else df

    def _view(self, name: str) -> DataFrame:
        used = {t: self.raw(t) for t in TABLES if f" {t}" in SPARK_VIEWS[name]}
        text = SPARK_VIEWS[name]
        for table in used:
            for word in ("FROM", "JOIN"):
                text = text.replace(f"{word} {table}", f"{word} {{{table}}}")
        return self.spark.sql(text, **used)

    @cached_property
    def hot_events(self) -> DataFrame:
        return self._view("hot_events")

    @cached_property
    def comments(self) -> DataFrame:
        return self._view("comments")

    @cached_property
    def live_comments(self) -> DataFrame:
        return self._view("live_comments")

    @cached_property
    def articles(self) -> DataFrame:
        return self._view("articles")

    @cached_property
    def replies(self) -> DataFrame:
        return self._view("replies")

    @cached_property
    def favorites(self) -> DataFrame:
        return self._view("favorites")

    @cached_property
    def monitors(self) -> DataFrame:
        return self._view("monitors")
