"""Message decoding, resolution, upsert streams, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.textual import CAL, scored_sql
from murmur.operators import metrics, sets
from murmur.sources import readers, writers
from murmur.streaming import decode, histories, ingest, live, tables
from murmur.streaming.folders import remove, shared_folder, stored

SENT = "2024-01-31 00:00:00"


def event_messages(t):
    return t.hot_events.select("title", F.date_format("crawl_time", "yyyy-MM-dd HH:mm:ss").alias("crawl_time"), "heat")


def article_messages(t):
    stamp = F.date_format("publish_time", "yyyy-MM-dd HH:mm:ss")
    return t.articles.select(
        F.col("article_id").cast("string").alias("article_id"), "author", "content", stamp.alias("publish_time"),
        F.col("like_count").cast("int").alias("like_count"), stamp.alias("crawl_time"),
        F.concat(F.lit("topic "), "author").alias("hot_title"), F.col("sentiment_score").cast("double").alias("sentiment_score"))


def hot_title():
    return F.concat("content", F.when(F.col("like_count") % 2 == 0, " 1-URGENT").otherwise(" 9-NEW"))


def comment_messages(t):
    stamp = F.date_format("publish_time", "yyyy-MM-dd HH:mm:ss")
    return t.comments.select(
        F.col("comment_id").cast("string").alias("comment_id"), F.col("user_id").cast("string").alias("user_id"),
        "content", stamp.alias("publish_time"), "location", "like_count", stamp.alias("crawl_time"),
        hot_title().alias("hot_title"), F.col("sentiment_score").cast("double").alias("sentiment_score"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("event_id"))


def sent(t, rows, size=100):
    folder = shared_folder(t.spark, "messages")
    writers.publish_files(writers.envelopes(rows, SENT, size), folder)
    return folder


def send(t, rows, size=100):
    return readers.file_stream(t.spark, sent(t, rows, size))


def streamed(t, *kinds, **options):
    """Sends the messages of the kinds through their streams, one after the other; returns the table root. Messages go
    when they have been read."""
    root, marks = shared_folder(t.spark, "tables"), shared_folder(t.spark, "marks")
    made = {"event": event_messages, "article": article_messages, "comment": comment_messages}
    for kind in kinds:
        folder = sent(t, made[kind](t))
        ingest.run(t.spark, {kind: readers.file_stream(t.spark, folder)}, root, marks, available_now=True, **options)
        remove(t.spark, folder)
    return root


# The message of a comment has its own event id for even events only; others resolve by title.
MESSAGES = """
SELECT *, concat(content, CASE WHEN like_count % 2 = 0 THEN ' 1-URGENT' ELSE ' 9-NEW' END) AS hot_title, CASE WHEN event_id % 2 = 0 THEN event_id END AS own_id FROM comments"""
LAST = "(publish_time, like_count, sentiment_score, content)"

check("a02_decoded_events", """
SELECT title, strftime(crawl_time, '%Y-%m-%d %H:%M:%S') AS crawl_time, heat FROM hot_events""")(
    lambda t: decode.decode(writers.envelopes(event_messages(t), SENT), "event").select("title", "crawl_time", "heat"))

check("a09_envelope_sizes", "SELECT count(*) AS n, 50 AS largest, true AS none_empty FROM articles")(
    lambda t: writers.envelopes(article_messages(t).coalesce(max(1, t.articles.count() // 1000)), SENT, 50)
    .select(F.size(F.from_json("value", "send_time string, data array<string>")["data"]).alias("x"))
    .agg(F.sum("x").alias("n"), F.max("x").alias("largest"), (F.min("x") > 0).alias("none_empty")))

check("a10_keyed_messages", "SELECT title AS key, heat FROM hot_events")(
    lambda t: writers.keyed_messages(event_messages(t), "title", SENT)
    .select("key", F.from_json("value", "data array<struct<heat: bigint>>")["data"][0]["heat"].alias("heat")))

check("a11_export_events", """
SELECT id, title, crawl_time, heat, sentiment_score FROM hot_events
WHERE CAST(crawl_time AS DATE) BETWEEN '1999-01-01' AND '1999-06-30'""")(
    lambda t: writers.export(t.hot_events, "events", "1999-01-01", "1999-06-30"))

check("a12_export_comments", """
SELECT event_id, comment_id, user_id, content, publish_time, location, like_count, sentiment_score FROM comments
WHERE CAST(publish_time AS DATE) BETWEEN '1999-01-01' AND '1999-06-30'""")(
    lambda t: writers.export(t.comments, "comments", "1999-01-01", "1999-06-30", "publish_time"))

check("a13_export_articles", """
SELECT event_id, article_id, author, content, publish_time, like_count, sentiment_score FROM articles
WHERE CAST(publish_time AS DATE) BETWEEN '2024-01-05' AND '2024-01-20'""")(
    lambda t: writers.export(t.articles, "articles", "2024-01-05", "2024-01-20", "publish_time"))

check("a15_export_preview", """
WITH c AS (SELECT 'events' AS kind, count(*) AS n FROM hot_events WHERE CAST(crawl_time AS DATE) BETWEEN '1999-01-01' AND '2024-01-10'
UNION ALL SELECT 'articles', count(*) FROM articles WHERE CAST(publish_time AS DATE) BETWEEN '1999-01-01' AND '2024-01-10'
UNION ALL SELECT 'comments', count(*) FROM comments WHERE CAST(publish_time AS DATE) BETWEEN '1999-01-01' AND '2024-01-10')
SELECT * FROM c UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT) FROM c""")(
    lambda t: writers.export_preview({"events": t.hot_events, "articles": t.articles, "comments": t.comments},
                                     "1999-01-01", "2024-01-10"))


def exported(t):
    folder = shared_folder(t.spark, "export")
    writers.export_all({"events": t.hot_events, "articles": t.articles}, "1990-01-01", "2030-01-01", folder)
    back = t.spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    return back.csv(f"{folder}/articles", schema="event_id long, article_id long, author string, content string, "
                    "publish_time timestamp_ntz, like_count long, sentiment_score double").select(
        "event_id", "article_id", "author", "like_count")


check("a14_exported_files", "SELECT event_id, article_id, author, like_count FROM articles")(exported)

check("a18_valid_events", """
SELECT trim(title) AS title, crawl_time, heat, sentiment_score FROM hot_events WHERE trim(title) <> ''""")(
    lambda t: writers.valid_events(t.hot_events.select(
        "title", F.date_format("crawl_time", "yyyy-MM-dd HH:mm:ss").alias("crawl_time"), "heat", "sentiment_score"),
        SENT).drop("id"))

check("b01_clean_messages", """
SELECT CAST(comment_id AS STRING) AS comment_id, publish_time, CASE WHEN like_count > 40 THEN 'unknown' ELSE location END AS location
FROM comments WHERE like_count > 10""")(
    lambda t: decode.clean(
        comment_messages(t).withColumn("hot_rank", F.lit(1)).withColumn("username", F.lit(None).cast("string"))
        .withColumn("sentiment_type", F.lit(None).cast("string"))
        .withColumn("location", F.when(F.col("like_count") <= 40, F.col("location")))
        .withColumn("publish_time", F.when(F.col("like_count") > 10, F.col("publish_time"))), "comment")
    .select("comment_id", "publish_time", "location"))

def known_events(t):
    """Events of another store: some ids that messages bear are not among them, but every title is."""
    some = t.hot_events.filter("id % 6 <> 0").select("id", "title")
    titles = t.hot_events.groupBy("title").agg(F.min("id").alias("id")).select("id", "title")
    return some.unionByName(titles.join(some, "id", "left_anti"))


check("c02_resolved_titles", """
SELECT m.comment_id, m.tie, coalesce(o.id, e.known_id) AS event_id FROM messages m
LEFT JOIN (SELECT title, min(id) AS known_id FROM hot_events GROUP BY 1) e ON e.title = m.hot_title
LEFT JOIN (SELECT id FROM hot_events WHERE id % 6 <> 0 UNION SELECT min(id) FROM hot_events GROUP BY title) o ON o.id = m.own_id
WHERE coalesce(o.id, e.known_id) IS NOT NULL""", {"messages": MESSAGES})(
    lambda t: ingest.resolved(
        t.comments.select("comment_id", "tie", hot_title().alias("hot_title"),
                          F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("event_id")),
        known_events(t))
    .filter(F.col("event_id") != F.xxhash64("hot_title")).select("comment_id", "tie", "event_id"))

check("c04_unseen_titles", """
SELECT DISTINCT hot_title FROM messages WHERE hot_title NOT IN (SELECT title FROM hot_events)""", {"messages": MESSAGES})(
    lambda t: ingest.unseen_titles(t.comments.select(hot_title().alias("hot_title")),
                                   readers.event_titles(t.hot_events)))

check("d43_batch_quality", """
SELECT count(*) AS "rows", count(*) FILTER (event_id % 7 = 0) AS null_publish_time, count(*) FILTER (like_count = 9) AS null_crawl_time
FROM live_comments""")(
    lambda t: metrics.batch_quality(t.live_comments.withColumn("crawl_time", F.expr(
        "CASE WHEN like_count <> 9 THEN publish_time END")).withColumn(
        "publish_time", F.expr("CASE WHEN event_id % 7 <> 0 THEN publish_time END"))))

TITLE_SCORE = scored_sql("names", "title", "0.5e0")
check("j01_event_stream", f"""
WITH names AS (SELECT title, max(crawl_time) AS crawl_time, arg_max(heat, (crawl_time, heat)) AS heat FROM hot_events GROUP BY 1)
SELECT title, crawl_time, heat, CAST(score AS DECIMAL(4,3)) AS sentiment_score FROM ({TITLE_SCORE})""")(
    lambda t: tables.read_events(t.spark, streamed(t, "event"), CAL).drop("id"))


def streamed_articles(t):
    root = streamed(t, "event", "article")
    events = tables.read_events(t.spark, root).select(F.col("id").alias("event_id"), "title")
    return (tables.read_table(t.spark, root, "articles").join(events, "event_id")
            .select("article_id", "title", "author", "content", "like_count", "sentiment_score", "publish_time"))


check("j02_article_stream", """
SELECT CAST(article_id AS STRING) AS article_id, concat('topic ', author) AS title, author, content, CAST(like_count AS INT) AS like_count,
       sentiment_score, publish_time FROM articles""")(streamed_articles)

# Of the messages of one comment the first places it, the last gives its score; equal ones are ordered by all fields.
PLACED = "(publish_time, like_count, sentiment_score, content, own_id, user_id, location)"
FINAL = f"""
SELECT CAST(comment_id AS STRING) AS comment_id, arg_max(like_count, {PLACED}) AS like_count,
       arg_max(sentiment_score, {PLACED}) AS sentiment_score, arg_min(content, {PLACED}) AS content, min(publish_time) AS publish_time,
       arg_min(location, {PLACED}) AS location, 'unknown' AS username, arg_min(hot_title, {PLACED}) AS hot_title,
       arg_min(own_id, (publish_time, like_count, sentiment_score, content, coalesce(own_id, -1), user_id, location)) AS own_id
FROM messages GROUP BY 1"""


def with_titles(t, root):
    events = tables.read_events(t.spark, root).select(F.col("id").alias("event_id"), "title")
    return (tables.read_table(t.spark, root, "comments").join(events, "event_id", "left")
            .select("comment_id", "content", "like_count", "sentiment_score", "publish_time", "location", "username", "title"))


check("j03_comment_stream", f"SELECT * EXCLUDE (hot_title, own_id), hot_title AS title FROM ({FINAL})", {"messages": MESSAGES})(
    lambda t: with_titles(t, streamed(t, "comment")))


def against_another_store(t):
    """Every streamed comment with its event, and whether that store or this one has the event."""
    spark = t.spark
    root = streamed(t, "comment", known=lambda _: t.hot_events.select("id", "title"))
    here = tables.read_events(spark, root).select(F.col("id").alias("event_id"), F.lit(True).alias("is_here"))
    there = t.hot_events.select(F.col("id").alias("event_id"), F.lit(True).alias("is_there")).distinct()
    rows = tables.read_table(spark, root, "comments").join(here, "event_id", "left").join(there, "event_id", "left")
    stub = F.col("is_here").isNotNull() & F.col("is_there").isNull()
    return rows.select("comment_id", F.when(~stub, F.col("event_id")).alias("event_id"),
                       F.coalesce("is_here", "is_there", F.lit(False)).alias("has_event"))


check("j03_known_events", f"""
SELECT c.comment_id, coalesce(e.id, n.id) AS event_id, true AS has_event FROM ({FINAL}) c
LEFT JOIN hot_events e ON e.id = c.own_id LEFT JOIN (SELECT title, min(id) AS id FROM hot_events GROUP BY 1) n ON n.title = c.hot_title""",
      {"messages": MESSAGES})(against_another_store)


def streamed_scores(t, *compacted):
    """Event scores after the streams, for events that came as messages or stubs."""
    root = streamed(t, "event", "comment")
    for table in compacted:
        tables.compact(t.spark, root, table)
    return tables.read_events(t.spark, root, CAL).select("title", "heat", "sentiment_score")


REFRESHED = f"""
WITH byname AS (SELECT hot_title AS title, CAST(round(CAST(sum(sentiment_score) AS DOUBLE) / count(*), 3) AS DECIMAL(4,3)) AS s
                FROM ({FINAL}) GROUP BY 1),
names AS (SELECT title, arg_max(heat, (crawl_time, heat)) AS heat FROM hot_events GROUP BY 1
          UNION ALL SELECT DISTINCT hot_title, 0 FROM ({FINAL}) WHERE hot_title NOT IN (SELECT title FROM hot_events))
SELECT n.title, n.heat, coalesce(b.s, CAST(n.score AS DECIMAL(4,3))) AS sentiment_score FROM ({TITLE_SCORE}) n LEFT JOIN byname b USING (title)"""
check("j06_refreshed_events", REFRESHED, {"messages": MESSAGES})(streamed_scores)
check("j06_refreshed_after_compaction", REFRESHED, {"messages": MESSAGES})(
    lambda t: streamed_scores(t, "events", "comments", "event_sums", "comments"))


def revised_history(t):
    """The history after three batches: the likes and scores of all comments, other ones, and the first again."""
    root, spark = shared_folder(t.spark, "tables"), t.spark
    for epoch, lag in enumerate((0, 1, 2)):
        shift = F.lit(lag % 2)
        later = comment_messages(t).withColumn("like_count", F.col("like_count") + 7 * shift).withColumn(
            "sentiment_score", F.when((shift == 0) | (F.col("like_count") % 3 > 0), 1 - F.col("sentiment_score")))
        folder = sent(t, later)
        ingest.save_texts(decode.clean(decode.decode(spark.read.text(folder), "comment"), "comment"), epoch, root, "comment")
        remove(spark, folder)
        if epoch == 1:
            tables.compact(spark, root, "comments")
    return tables.read_history(spark, root)


check("d14_hourly_history_of_stream", f"""
SELECT strftime(publish_time, '%Y-%m-%d %H:00') AS hour, round(CAST(sum(coalesce(sentiment_score, 0.5)) AS DOUBLE) / count(*), 6) AS avg_sentiment,
       CAST(count(*) + sum(like_count) AS BIGINT) AS spread FROM ({FINAL}) GROUP BY 1""", {"messages": MESSAGES})(
    lambda t: histories.hourly(tables.read_history(t.spark, streamed(t, "comment")), digits=6))

check("d16_sentiment_trend_of_stream", f"""
SELECT CAST(CAST(publish_time AS DATE) AS VARCHAR) AS date, round(CAST(sum(sentiment_score) AS DOUBLE) / count(sentiment_score), 6) AS avg_sentiment,
       strftime(CAST(publish_time AS DATE), '%m-%d') AS label
FROM ({FINAL}) WHERE content <> '' GROUP BY CAST(publish_time AS DATE) ORDER BY 1 DESC LIMIT 30""", {"messages": MESSAGES})(
    lambda t: histories.trend(tables.read_history(t.spark, streamed(t, "comment")), 30, 6))

# Of a comment's messages in a batch of revised ones, the last by crawl, which here is its publication, gives likes and score.
check("d26_daily_history_of_revised_stream", f"""
SELECT CAST(CAST(publish_time AS DATE) AS VARCHAR) AS date, round(CAST(sum(s) AS DOUBLE) / count(s), 6) AS avg_sentiment, count(s) AS comment_count
FROM (SELECT min(publish_time) AS publish_time, arg_max(1 - sentiment_score, (publish_time, like_count, 1 - sentiment_score, content)) AS s
      FROM messages GROUP BY comment_id) GROUP BY 1 HAVING count(s) > 0""", {"messages": MESSAGES})(
    lambda t: histories.daily(revised_history(t)))


def replayed(t):
    """The same epoch written twice gives the table of writing it once."""
    root = shared_folder(t.spark, "tables")
    folder = sent(t, comment_messages(t))
    rows = decode.clean(decode.decode(t.spark.read.text(folder), "comment"), "comment")
    rows = stored(rows, "rows")
    remove(t.spark, folder)
    for epoch in (0, 0, 1):
        ingest.save_texts(rows, epoch, root, "comment")
    return tables.read_table(t.spark, root, "comments").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("like_count").cast("bigint")).alias("likes"))


check("j07_replay", f"""
SELECT count(*) AS n, CAST(sum(l) AS BIGINT) AS likes FROM (
  SELECT comment_id, arg_max(like_count, {LAST}) AS l FROM comments GROUP BY 1)""")(replayed)

check("j09_rolling_hours", """
SELECT strftime(date_trunc('hour', publish_time), '%Y-%m-%d %H:%M') AS start, event_id, count(*) AS n, CAST(sum(like_count) AS BIGINT) AS likes,
       round(CAST(sum(sentiment_score) AS DOUBLE) / count(*), 6) AS avg_sentiment,
       count(*) FILTER (sentiment_score > 0.7) AS positive_count, count(*) FILTER (sentiment_score BETWEEN 0.3 AND 0.7) AS neutral_count,
       count(*) FILTER (sentiment_score < 0.3) AS negative_count
FROM live_comments GROUP BY 1, 2""")(lambda t: live.rolling(t.live_comments, "hour"))


def streamed_rank(t):
    """All events as snapshots of the rank topic, one snapshot per crawl time."""
    root, marks = shared_folder(t.spark, "tables"), shared_folder(t.spark, "marks")
    rows = event_messages(t).withColumn("rank", F.lit(1))
    ingest.start_rank(send(t, rows), root, marks, available_now=True).awaitTermination()
    tables.compact(t.spark, root, "rank")
    return ingest.read_rank(t.spark, root).select("title", "heat", "crawl_time")


check("a20_latest_snapshot", """
SELECT DISTINCT title, heat, crawl_time FROM hot_events WHERE crawl_time = (SELECT max(crawl_time) FROM hot_events)""")(streamed_rank)


def live_stream(t):
    """The live comments as a stream of JSON lines."""
    folder = shared_folder(t.spark, "live")
    rows = t.live_comments.select("comment_id", "event_id", "user_id", "content", "like_count", "sentiment_score",
                                  F.col("publish_time").cast("string").alias("publish_time"))
    rows.write.json(folder)
    schema = ("comment_id long, event_id long, user_id long, content string, like_count int, sentiment_score decimal(4,3), "
              "publish_time timestamp_ntz")
    return t.spark.readStream.schema(schema).json(folder)


def streamed_hours(t):
    out = shared_folder(t.spark, "hours")
    live.start_rolling(live_stream(t), out, shared_folder(t.spark, "marks"), available_now=True, width="hour").awaitTermination()
    return t.spark.read.parquet(out)


check("j09_streamed_hours", """
SELECT strftime(date_trunc('hour', publish_time), '%Y-%m-%d %H:%M') AS start, event_id, count(*) AS n, CAST(sum(like_count) AS BIGINT) AS likes,
       round(CAST(sum(sentiment_score) AS DOUBLE) / count(*), 6) AS avg_sentiment,
       count(*) FILTER (sentiment_score > 0.7) AS positive_count, count(*) FILTER (sentiment_score BETWEEN 0.3 AND 0.7) AS neutral_count,
       count(*) FILTER (sentiment_score < 0.3) AS negative_count
FROM live_comments
WHERE date_trunc('hour', publish_time) + INTERVAL 1 HOUR <= (SELECT max(publish_time) - INTERVAL 10 MINUTE FROM live_comments)
GROUP BY 1, 2""")(streamed_hours)


def streamed_distinct(t):
    out, marks = shared_folder(t.spark, "distinct"), shared_folder(t.spark, "marks")
    twice = live_stream(t)
    rows = decode.distinct_stream(twice.unionByName(live_stream(t)), "comment_id", delay="40 days")
    (rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", marks)
     .trigger(availableNow=True).start().awaitTermination())
    return t.spark.read.parquet(out).withColumn("publish_time", F.col("publish_time").cast("timestamp_ntz")).select(
        "comment_id", "event_id", "user_id", "content", "like_count", "sentiment_score", "publish_time")


check("f05_distinct_stream", "SELECT comment_id, event_id, user_id, content, like_count, sentiment_score, publish_time FROM live_comments WHERE content <> ''")(streamed_distinct)

check("a08_stub_events", """
SELECT hot_title AS title, CAST(0 AS BIGINT) AS heat, min(publish_time) AS crawl_time FROM messages
WHERE hot_title NOT IN (SELECT title FROM hot_events) GROUP BY 1""", {"messages": MESSAGES})(
    lambda t: ingest.stub_events(t.comments.select(hot_title().alias("hot_title"), F.col("publish_time").alias("crawl_time")),
                                 readers.event_titles(t.hot_events)).drop("sentiment_score"))


def backed_up(t):
    folder = shared_folder(t.spark, "backup")
    writers.raw_backup(t.comments.select("comment_id", "tie", (F.col("event_id") % 50 + 1).alias("hot_rank")), folder)
    return t.spark.read.option("header", True).schema("comment_id long, tie double, hot_rank long").csv(folder)


check("a16_raw_backup", "SELECT comment_id, tie, event_id % 50 + 1 AS hot_rank FROM comments")(backed_up)


def word_list(t):
    folder = shared_folder(t.spark, "words")
    t.raw("part").select(F.concat(F.lit("  "), "p_name", F.lit(" "))).write.text(folder)
    return readers.word_file(t.spark, folder, t.raw("supplier").select(F.col("s_name").alias("word")))


check("a17_word_file", "SELECT DISTINCT trim(p_name) AS word FROM part UNION SELECT s_name FROM supplier")(word_list)

check("a19_valid_comments", """
SELECT comment_id, tie, publish_time, greatest(coalesce(TRY_CAST(l AS INT), 0), 0) AS like_count,
       CASE WHEN content = '' THEN CAST(0.5 AS DECIMAL(4,3)) ELSE CAST(sentiment_score AS DECIMAL(4,3)) END AS sentiment_score
FROM (SELECT * EXCLUDE (content), CASE WHEN like_count = 7 THEN '' ELSE content END AS content,
             CASE WHEN like_count = 9 THEN 'n/a' ELSE CAST(like_count - 5 AS STRING) END AS l FROM comments)""")(
    lambda t: writers.valid_texts(
        t.comments.withColumn("content", F.when(F.col("like_count") == 7, "").otherwise(F.col("content")))
        .withColumn("publish_time", F.date_format("publish_time", "yyyy-MM-dd HH:mm:ss"))
        .withColumn("like_count", F.when(F.col("like_count") == 9, "n/a").otherwise((F.col("like_count") - 5).cast("string"))),
        F.col("sentiment_score")).select("comment_id", "tie", "publish_time", "like_count", "sentiment_score"))

check("b02_filled_messages", """
SELECT CAST(comment_id AS STRING) AS comment_id, coalesce(CASE WHEN like_count <> 3 THEN like_count END, 0) AS like_count,
       'unknown' AS username, coalesce(CASE WHEN like_count <> 4 THEN content END, 'no content') AS content,
       coalesce(CASE WHEN like_count <> 5 THEN sentiment_score END, 0.5) AS sentiment_score, 'neutral' AS sentiment_type
FROM comments""")(
    lambda t: decode.clean(decode.decode(writers.envelopes(
        comment_messages(t).withColumn("content", F.when(F.col("like_count") != 4, F.col("content")))
        .withColumn("sentiment_score", F.when(F.col("like_count") != 5, F.col("sentiment_score")))
        .withColumn("like_count", F.when(F.col("like_count") != 3, F.col("like_count"))), SENT), "comment"), "comment")
    .select("comment_id", "like_count", "username", "content", "sentiment_score", "sentiment_type"))

check("h22_extended_lexicon", """
SELECT DISTINCT word, kind FROM (SELECT content AS word, 'pos' AS kind FROM comments UNION ALL SELECT 'splendid', 'pos'
UNION ALL SELECT 'dreadful', 'neg')""")(
    lambda t: readers.extended_lexicon(t.comments.select(F.col("content").alias("word"), F.lit("pos").alias("kind")),
                                       ["splendid", "splendid"], ["dreadful"]))


# ---- the single steps of the streams

check("a03_decoded_articles", """
SELECT CAST(article_id AS STRING) AS article_id, author, content, CAST(like_count AS INT) AS like_count,
       concat('topic ', author) AS hot_title, CAST(sentiment_score AS DOUBLE) AS sentiment_score FROM articles""")(
    lambda t: decode.decode(writers.envelopes(article_messages(t), SENT), "article")
    .select("article_id", "author", "content", "like_count", "hot_title", "sentiment_score"))

check("a04_event_titles", "SELECT title AS hot_title, min(id) AS known_id FROM hot_events GROUP BY 1")(
    lambda t: readers.event_titles(t.hot_events))


def saved_in_two(t, rows, kind, cut):
    """A table after two batches, the older rows first. The messages are packed and decoded once for both."""
    root, rows = shared_folder(t.spark, "tables"), stored(rows, "rows")
    older, newer = rows.filter(F.col("crawl_time") < F.lit(cut).cast("timestamp_ntz")), rows.filter(
        F.col("crawl_time") >= F.lit(cut).cast("timestamp_ntz"))
    for epoch, batch in enumerate((older, newer)):
        if kind == "event":
            ingest.save_events(batch, epoch, root)
        else:
            ingest.save_texts(batch, epoch, root, kind)
    return root


def cleaned(t, made, kind):
    return decode.clean(decode.decode(writers.envelopes(made(t), SENT), kind), kind)


check("a05_event_upsert", """
SELECT title, max(crawl_time) AS crawl_time, arg_max(heat, (crawl_time, heat)) AS heat FROM hot_events GROUP BY 1""")(
    lambda t: tables.read_events(t.spark, saved_in_two(t, cleaned(t, event_messages, "event"), "event", "1998-01-01"))
    .select("title", "crawl_time", "heat"))


def article_upsert(t):
    """Every article a second time, with other author, more likes and a later crawl."""
    rows = cleaned(t, article_messages, "article")
    again = (rows.withColumn("author", F.lit("someone else")).withColumn("like_count", F.col("like_count") + 1)
             .withColumn("crawl_time", F.col("crawl_time") + F.expr("INTERVAL 90 DAYS")))
    root = saved_in_two(t, rows.unionByName(again), "article", "2024-02-15")
    return tables.read_table(t.spark, root, "articles").select("article_id", "author", "like_count", "publish_time", "crawl_time")


check("a06_article_upsert", """
SELECT CAST(article_id AS STRING) AS article_id, author, CAST(like_count + 1 AS INT) AS like_count, publish_time,
       publish_time + INTERVAL 90 DAY AS crawl_time FROM articles""")(article_upsert)

check("a07_comment_upsert", f"""
SELECT CAST(comment_id AS STRING) AS comment_id, arg_max(like_count, {LAST}) AS like_count,
       arg_max(sentiment_score, {LAST}) AS sentiment_score, arg_min(content, {LAST}) AS content, min(publish_time) AS publish_time
FROM comments GROUP BY 1""")(
    lambda t: tables.read_table(
        t.spark, saved_in_two(t, cleaned(t, comment_messages, "comment"), "comment", "1998-01-01"), "comments")
    .select("comment_id", "like_count", "sentiment_score", "content", "publish_time"))


def named_messages(t):
    return t.comments.select("comment_id", "tie", hot_title().alias("hot_title"), F.col("publish_time").alias("crawl_time"),
                             F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("event_id"))


check("c03_message_id_first", "SELECT comment_id, tie, own_id AS event_id FROM messages WHERE own_id IS NOT NULL",
      {"messages": MESSAGES})(
    lambda t: ingest.resolved(named_messages(t).withColumn("own_id", F.col("event_id")), t.hot_events.select("id", "title"))
    .filter("own_id IS NOT NULL").select("comment_id", "tie", "event_id"))


def resolved_titles(t):
    """Rows without an own id, with the title of the event, known or stub, they were resolved to."""
    known, other = readers.event_titles(t.hot_events), t.hot_events.select("id", "title")
    rows = named_messages(t).filter("event_id IS NULL")
    stubs = ingest.stub_events(rows, known).select(F.col("title").alias("hot_title"), F.xxhash64("title").alias("known_id"))
    ids = known.unionByName(stubs).select(F.col("known_id").alias("event_id"), F.col("hot_title").alias("title"))
    return ingest.resolved(rows, other).join(ids, "event_id").select("comment_id", "tie", "title")


check("c05_resolved_in_one_pass", "SELECT comment_id, tie, hot_title AS title FROM messages WHERE own_id IS NULL",
      {"messages": MESSAGES})(resolved_titles)


check("f02_united_rows", """
SELECT comment_id, tie, hot_title, hot_title NOT IN (SELECT title FROM hot_events) AS is_stub FROM messages""",
      {"messages": MESSAGES})(
    lambda t: sets.stubs_and_known(named_messages(t), readers.event_titles(t.hot_events))
    .select("comment_id", "tie", "hot_title", "is_stub"))


def three_streams(t):
    """Events, articles and comments at the same time, each with its own checkpoint."""
    root, marks = shared_folder(t.spark, "tables"), shared_folder(t.spark, "marks")
    sources = {"event": send(t, event_messages(t)), "article": send(t, article_messages(t)), "comment": send(t, comment_messages(t))}
    ingest.run(t.spark, sources, root, marks, available_now=True)
    counts = metrics.row_count(tables.read_events(t.spark, root)).withColumn("kind", F.lit("events"))
    for kind in ("articles", "comments"):
        counts = counts.unionByName(metrics.row_count(tables.read_table(t.spark, root, kind)).withColumn("kind", F.lit(kind)))
    return counts


check("j05_three_streams", """
SELECT 'events' AS kind, count(*) AS n FROM (SELECT title FROM hot_events UNION SELECT concat('topic ', author) FROM articles
  UNION SELECT hot_title FROM messages)
UNION ALL SELECT 'articles', count(DISTINCT article_id) FROM articles
UNION ALL SELECT 'comments', count(DISTINCT comment_id) FROM comments""", {"messages": MESSAGES})(three_streams)


def capped(t):
    """The article stream in several capped batches."""
    folder, root = shared_folder(t.spark, "messages"), shared_folder(t.spark, "tables")
    writers.publish_files(writers.envelopes(
        article_messages(t).repartition(max(4, t.articles.count() // 10_000), "article_id"), SENT), folder)
    source = readers.file_stream(t.spark, folder, max_files=2)
    ingest.run(t.spark, {"article": source}, root, shared_folder(t.spark, "marks"), available_now=True)
    return tables.read_table(t.spark, root, "articles").select("article_id", "author", "like_count")


check("j08_capped_stream", """
SELECT CAST(article_id AS STRING) AS article_id, author, CAST(like_count AS INT) AS like_count FROM articles""")(capped)


def triggered(t):
    """The event stream as it runs in service: timed micro-batches, stopped when all messages are in."""
    root, marks = shared_folder(t.spark, "tables"), shared_folder(t.spark, "marks")
    query = ingest.start(send(t, event_messages(t)), "event", root, marks, trigger="1 second")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return tables.read_events(t.spark, root).select("title", "heat")


check("j04_timed_stream", "SELECT title, arg_max(heat, (crawl_time, heat)) AS heat FROM hot_events GROUP BY 1")(triggered)
