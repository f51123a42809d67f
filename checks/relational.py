"""Filters, joins, aggregates, rankings and set operations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks.registry import check
from murmur.operators import filters, joins, metrics, ranking, sets

# Both lie inside the data, so a window that runs past them gives other rows.
AS_OF = "2001-06-01"
LIVE = "2024-01-20 12:00:00"
EARLY = "2024-01-06 12:00:00"  # inside the articles of the smallest tables, too
WORD = "Widget"


def before(as_of: str, **ago) -> str:
    return (dt.datetime.fromisoformat(as_of) - dt.timedelta(**ago)).isoformat(sep=" ")


def inside(column: str, as_of: str, **ago) -> str:
    """The trailing window as SQL, both ends included."""
    return f"({column} BETWEEN TIMESTAMP '{before(as_of, **ago)}' AND TIMESTAMP '{as_of}')"


def on(column: str, day: str) -> str:
    return f"(CAST({column} AS DATE) = DATE '{day[:10]}')"

# ---- filters and views

check("b06_event_view", """
SELECT id, title, CASE WHEN length(title) > 50 THEN left(title, 50) || '...' ELSE title END AS summary,
       strftime(crawl_time, '%Y-%m-%d %H:%M:%S') AS crawl_time, heat, heat >= 1000 AS is_high_heat,
       sentiment_score,
       CASE WHEN sentiment_score > 0.7 THEN 'positive' WHEN sentiment_score < 0.3 THEN 'negative' ELSE 'neutral' END
         AS sentiment_type,
       CASE WHEN sentiment_score < 0.3 THEN 'high' WHEN sentiment_score < 0.6 THEN 'medium' ELSE 'low' END AS risk_level
FROM hot_events""")(lambda t: filters.event_view(t.hot_events))

check("b07_comment_view", """
SELECT comment_id, event_id, user_id, location, like_count, content,
       strftime(publish_time, '%Y-%m-%d %H:%M:%S') AS publish_time, sentiment_score,
       CASE WHEN sentiment_score > 0.7 THEN 'positive' WHEN sentiment_score < 0.3 THEN 'negative' ELSE 'neutral' END
         AS sentiment_type, trim(content) <> '' AS is_valid_content
FROM comments""")(lambda t: filters.comment_view(t.comments))

check("b07_article_view", """
SELECT article_id, event_id, author, like_count,
       CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END AS preview,
       strftime(publish_time, '%Y-%m-%d %H:%M:%S') AS publish_time, sentiment_score,
       CASE WHEN sentiment_score > 0.7 THEN 'positive' WHEN sentiment_score < 0.3 THEN 'negative' ELSE 'neutral' END
         AS sentiment_type
FROM articles""")(lambda t: filters.article_view(t.articles))

check("b08_event_search", f"""
WITH p AS (SELECT * FROM hot_events WHERE contains(lower(title), lower('{WORD}')) AND heat >= 1000
           ORDER BY heat DESC, id LIMIT 20 OFFSET 20),
n AS (SELECT event_id, count(*) AS k FROM comments GROUP BY 1)
SELECT p.*, coalesce(n.k, 0) AS comment_count FROM p LEFT JOIN n ON n.event_id = p.id""")(
    lambda t: joins.with_counts(
        filters.page(filters.titled(t.hot_events, WORD, True), ranking.hottest_first(), 2, 20),
        prune=True, comment_count=t.comments))

check("b09_events_between", """
WITH n AS (SELECT event_id, count(*) AS k FROM comments GROUP BY 1)
SELECT e.*, coalesce(n.k, 0) AS comment_count FROM hot_events e LEFT JOIN n ON n.event_id = e.id
WHERE CAST(crawl_time AS DATE) BETWEEN '1998-01-01' AND '1998-12-31' AND heat >= 1000""")(
    lambda t: joins.with_counts(filters.crawled_between(t.hot_events, "1998-01-01", "1998-12-31", True),
                                comment_count=t.comments))

check("b10_comments_between", """
SELECT comment_id, event_id, content, publish_time, tie FROM comments
WHERE content IS NOT NULL AND content <> '' AND CAST(publish_time AS DATE) BETWEEN '1997-03-01' AND '1997-05-31'""")(
    lambda t: filters.published_between(t.comments, "1997-03-01", "1997-05-31").select(
        "comment_id", "event_id", "content", "publish_time", "tie"))

check("b11_comments_by_score", """
SELECT comment_id, event_id, sentiment_score, tie FROM comments
WHERE content <> '' AND sentiment_score BETWEEN 0.2 AND 0.6""")(
    lambda t: filters.scored_between(t.comments, 0.6, 0.2).select("comment_id", "event_id", "sentiment_score", "tie"))

check("b12_valid_content", """
SELECT count(*) FILTER (content IS NOT NULL AND content <> '') AS valid, count(*) AS total FROM (
  SELECT CASE article_id % 7 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE content END AS content FROM articles)""")(
    lambda t: filters.valid_count(t.articles.withColumn("content", F.expr(
        "CASE article_id % 7 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE content END"))))

check("b13_event_by_id", """
SELECT e.*, (SELECT count(*) FROM comments c WHERE c.event_id = e.id) AS comment_count
FROM hot_events e WHERE id = 77""")(
    lambda t: joins.with_counts(filters.by_id(t.hot_events, 77), prune=True, comment_count=t.comments))

check("b13_comment_by_id", "SELECT * FROM live_comments WHERE comment_id = 321")(
    lambda t: filters.by_id(t.live_comments, 321, "comment_id"))

check("b14_events_by_title_exact", """
SELECT e.*, (SELECT count(*) FROM comments c WHERE c.event_id = e.id) AS comment_count
FROM hot_events e WHERE title = 'red widget 2-HIGH'""")(
    lambda t: joins.with_counts(filters.titled(t.hot_events, "red widget 2-HIGH", exact=True), prune=True,
                                comment_count=t.comments))

check("b14_events_by_title_part", """
SELECT e.*, coalesce(n.k, 0) AS comment_count FROM hot_events e
LEFT JOIN (SELECT event_id, count(*) AS k FROM comments GROUP BY 1) n ON n.event_id = e.id
WHERE contains(lower(title), 'gizmo')""")(
    lambda t: joins.with_counts(filters.titled(t.hot_events, "gizmo"), comment_count=t.comments))

check("b15_events_mentioning", """
WITH hit AS (SELECT event_id FROM comments WHERE contains(lower(content), 'ring')
             UNION SELECT event_id FROM articles WHERE contains(lower(content), 'ring'))
SELECT e.*, coalesce(n.k, 0) AS comment_count FROM hot_events e
LEFT JOIN (SELECT event_id, count(*) AS k FROM comments GROUP BY 1) n ON n.event_id = e.id
WHERE e.id IN (SELECT event_id FROM hit) ORDER BY heat DESC, id LIMIT 10 OFFSET 10""")(
    lambda t: joins.with_counts(
        filters.page(filters.mentioning(t.hot_events, t.comments, t.articles, "ring"), ranking.hottest_first(), 2, 10),
        prune=True, comment_count=t.comments))

check("b15_mentioning_total", """
WITH hit AS (SELECT event_id FROM comments WHERE contains(lower(content), 'ring')
             UNION SELECT event_id FROM articles WHERE contains(lower(content), 'ring'))
SELECT count(*) AS total, CAST(ceil(count(*) / 10.0) AS BIGINT) AS total_pages
FROM hot_events e WHERE e.id IN (SELECT event_id FROM hit)""")(
    lambda t: filters.page_count(filters.mentioning(t.hot_events, t.comments, t.articles, "ring"), 10))

check("b16_comment_page", """
SELECT comment_id, event_id, publish_time FROM live_comments ORDER BY publish_time DESC, comment_id
LIMIT 25 OFFSET 50""")(
    lambda t: filters.page(t.live_comments, filters.newest("publish_time", "comment_id"), 3, 25)
    .select("comment_id", "event_id", "publish_time"))

check("b16_comment_page_after", """
SELECT comment_id, event_id, publish_time FROM live_comments
WHERE publish_time < TIMESTAMP '2024-01-15 06:00:00' OR publish_time = TIMESTAMP '2024-01-15 06:00:00' AND comment_id > 40
ORDER BY publish_time DESC, comment_id LIMIT 25""")(
    lambda t: filters.page_after(t.live_comments, "publish_time", "comment_id", "2024-01-15 06:00:00", 40, 25)
    .select("comment_id", "event_id", "publish_time"))

check("b17_trailing_windows", f"""
SELECT count(*) FILTER {inside('publish_time', LIVE, days=7)} AS last_7_days,
       count(*) FILTER {inside('publish_time', LIVE, hours=24)} AS last_24_hours,
       count(*) FILTER {inside('publish_time', LIVE, hours=2)} AS last_2_hours,
       count(*) FILTER (CAST(publish_time AS DATE) = DATE '2024-01-30') AS on_day
FROM live_comments""")(
    lambda t: t.live_comments.agg(
        F.count_if(filters.times.since(F.col("publish_time"), LIVE, days=7)).alias("last_7_days"),
        F.count_if(filters.times.since(F.col("publish_time"), LIVE, hours=24)).alias("last_24_hours"),
        F.count_if(filters.times.since(F.col("publish_time"), LIVE, hours=2)).alias("last_2_hours"),
        F.count_if(filters.times.on_day(F.col("publish_time"), "2024-01-30")).alias("on_day")))

check("b18_texts_with_keyword", f"""
WITH latest AS (SELECT id FROM hot_events WHERE id IN (SELECT event_id FROM replies) ORDER BY crawl_time DESC, id LIMIT 10),
x AS (SELECT 'comment' AS kind, comment_id AS text_id, event_id, content, publish_time FROM replies
      UNION ALL SELECT 'article', article_id, event_id, content, publish_time FROM articles)
SELECT kind, text_id, event_id, publish_time FROM x WHERE event_id IN (SELECT id FROM latest)
  AND content <> '' AND contains(lower(content), 'ed') AND {inside('publish_time', LIVE, days=30)}""")(
    lambda t: sets.texts_of_events(ranking.latest(t.hot_events.join(
        t.replies.select(F.col("event_id").alias("id")).distinct(), "id", "left_semi"), 10), t.replies, t.articles, "ED",
        LIVE, 30).select("kind", "text_id", "event_id", "publish_time"))

check("b19_newest_articles_per_event", """
SELECT article_id, event_id, publish_time, position FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY publish_time DESC, article_id) AS INT) AS position
  FROM articles) WHERE position <= 50""")(
    lambda t: filters.newest_per_event(t.articles, 50, "article_id")
    .select("article_id", "event_id", "publish_time", "position"))

check("b19_comments_of_event", """
SELECT comment_id, event_id, publish_time FROM live_comments WHERE event_id = 7
ORDER BY publish_time DESC, comment_id LIMIT 20""")(
    lambda t: filters.page(filters.by_id(t.live_comments, 7, "event_id"),
                           filters.newest("publish_time", "comment_id"), 1, 20)
    .select("comment_id", "event_id", "publish_time"))

check("b20_events_at_risk", "SELECT id, heat FROM hot_events WHERE sentiment_score < 0.3")(
    lambda t: filters.at_risk(t.hot_events, "high").select("id", "heat"))

check("b20_saved_sorted", """
SELECT f.id, f.event_id, f.created_at, e.heat FROM favorites f JOIN hot_events e ON e.id = f.event_id
WHERE f.user_id = 3 ORDER BY e.heat DESC, f.id""")(
    lambda t: filters.saved_sorted(
        t.favorites.filter("user_id = 3").join(t.hot_events.select(F.col("id").alias("event_id"), "heat"), "event_id"),
        by="heat").select("id", "event_id", "created_at", "heat"))

# ---- joins

check("c01_events_with_counts", """
SELECT e.*, coalesce(n.k, 0) AS comment_count FROM hot_events e
LEFT JOIN (SELECT event_id, count(*) AS k FROM comments GROUP BY 1) n ON n.event_id = e.id""")(
    lambda t: joins.with_counts(t.hot_events, comment_count=t.comments))

check("c06_articles_of_titled_events", """
SELECT a.article_id, a.event_id, e.title, e.heat FROM articles a
JOIN hot_events e ON a.event_id = e.id AND contains(lower(e.title), 'plate')""")(
    lambda t: joins.articles_of_titled(t.articles, t.hot_events, filters.titled(t.hot_events, "plate"))
    .select("article_id", "event_id", "title", "heat"))

check("c07_live_board", f"""
SELECT e.id, e.title, e.heat, e.crawl_time, count(c.comment_id) AS comment_count,
       (SELECT count(*) FROM articles a WHERE a.event_id = e.id) AS article_count,
       round(coalesce(CAST(sum(c.sentiment_score) AS DOUBLE) / count(c.sentiment_score), 0.5), 6) AS avg_sentiment
FROM (SELECT * FROM hot_events WHERE {inside('crawl_time', AS_OF, days=61)} ORDER BY heat DESC, crawl_time DESC, id
      LIMIT 50) e LEFT JOIN comments c ON c.event_id = e.id GROUP BY 1, 2, 3, 4""")(
    lambda t: joins.live_board(t.hot_events, t.comments, t.articles, AS_OF, 50, hours=24 * 61).select(
        "id", "title", "heat", "crawl_time", "comment_count", "article_count",
        F.round("avg_sentiment", 6).alias("avg_sentiment")))

check("c08_low_mean_events", """
SELECT e.id, e.title, e.heat, c.avg_score FROM hot_events e JOIN (
  SELECT event_id, round(CAST(sum(sentiment_score) AS DOUBLE) / count(sentiment_score), 6) AS avg_score
  FROM comments WHERE event_id IS NOT NULL GROUP BY 1) c ON c.event_id = e.id
WHERE c.avg_score < 0.3 ORDER BY e.heat DESC, e.id LIMIT 25""")(
    lambda t: joins.low_mean_events(t.hot_events, t.comments, 0.3, 25).select("id", "title", "heat", "avg_score"))

check("c09_comment_and_article_counts", """
SELECT e.id, (SELECT count(*) FROM comments c WHERE c.event_id = e.id) AS comment_count,
       (SELECT count(*) FROM articles a WHERE a.event_id = e.id) AS article_count FROM hot_events e""")(
    lambda t: joins.with_counts(t.hot_events.select("id"), comment_count=t.comments, article_count=t.articles))

check("c10_saved_events", """
SELECT f.id AS favorite_id, f.created_at, e.id, e.title, e.heat, e.sentiment_score,
       (SELECT count(*) FROM comments c WHERE c.event_id = e.id) AS comment_count
FROM favorites f JOIN hot_events e ON e.id = f.event_id WHERE f.user_id = 4
ORDER BY f.created_at DESC, f.id LIMIT 50""")(
    lambda t: joins.saved_events(t.favorites, t.hot_events, t.comments, 4, 50)
    .select("favorite_id", "created_at", "id", "title", "heat", "sentiment_score", "comment_count"))

check("c11_negative_events", """
SELECT count(DISTINCT e.id) AS n FROM hot_events e LEFT JOIN comments c ON c.event_id = e.id
WHERE c.sentiment_score < 0.3""")(
    lambda t: metrics.row_count(joins.negative_events(t.hot_events, t.comments)))

check("c11_new_negative_events", f"""
SELECT count(DISTINCT e.id) AS n FROM hot_events e LEFT JOIN comments c ON c.event_id = e.id
WHERE c.sentiment_score < 0.3 AND {inside('e.crawl_time', AS_OF, days=7)}""")(
    lambda t: metrics.row_count(joins.negative_events(t.hot_events, t.comments, 0.3, AS_OF, hours=24 * 7)))

check("c12_risky_or_silent_events", """
SELECT count(DISTINCT e.id) AS n FROM hot_events e LEFT JOIN comments c ON c.event_id = e.id
WHERE CAST(e.crawl_time AS DATE) = DATE '1998-08-01' AND e.heat >= 1000
  AND (c.sentiment_score < 0.4 OR c.sentiment_score IS NULL)""")(
    lambda t: metrics.row_count(joins.risky_or_silent_events(t.hot_events, t.comments, "1998-08-01", 1000)))

check("c13_not_stored", """
SELECT comment_id, event_id, tie FROM comments WHERE publish_time >= TIMESTAMP '1999-01-01'
  AND comment_id NOT IN (SELECT comment_id FROM comments WHERE publish_time < TIMESTAMP '1999-01-01')""")(
    lambda t: joins.not_stored(t.comments.filter("publish_time >= timestamp_ntz'1999-01-01'"),
                               t.comments.filter("publish_time < timestamp_ntz'1999-01-01'"))
    .select("comment_id", "event_id", "tie"))

KEYWORDS = ["nicht", "thing", "that", "pour", "worthless", "idiot", "best", "para", "ring"]

check("c14_keyword_hits", f"""
SELECT a.article_id, k.keyword FROM articles a, (SELECT unnest({KEYWORDS}) AS keyword) k
WHERE contains(a.content, k.keyword)""")(
    lambda t: joins.keyword_hits(t.articles, KEYWORDS).select("article_id", "keyword"))

check("c14_keyword_hits_by_join", """
SELECT a.article_id, k.keyword FROM articles a JOIN (SELECT DISTINCT split_part(p_name, ' ', 2) AS keyword FROM part
  UNION SELECT DISTINCT author FROM articles UNION SELECT DISTINCT left(content, 12) FROM replies) k
ON k.keyword <> '' AND contains(a.content, k.keyword)""")(
    lambda t: joins.keyword_hits_by_join(
        t.articles, "article_id", t.raw("part").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("keyword"))
        .union(t.articles.select("author")).union(t.replies.select(F.substring("content", 1, 12)))))

# Ids of comments repeat, and so do their texts; some thousand keywords of all lengths.
MANY = """
SELECT DISTINCT substr(content, CAST(i AS INT), CAST(n AS INT)) AS keyword FROM (SELECT DISTINCT content FROM comments) c,
  range(1, 9) p(i), range(1, 30) l(n)"""
# Rows and different ids of each keyword over all comments. Texts repeat, so the SQL tests each text once.
check("c14_keyword_hits_of_all_comments", f"""
SELECT h.keyword, count(*) AS n, count(DISTINCT c.comment_id) AS n_ids
FROM (SELECT d.content, k.keyword FROM (SELECT DISTINCT content FROM comments) d
      JOIN ({MANY}) k ON k.keyword <> '' AND contains(d.content, k.keyword)) h
JOIN comments c ON c.content = h.content GROUP BY 1""")(
    lambda t: joins.keyword_counts_by_join(
        t.comments, "comment_id",
        t.comments.select("content").distinct().select("content", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("i"))
        .select("content", "i", F.explode(F.sequence(F.lit(1), F.lit(29))).alias("n"))
        .select(F.expr("substring(content, i, n)").alias("keyword"))))

# ---- aggregates

check("d01_event_count", """
SELECT count(*) AS n_events FROM hot_events WHERE contains(lower(title), 'widget') AND heat >= 1000""")(
    lambda t: metrics.event_count(t.hot_events, "widget", True))

check("d02_comment_count", "SELECT count(*) AS comment_count FROM comments")(
    lambda t: metrics.comment_count(t.comments))

check("d02_comment_count_per_event", "SELECT event_id AS id, count(*) AS comment_count FROM comments GROUP BY 1")(
    lambda t: metrics.comment_count(t.comments, per_event=True))

check("d03_mean_likes", """
SELECT event_id AS id, round(CAST(sum(coalesce(like_count, 0)) AS DOUBLE) / count(*), 6) AS avg_likes
FROM comments GROUP BY 1""")(lambda t: metrics.mean_likes(t.comments, True, 6))

check("d04_mean_sentiment", """
SELECT event_id AS id, round(CAST(sum(coalesce(sentiment_score, 0.5)) AS DOUBLE) / count(*), 6) AS avg_sentiment
FROM comments GROUP BY 1""")(lambda t: metrics.mean_sentiment(t.comments, True, 6))

T1 = """count(*) FILTER (sentiment_score > 0.7) AS positive_count,
        count(*) FILTER (sentiment_score BETWEEN 0.3 AND 0.7) AS neutral_count,
        count(*) FILTER (sentiment_score < 0.3) AS negative_count"""
T4 = """count(*) FILTER (sentiment_score > 0.6) AS positive_count,
        count(*) FILTER (sentiment_score BETWEEN 0.4 AND 0.6) AS neutral_count,
        count(*) FILTER (sentiment_score < 0.4) AS negative_count"""

check("d05_sentiment_bands", f"SELECT {T1}, count(*) AS total FROM comments")(
    lambda t: metrics.band_counts(t.comments))

EVENT_BANDS = f"""
SELECT e.id, coalesce(positive_count, 0) AS positive_count, coalesce(neutral_count, 0) AS neutral_count,
       coalesce(negative_count, 0) AS negative_count, coalesce(total, 0) AS total,
       coalesce(round(100.0e0 * positive_count / total, 6), 0.0e0) AS positive_pct,
       coalesce(round(100.0e0 * neutral_count / total, 6), 100.0e0) AS neutral_pct,
       coalesce(round(100.0e0 * negative_count / total, 6), 0.0e0) AS negative_pct
FROM hot_events e LEFT JOIN (SELECT event_id, {T1}, count(*) AS total FROM comments GROUP BY 1) c ON c.event_id = e.id
"""
check("d06_event_bands", EVENT_BANDS)(lambda t: metrics.event_bands(t.hot_events, t.comments, 6))

check("d07_whole_percents", """
WITH s AS (SELECT 100.0e0 * count(*) FILTER (sentiment_score >= 0.7) / count(*) AS p,
                  100.0e0 * count(*) FILTER (sentiment_score < 0.3) / count(*) AS n
           FROM comments WHERE content <> '')
SELECT CAST(round_even(p, 0) AS BIGINT) AS positive,
       CAST(100 - round_even(p, 0) - round_even(n, 0) AS BIGINT) AS neutral,
       CAST(round_even(n, 0) AS BIGINT) AS negative FROM s""")(lambda t: metrics.whole_percents(t.comments))

check("d08_known_mean_sentiment", """
SELECT round(CAST(sum(sentiment_score) AS DOUBLE) / count(sentiment_score), 6) AS avg_sentiment
FROM comments WHERE content <> ''""")(lambda t: metrics.known_mean_sentiment(t.comments, 6))

check("d09_mean_heat", "SELECT round(CAST(sum(heat) AS DOUBLE) / count(*), 6) AS avg_heat FROM hot_events")(
    lambda t: metrics.mean_heat(t.hot_events, 6))

check("d10_risk_index", f"""
WITH neg AS (SELECT DISTINCT event_id FROM comments WHERE sentiment_score < 0.3),
s AS (SELECT count(*) AS n_events, count(*) FILTER (id IN (SELECT event_id FROM neg)) AS n_negative,
             count(*) FILTER (id IN (SELECT event_id FROM neg) AND {inside('crawl_time', AS_OF, hours=1)})
               AS n_negative_hour FROM hot_events),
x AS (SELECT *, round(100.0e0 * n_negative / n_events, 6) AS risk_index,
       CASE WHEN round(100.0e0 * n_negative / n_events) >= 70 THEN 'high'
            WHEN round(100.0e0 * n_negative / n_events) >= 30 THEN 'medium' ELSE 'low' END AS risk_level FROM s)
SELECT *, CASE risk_level WHEN 'high' THEN concat(n_negative_hour, ' new high-risk events in the last hour')
  WHEN 'medium' THEN concat('about ', CAST(round(100.0e0 * n_negative / n_events) AS BIGINT), '% of events are negative')
  ELSE 'no event of obvious high risk' END AS risk_text FROM x""")(
    lambda t: metrics.risk_index(t.hot_events, t.comments, AS_OF, 6))

check("d11_event_coverage", f"""
SELECT count(*) FILTER {on('crawl_time', AS_OF)} AS new_today,
       (SELECT count(DISTINCT event_id) FROM comments) AS covered_events FROM hot_events""")(
    lambda t: metrics.event_coverage(t.hot_events, t.comments, AS_OF))

YESTERDAY = on("publish_time", before(AS_OF, days=1))
check("d12_likes_trend", f"""
WITH s AS (SELECT round(CAST(sum(like_count) AS DOUBLE) / count(*), 6) AS mean_all,
  round(coalesce(CAST(sum(like_count) FILTER {YESTERDAY} AS DOUBLE)
    / count(*) FILTER {YESTERDAY}, 0), 6) AS mean_yesterday FROM comments)
SELECT *, CASE WHEN mean_yesterday = 0 THEN 'none' WHEN mean_all > mean_yesterday THEN 'up'
               WHEN mean_all < mean_yesterday THEN 'down' ELSE 'flat' END AS trend,
       CASE WHEN mean_yesterday = 0 THEN 0 ELSE round(abs(mean_all - mean_yesterday), 6) END AS difference FROM s""")(
    lambda t: metrics.likes_trend(t.comments, AS_OF, 6))

check("d13_negative_ratio_and_spread", """
SELECT event_id AS id, round(100.0e0 * count(*) FILTER (sentiment_score < 0.3) / count(*), 6) AS negative_ratio,
       CAST(count(*) + coalesce(sum(like_count), 0) AS BIGINT) AS spread FROM comments GROUP BY 1""")(
    lambda t: metrics.negative_ratio_and_spread(t.comments, 6))

check("d14_hourly_history", """
SELECT strftime(publish_time, '%Y-%m-%d %H:00') AS hour,
       round(CAST(sum(coalesce(sentiment_score, 0.5)) AS DOUBLE) / count(*), 6) AS avg_sentiment,
       CAST(count(*) + sum(like_count) AS BIGINT) AS spread FROM live_comments GROUP BY 1""")(
    lambda t: metrics.hourly_history(t.live_comments, 6))

check("d15_day_profile", f"""
SELECT CAST(h.h AS INT) AS hour, coalesce(s.a, 0.5e0) AS avg_sentiment, coalesce(s.k, 0) AS spread
FROM range(24) h(h) LEFT JOIN (
  SELECT hour(publish_time) AS h, round(CAST(sum(sentiment_score) AS DOUBLE) / count(*), 6) AS a,
         CAST(count(*) + sum(like_count) AS BIGINT) AS k
  FROM live_comments WHERE {inside('publish_time', LIVE, hours=24)} GROUP BY 1) s ON s.h = h.h""")(
    lambda t: metrics.day_profile(t.live_comments, LIVE, 24, 6))

check("d16_sentiment_trend", """
SELECT CAST(CAST(publish_time AS DATE) AS VARCHAR) AS date,
       round(CAST(sum(sentiment_score) AS DOUBLE) / count(sentiment_score), 6) AS avg_sentiment,
       strftime(CAST(publish_time AS DATE), '%m-%d') AS label
FROM comments WHERE content <> '' GROUP BY CAST(publish_time AS DATE) ORDER BY 1 DESC LIMIT 30""")(
    lambda t: metrics.sentiment_trend(t.comments, 30, 6))

check("d17_daily_sentiment", f"""
SELECT CAST(CAST(publish_time AS DATE) AS VARCHAR) AS date,
       round(CAST(sum(sentiment_score) AS DOUBLE) / count(sentiment_score), 6) AS avg_sentiment
FROM live_comments WHERE {inside('publish_time', LIVE, days=7)} GROUP BY 1""")(
    lambda t: metrics.daily_sentiment(t.live_comments, LIVE, 7, 6))

check("d18_daily_heat", f"""
SELECT CAST(CAST(crawl_time AS DATE) AS VARCHAR) AS date, CAST(sum(heat) AS BIGINT) AS total_heat,
       round(CAST(sum(heat) AS DOUBLE) / count(heat), 6) AS avg_heat
FROM hot_events WHERE {inside('crawl_time', AS_OF, days=30)} GROUP BY 1""")(
    lambda t: metrics.daily_heat(t.hot_events, AS_OF, 30, 6))

check("d19_like_histogram", """
SELECT count(*) FILTER (like_count = 0) AS likes_0, count(*) FILTER (like_count BETWEEN 1 AND 10) AS likes_1_10,
       count(*) FILTER (like_count BETWEEN 11 AND 100) AS likes_11_100, count(*) FILTER (like_count > 100) AS likes_over_100
FROM live_comments""")(lambda t: metrics.like_histogram(t.live_comments))

check("d20_location_counts", """
SELECT location, count(*) AS value FROM comments WHERE location NOT IN ('', 'unknown') GROUP BY 1""")(
    lambda t: metrics.by_location(t.comments))

check("d20_location_sentiment", """
SELECT location, round(CAST(sum(sentiment_score) AS DOUBLE) / count(*), 6) AS value
FROM comments WHERE location NOT IN ('', 'unknown') AND sentiment_score IS NOT NULL GROUP BY 1""")(
    lambda t: metrics.by_location(t.comments, sentiment=True))

check("d21_event_score_bands", """
SELECT count(*) FILTER (sentiment_score > 0.65) AS positive_count,
       count(*) FILTER (sentiment_score BETWEEN 0.35 AND 0.65) AS neutral_count,
       count(*) FILTER (sentiment_score < 0.35) AS negative_count, count(*) AS total FROM hot_events""")(
    lambda t: metrics.event_score_bands(t.hot_events))

check("d22_hour_counts", f"""
SELECT CAST(h.h AS INT) AS hour, coalesce(s.n, 0) AS n FROM range(24) h(h) LEFT JOIN (
  SELECT hour(publish_time) AS h, count(*) AS n FROM live_comments WHERE {inside('publish_time', LIVE, days=7)}
  GROUP BY 1) s ON s.h = h.h""")(lambda t: metrics.hour_counts(t.live_comments, LIVE, 7))

check("d23_minute_series", f"""
SELECT event_id, strftime(publish_time, '%Y-%m-%d %H:%M') AS minute, count(*) AS n,
       round(CAST(sum(sentiment_score) AS DOUBLE) / count(*), 6) AS avg_sentiment
FROM live_comments WHERE {inside('publish_time', LIVE, hours=2)} GROUP BY 1, 2""")(
    lambda t: metrics.minute_series(t.live_comments, LIVE, 2, 6))

check("d24_system_stats", f"""
WITH e AS (SELECT count(*) AS total_events, count(*) FILTER (heat > 4000) AS high_heat_events,
             round(CAST(sum(heat) AS DOUBLE) / count(heat), 6) AS avg_heat
           FROM hot_events WHERE {inside('crawl_time', AS_OF, days=7)}),
c AS (SELECT count(*) AS total_comments, count(DISTINCT user_id) AS unique_users,
             round(CAST(sum(sentiment_score) AS DOUBLE) / count(sentiment_score), 6) AS avg_sentiment, {T1}
      FROM comments WHERE {inside('publish_time', AS_OF, days=7)})
SELECT * FROM e, c""")(
    lambda t: metrics.system_stats(t.hot_events, t.comments, AS_OF, 24 * 7, 4000, "user_id"))

check("d25_period_bands", f"""
SELECT {T4}, count(*) AS total FROM live_comments
WHERE {inside('publish_time', LIVE, days=30)} AND sentiment_score IS NOT NULL""")(
    lambda t: metrics.period_bands(t.live_comments, LIVE, 30))

check("d26_daily_history", f"""
SELECT CAST(CAST(publish_time AS DATE) AS VARCHAR) AS date,
       round(CAST(sum(sentiment_score) AS DOUBLE) / count(*), 6) AS avg_sentiment, count(*) AS comment_count
FROM comments WHERE {inside('publish_time', AS_OF, days=999)} AND sentiment_score IS NOT NULL GROUP BY 1""")(
    lambda t: metrics.daily_history(t.comments, AS_OF, 999))

check("d26_daily_history_until", f"""
SELECT CAST(CAST(publish_time AS DATE) AS VARCHAR) AS date,
       round(CAST(sum(sentiment_score) AS DOUBLE) / count(*), 6) AS avg_sentiment, count(*) AS comment_count
FROM comments WHERE publish_time <= TIMESTAMP '{AS_OF}' AND sentiment_score IS NOT NULL GROUP BY 1""")(
    lambda t: metrics.daily_history(t.comments, AS_OF))

FEATURES = """
SELECT e.id, e.title, e.heat, e.crawl_time, coalesce(c.n, 0) AS comment_count, c.s AS avg_sentiment, c.l AS avg_likes
FROM hot_events e LEFT JOIN (
  SELECT event_id, count(*) AS n, round(CAST(sum(sentiment_score) AS DOUBLE) / count(sentiment_score), 6) AS s,
         round(CAST(sum(like_count) AS DOUBLE) / count(like_count), 6) AS l FROM comments GROUP BY 1) c
ON c.event_id = e.id"""
check("d27_event_features", FEATURES + f" WHERE {inside('e.crawl_time', AS_OF, days=90)}")(
    lambda t: metrics.event_features(t.hot_events, t.comments, AS_OF, 90))

check("d28_comment_stats", """
SELECT event_id AS id, count(*) AS comment_count,
       round(CAST(sum(coalesce(sentiment_score, 0.5)) AS DOUBLE) / count(*), 6) AS avg_sentiment,
       CAST(sum(coalesce(like_count, 0)) AS BIGINT) AS total_likes
FROM comments WHERE event_id IN (SELECT id FROM hot_events WHERE heat >= 1000) GROUP BY 1""")(
    lambda t: metrics.comment_stats(t.comments, filters.high_heat(t.hot_events))
    .withColumn("avg_sentiment", F.round("avg_sentiment", 6)))

check("d29_deep_stats", f"""
WITH s AS (SELECT event_id AS id, count(*) AS total, CAST(sum(like_count) AS BIGINT) AS total_likes, {T1},
             round(CAST(sum(sentiment_score) AS DOUBLE) / count(*), 6) AS avg_sentiment FROM live_comments GROUP BY 1),
h AS (SELECT event_id AS id, strftime(publish_time, '%Y-%m-%d %H') AS hr,
             round(CAST(sum(sentiment_score) AS DOUBLE) / count(*), 3) AS a FROM live_comments GROUP BY 1, 2),
x AS (SELECT id, arg_min(a, hr) AS first_hour, arg_max(a, hr) AS last_hour, count(*) AS active_hours FROM h GROUP BY 1)
SELECT s.*, round(100.0e0 * positive_count / total, 6) AS positive_pct,
       round(100.0e0 * neutral_count / total, 6) AS neutral_pct,
       round(100.0e0 * negative_count / total, 6) AS negative_pct, first_hour, last_hour, active_hours,
       CASE WHEN round(last_hour - first_hour, 3) > 0.1 THEN 'up' WHEN round(last_hour - first_hour, 3) < -0.1 THEN 'down'
            ELSE 'stable' END AS direction FROM s LEFT JOIN x USING (id)""")(
    lambda t: metrics.deep_stats(t.live_comments))

check("d30_event_hours", """
SELECT event_id AS id, strftime(publish_time, '%Y-%m-%d %H:00') AS bucket,
       round(CAST(sum(sentiment_score) AS DOUBLE) / count(*), 6) AS avg_sentiment, count(*) AS n
FROM live_comments GROUP BY 1, 2""")(lambda t: metrics.event_hours(t.live_comments, "hour", 6))

check("d30_event_days", """
SELECT event_id AS id, CAST(CAST(publish_time AS DATE) AS VARCHAR) AS bucket,
       round(CAST(sum(sentiment_score) AS DOUBLE) / count(*), 6) AS avg_sentiment, count(*) AS n
FROM live_comments GROUP BY 1, 2""")(lambda t: metrics.event_hours(t.live_comments, "day", 6))

check("d31_article_bands", """
SELECT event_id AS id, count(*) FILTER (s > 0.7) AS positive_count,
       count(*) FILTER (s BETWEEN 0.3 AND 0.7 OR s IS NULL) AS neutral_count,
       count(*) FILTER (s < 0.3) AS negative_count, count(*) AS total
FROM (SELECT event_id, CASE WHEN quality IS NULL THEN NULL ELSE sentiment_score END AS s FROM articles) GROUP BY 1""")(
    lambda t: metrics.band_counts(
        t.articles.withColumn("sentiment_score", F.when(F.col("quality").isNotNull(), F.col("sentiment_score"))),
        per_event=True, null_is_neutral=True))

RULES = [("machines", "gear|rod|bolt"), ("kitchen", "plate|cold"), ("novelty", "new|gizmo"), ("urgent", "urgent")]
CASES = " ".join(f"WHEN regexp_matches(title, '{p}', 'i') THEN '{n}'" for n, p in RULES)
CATEGORY = f"CASE {CASES} ELSE 'other' END"

check("d32_category_counts", f"""
SELECT {CATEGORY} AS category, count(*) AS n
FROM (SELECT regexp_replace(title, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g') AS title FROM hot_events
      WHERE trim(title) <> '') GROUP BY 1""")(lambda t: ranking.category_counts(t.hot_events, RULES))

check("d33_category_heat", f"""
WITH top AS (SELECT {CATEGORY} AS category, heat FROM hot_events),
s AS (SELECT category, count(*) AS n, CAST(sum(heat) AS BIGINT) AS total_heat FROM top GROUP BY 1)
SELECT k.category, coalesce(n, 0) AS n, coalesce(total_heat, 0) AS total_heat,
       round(coalesce(CAST(total_heat AS DOUBLE) / n, 0), 6) AS avg_heat
FROM (SELECT unnest({[n for n, _ in RULES] + ['missing', 'other']}) AS category) k LEFT JOIN s USING (category)""")(
    lambda t: ranking.category_heat(t.hot_events, RULES + [("missing", "zzzz")], digits=6))

check("d34_titled_by_day", f"""
SELECT CAST(CAST(crawl_time AS DATE) AS VARCHAR) AS date, count(*) AS n, {T4} FROM hot_events
WHERE contains(lower(title), 'widget') GROUP BY 1""")(
    lambda t: metrics.titled_by_day(t.hot_events, "Widget"))

check("d35_duplicate_groups", """
SELECT count(*) AS "groups", CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus FROM (
  SELECT event_id, user_id, content, count(*) AS n FROM live_comments GROUP BY 1, 2, 3 HAVING count(*) > 1)""")(
    lambda t: metrics.duplicate_groups(t.live_comments))

check("d35_duplicate_examples", """
SELECT event_id, user_id, content, count(*) AS n FROM live_comments GROUP BY 1, 2, 3 HAVING count(*) > 1
ORDER BY n DESC, event_id, user_id, content LIMIT 5""")(lambda t: metrics.duplicate_examples(t.live_comments))

DAYS_WITH_DATA = ", ".join(f"count(*) FILTER (d >= DATE '{before(LIVE, days=n)[:10]}') AS days_{n}"
                           for n in (7, 14, 30, 60, 90, 180))
check("d37_daily_availability", f"""
WITH d AS (SELECT DISTINCT CAST(publish_time AS DATE) AS d FROM live_comments
           WHERE sentiment_score IS NOT NULL AND publish_time <= TIMESTAMP '{LIVE}')
SELECT {DAYS_WITH_DATA} FROM d""")(lambda t: metrics.daily_availability(t.live_comments, LIVE))

check("d37_last_points", """
SELECT CAST(CAST(publish_time AS DATE) AS VARCHAR) AS date,
       round(CAST(sum(sentiment_score) AS DOUBLE) / count(*), 6) AS avg_sentiment, count(*) AS comment_count
FROM live_comments GROUP BY 1 ORDER BY 1 DESC LIMIT 7""")(
    lambda t: metrics.last_active_days(metrics.daily_history(t.live_comments), 7))

# ---- rankings

check("e01_heat_ranking", """
SELECT e.*, (SELECT count(*) FROM comments c WHERE c.event_id = e.id) AS comment_count
FROM hot_events e ORDER BY heat DESC, id LIMIT 20""")(lambda t: ranking.heat_ranking(t.hot_events, t.comments, 20))

check("e02_hottest", "SELECT * FROM hot_events ORDER BY heat DESC, id LIMIT 10")(
    lambda t: ranking.hottest(t.hot_events, 10))

check("e02_hottest_of_month", f"""
SELECT * FROM hot_events WHERE {inside('crawl_time', AS_OF, days=30)} ORDER BY heat DESC, id LIMIT 10""")(
    lambda t: ranking.hottest(t.hot_events, 10, AS_OF, 30))

POOL = f"(SELECT *, {CATEGORY} AS category FROM hot_events)"
check("e03_heat_rank_of_category", f"""
SELECT * FROM {POOL} WHERE category = 'kitchen' ORDER BY heat DESC, id LIMIT 20""")(
    lambda t: ranking.heat_rank_of_category(t.hot_events, RULES, "kitchen", 20))

check("e03_heat_rank_all", f"SELECT * FROM {POOL} ORDER BY heat DESC, id LIMIT 50")(
    lambda t: ranking.heat_rank_of_category(t.hot_events, RULES, None, 50))

check("e03_heat_rank_per_category", f"""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY heat DESC, id) AS INT) AS position
               FROM {POOL}) WHERE position <= 5""")(
    lambda t: ranking.heat_rank_per_category(t.hot_events, RULES, 5))

check("e04_latest_events", "SELECT * FROM hot_events ORDER BY crawl_time DESC, id LIMIT 15")(
    lambda t: ranking.latest(t.hot_events, 15))

check("e05_heat_and_sentiment", """
SELECT id, title, heat, coalesce(sentiment_score, 0.5) AS sentiment_score FROM hot_events WHERE heat > 0
ORDER BY heat DESC, id LIMIT 100""")(lambda t: ranking.heat_and_sentiment(t.hot_events, 100))

check("e06_high_risk", """
SELECT e.*, coalesce(c.n, 0) AS comment_count, c.a AS avg_score FROM hot_events e LEFT JOIN (
  SELECT event_id, count(*) AS n, round(CAST(sum(sentiment_score) AS DOUBLE) / count(*), 6) AS a
  FROM comments GROUP BY 1) c ON c.event_id = e.id
WHERE c.a < 0.3 OR e.sentiment_score < 0.3 ORDER BY heat DESC, id LIMIT 50""")(
    lambda t: ranking.high_risk(t.hot_events, t.comments, 50))

check("e07_related_titles", """
SELECT * FROM hot_events WHERE contains(lower(title), 'red widget') AND title <> 'red widget'
ORDER BY heat DESC, id LIMIT 20""")(lambda t: ranking.related_titles(t.hot_events, "red widget"))

check("e08_newest_comments", """
SELECT event_id, comment_id, position, CASE WHEN length(content) > 100 THEN left(content, 100) || '...' ELSE content END
  AS preview FROM (SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY publish_time DESC, comment_id) AS INT)
  AS position FROM replies) WHERE position <= 20""")(
    lambda t: ranking.newest_comments(t.replies).select("event_id", "comment_id", "position", "preview"))

check("e09_heatmap", f"""
SELECT e.*, (SELECT count(*) FROM comments c WHERE c.event_id = e.id) AS comment_count,
       (SELECT count(*) FROM articles a WHERE a.event_id = e.id) AS article_count
FROM hot_events e WHERE {inside('crawl_time', AS_OF, days=30)} ORDER BY heat DESC, id LIMIT 50""")(
    lambda t: ranking.heatmap(t.hot_events, t.comments, t.articles, AS_OF, 30, 50))

check("e10_opinions_on", """
SELECT article_id, CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END AS summary,
       CASE WHEN s > 0.6 THEN 'positive' WHEN s < 0.4 THEN 'negative' ELSE 'neutral' END AS sentiment,
       CAST(publish_time AS VARCHAR) AS publish_time
FROM (SELECT a.*, coalesce(a.sentiment_score, 0.5) AS s FROM articles a JOIN hot_events e ON a.event_id = e.id
      AND contains(lower(e.title), 'rod') WHERE length(a.content) > 10
      ORDER BY e.heat DESC, a.like_count DESC, a.article_id LIMIT 20)""")(
    lambda t: ranking.opinions_on(t.hot_events, t.articles, "rod"))

BOARD = f"""
SELECT e.id, e.title, e.crawl_time, e.heat, e.sentiment_score, b.total AS comment_count, b.positive_count,
       b.neutral_count, b.negative_count, b.positive_pct, b.neutral_pct, b.negative_pct,
       CASE WHEN e.sentiment_score < 0.3 THEN 'high' WHEN e.sentiment_score < 0.6 THEN 'medium' ELSE 'low' END AS risk_level
FROM hot_events e JOIN ({EVENT_BANDS}) b ON b.id = e.id"""
check("e11_event_board", BOARD)(lambda t: ranking.event_board(t.hot_events, t.comments, 6))
check("e11_event_board_page", BOARD + " ORDER BY e.heat DESC, e.id LIMIT 20 OFFSET 40")(
    lambda t: ranking.event_board_page(t.hot_events, t.comments, 3, 20, 6))

check("e13_hot_cards", f"""
SELECT x.*, round_even(m.a * greatest(comment_count, 1), 0) AS estimated_likes FROM ({BOARD}) x,
  (SELECT round(CAST(sum(like_count) AS DOUBLE) / count(*), 1) AS a FROM comments) m
ORDER BY heat DESC, id LIMIT 6""")(lambda t: ranking.hot_cards(t.hot_events, t.comments, 6, 6))

check("e14_monitored", """
SELECT id, keyword, created_at FROM monitors WHERE user_id = 5 ORDER BY created_at DESC, keyword, id LIMIT 50""")(
    lambda t: ranking.monitored(t.monitors, 5).select("id", "keyword", "created_at"))

check("e14_is_saved", """
SELECT p.user_id, p.event_id, f.user_id IS NOT NULL AS is_present
FROM (SELECT user_id % 25 AS user_id, event_id FROM live_comments GROUP BY 1, 2) p
LEFT JOIN (SELECT DISTINCT user_id, event_id FROM favorites) f USING (user_id, event_id)""")(
    lambda t: ranking.present(
        t.live_comments.select((F.col("user_id") % 25).alias("user_id"), "event_id").distinct(),
        t.favorites, ["user_id", "event_id"]))

# ---- sets

check("f01_all_texts", """
SELECT 'comment' AS kind, comment_id AS text_id, event_id, content, publish_time, sentiment_score FROM replies
WHERE content <> '' UNION ALL
SELECT 'article', article_id, event_id, content, publish_time, sentiment_score FROM articles WHERE content <> ''""")(
    lambda t: sets.all_texts(t.replies, t.articles))

check("f01_recent_texts_page", f"""
WITH x AS (SELECT 'comment' AS kind, comment_id AS text_id, publish_time FROM replies WHERE content <> '' UNION ALL
  SELECT 'article', article_id, publish_time FROM articles WHERE content <> '')
SELECT kind, text_id, publish_time FROM x WHERE {inside('publish_time', EARLY, days=4)}
ORDER BY publish_time DESC, kind, text_id LIMIT 30 OFFSET 30""")(
    lambda t: filters.page(sets.all_texts(t.replies, t.articles, as_of=EARLY, days=4),
                           [F.col("publish_time").desc(), F.col("kind"), F.col("text_id")], 2, 30)
    .select("kind", "text_id", "publish_time"))

check("f01_recent_texts_total", f"""
SELECT count(*) AS total, CAST(ceil(count(*) / 30.0) AS BIGINT) AS total_pages FROM (
  SELECT publish_time FROM replies WHERE content <> '' UNION ALL SELECT publish_time FROM articles WHERE content <> '')
WHERE {inside('publish_time', EARLY, days=4)}""")(
    lambda t: filters.page_count(sets.all_texts(t.replies, t.articles, as_of=EARLY, days=4), 30))

check("f03_distinct_texts", "SELECT DISTINCT content FROM articles WHERE trim(content) <> ''")(
    lambda t: sets.distinct_texts(t.articles))

check("f04_without_duplicates", """
SELECT min(comment_id) AS comment_id, event_id, user_id, content FROM live_comments GROUP BY 2, 3, 4""")(
    lambda t: sets.without_duplicates(t.live_comments, key="comment_id")
    .select("comment_id", "event_id", "user_id", "content"))

check("f05_distinct_by_id", """
SELECT * EXCLUDE (r) FROM (
  SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY publish_time DESC, like_count DESC, content DESC,
    event_id DESC, user_id DESC, location DESC, sentiment_score DESC, tie DESC) AS r
  FROM comments WHERE content <> '') WHERE r = 1""")(lambda t: sets.distinct_by_id(t.comments, "comment_id"))

check("f06_active_dates", """
SELECT DISTINCT CAST(CAST(publish_time AS DATE) AS VARCHAR) AS date FROM comments WHERE content <> ''""")(
    lambda t: sets.active_dates(t.comments))

check("f07_recent_or_wider", f"""
SELECT article_id, publish_time FROM articles WHERE {inside('publish_time', LIVE, days=180)}""")(
    lambda t: sets.recent_or_wider(t.articles, LIVE, days=1, least=10**9).select("article_id", "publish_time"))

check("f07_recent_enough", f"""
SELECT article_id, publish_time FROM articles WHERE {inside('publish_time', EARLY, days=4)}""")(
    lambda t: sets.recent_or_wider(t.articles, EARLY, days=4, least=3).select("article_id", "publish_time"))

check("f07_recent_fallback", """
SELECT article_id, publish_time FROM articles WHERE publish_time BETWEEN TIMESTAMP '2023-08-01' AND TIMESTAMP '2024-07-31'""")(
    lambda t: sets.recent_or_wider(t.articles, "2024-07-31", days=7).select("article_id", "publish_time"))


# Every pair of a comment's id and a keyword, folded to one row for each id: their number and their letters.
check("c14_keyword_hits_of_comments", f"""
WITH h AS (
  SELECT d.content, k.keyword FROM (SELECT DISTINCT content FROM comments) d
  JOIN ({MANY}) k ON k.keyword <> '' AND contains(d.content, k.keyword)),
t AS (SELECT content, count(*) AS n, sum(length(keyword)) AS letters FROM h GROUP BY 1)
SELECT c.comment_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(letters) AS BIGINT) AS letters
FROM comments c JOIN t ON t.content = c.content GROUP BY 1""")(
    lambda t: joins.keyword_hits_by_join(
        t.comments, "comment_id",
        t.comments.select("content").distinct().select("content", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("i"))
        .select("content", "i", F.explode(F.sequence(F.lit(1), F.lit(29))).alias("n"))
        .select(F.expr("substring(content, i, n)").alias("keyword")))
    .groupBy("comment_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("keyword")).alias("letters")))
