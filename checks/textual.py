"""Column expressions over raw fields, word counts, scores and keyword reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.relational import AS_OF, CASES, EARLY, LIVE, RULES, before, inside, on
from murmur.functions import scalars, times, words
from murmur.operators import joins, keywords, metrics, ranking, sets, text

LEX = words.Lexicon(positive=("best", "with", "pour", "nicht", "para", "widget"),
                    negative=("worthless", "idiot", "stupid", "from", "dans", "old"),
                    stopwords=("the", "of", "and", "is", "le", "la", "der", "die"))
CAL = words.Calibration(lexicon=LEX)
STOPS = LEX.stopwords


def tup(items) -> str:
    return "(" + ", ".join(f"'{x}'" for x in items) + ")"


def clean_sql(col: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({col}, ''), "
            r"'https?://\S+', '', 'g'), '@\S+', '', 'g'), '#(\S+)#', '\1', 'g'), "
            r"'[^\p{L}\p{N}_\s，。！？]', '', 'g'), '\s+', ' ', 'g'))")


def words_sql(clean: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({clean}), '[\s，。！？]+'), lambda w: w <> '')"


def scored_sql(table: str, col: str = "content", base: str = "CAST(sentiment_score AS DOUBLE)") -> str:
    """The rows of a table with a calibrated score."""
    return f"""
SELECT * EXCLUDE (_w, _n, _p, _q, _f), CASE WHEN _n = 0 THEN 0.5e0 ELSE greatest(0.0e0, least(1.0e0, round(
  CASE WHEN _p > _q THEN least(1.0e0, {base} + _f * _p) WHEN _q > _p THEN greatest(0.0e0, {base} - _f * _q)
       ELSE {base} END, 3))) END AS score
FROM (SELECT *, least(0.08e0 / (1.0e0 + 0.01e0 * sqrt(_n)), 0.15e0) AS _f FROM (
  SELECT *, len(_w) AS _n, len(list_filter(_w, lambda x: x IN {tup(LEX.positive)})) AS _p,
         len(list_filter(_w, lambda x: x IN {tup(LEX.negative)})) AS _q FROM (
    SELECT *, list_filter({words_sql(clean_sql(col))}, lambda x: x NOT IN {tup(LEX.stopwords)}) AS _w FROM {table})))"""


def weights_sql(texts: str, col: str = "content") -> str:
    """(word, weight) of every word of a table of texts."""
    return f"""
SELECT word, CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE)
       * ln(CAST((SELECT count(*) FROM (SELECT DISTINCT c FROM (SELECT {clean_sql(col)} AS c FROM {texts}) WHERE c <> '')) + 1
            AS DOUBLE) / CAST(df + 1 AS DOUBLE)) AS weight
FROM (SELECT word, count(*) AS n, count(DISTINCT c) AS df FROM (
        SELECT c, unnest({words_sql("c")}) AS word
        FROM (SELECT DISTINCT c FROM (SELECT {clean_sql(col)} AS c FROM {texts}) WHERE c <> '')) GROUP BY 1)"""


def top_sql(texts: str, k: int, col: str = "content", stops=()) -> str:
    cut = f"WHERE word NOT IN {tup(stops)}" if stops else ""
    return f"SELECT * FROM (SELECT * FROM ({weights_sql(texts, col)}) {cut} ORDER BY weight DESC, word LIMIT {k})"


DATES = (f"generate_series(DATE '{before(LIVE, days=29)[:10]}', DATE '{LIVE[:10]}', INTERVAL 1 DAY) d(d)")
RECENT = inside("publish_time", LIVE, days=30)


ALL_TEXTS = """
SELECT 'comment' AS kind, comment_id AS text_id, event_id, content, publish_time, sentiment_score FROM replies
WHERE content <> '' UNION ALL
SELECT 'article', article_id, event_id, content, publish_time, sentiment_score FROM articles WHERE content <> ''"""
EXTRA = {"all_texts": ALL_TEXTS,
         "scored_texts": scored_sql("all_texts"),
         "scored_articles": scored_sql("articles")}


def texts_of(t):
    return sets.all_texts(t.replies, t.articles)


def scored_texts(t):
    return words.with_score(texts_of(t), F.col("sentiment_score"), cal=CAL)


def rounded(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


# ---- raw fields

RAW_COUNT = """CASE l_linenumber % 5 WHEN 0 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), '.5万')
  WHEN 1 THEN concat(CAST(l_suppkey AS STRING), '千') WHEN 2 THEN concat(' ', CAST(l_partkey AS STRING), ' likes')
  WHEN 3 THEN 'like' ELSE concat('x', CAST(CAST(l_quantity AS INT) AS STRING), '万') END"""

check("b03_valid_heat", """
SELECT l_orderkey, l_linenumber, greatest(coalesce(TRY_CAST(CASE l_linenumber % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN
       concat('-', CAST(l_partkey AS STRING)) ELSE CAST(l_partkey AS STRING) END AS BIGINT), 0), 0) AS heat
FROM lineitem""")(lambda t: t.raw("lineitem").select("l_orderkey", "l_linenumber", scalars.valid_heat(F.expr(
    "CASE l_linenumber % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN concat('-', CAST(l_partkey AS STRING)) "
    "ELSE CAST(l_partkey AS STRING) END")).alias("heat")))

RAW_SCORE = ("CASE l_linenumber % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN NULL "
             "WHEN 2 THEN CAST(l_discount * 20 AS STRING) ELSE CAST(l_tax - 0.03 AS STRING) END")
check("b04_valid_score", f"""
SELECT l_orderkey, l_linenumber, greatest(0.0e0, least(1.0e0, round(coalesce(TRY_CAST(r AS DOUBLE), 0.5e0), 3))) AS score
FROM (SELECT *, {RAW_SCORE} AS r FROM lineitem)""")(
    lambda t: t.raw("lineitem").select("l_orderkey", "l_linenumber",
                                       scalars.valid_score(F.expr(RAW_SCORE)).alias("score")))

RAW_TIME = ("CASE event_id % 4 WHEN 0 THEN substr(CAST(ts AS STRING), 1, 19) WHEN 1 THEN substr(CAST(ts AS STRING), 1, 10) "
            "WHEN 2 THEN concat(substr(CAST(ts AS STRING), 1, 10), 'T00') ELSE 'yesterday' END")
check("b05_parse_datetime", f"""
SELECT event_id, CASE WHEN regexp_full_match(r, '\\d{{4}}-\\d\\d-\\d\\d( \\d\\d:\\d\\d:\\d\\d)?') THEN TRY_CAST(r AS TIMESTAMP) END AS crawl_time,
       CASE WHEN regexp_full_match(r, '\\d{{4}}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d') THEN TRY_CAST(r AS TIMESTAMP) END AS publish_time
FROM (SELECT event_id, {RAW_TIME} AS r FROM events)""")(
    lambda t: t.raw("events").select(
        "event_id", scalars.parse_datetime(F.expr(RAW_TIME), date_only=True).alias("crawl_time"),
        scalars.parse_datetime(F.expr(RAW_TIME)).alias("publish_time")))

check("g01_clean_text", f"SELECT article_id, {clean_sql('content')} AS clean FROM articles")(
    lambda t: t.articles.select("article_id", scalars.clean_text(F.col("content")).alias("clean")))

check("g02_clip", """
SELECT article_id, CASE WHEN length(content) > 500 THEN left(content, 500) || '...' ELSE content END AS shown FROM articles""")(
    lambda t: t.articles.select("article_id", scalars.clip(F.col("content"), 500).alias("shown")))

check("g03_score_label", """
SELECT comment_id, tie, CASE WHEN sentiment_score > 0.7 THEN 'positive' WHEN sentiment_score < 0.3 THEN 'negative'
  ELSE 'neutral' END AS label FROM comments""")(
    lambda t: t.comments.select("comment_id", "tie", metrics.bands.label(F.col("sentiment_score")).alias("label")))

check("g04_risk_level", """
SELECT comment_id, tie, CASE WHEN sentiment_score < 0.3 THEN 'high' WHEN sentiment_score < 0.6 THEN 'medium'
  ELSE 'low' END AS risk FROM comments""")(
    lambda t: t.comments.select("comment_id", "tie", metrics.bands.risk_level(F.col("sentiment_score")).alias("risk")))

check("g05_category", f"""
SELECT id, CASE {CASES} ELSE 'other' END AS category FROM hot_events""")(
    lambda t: ranking.with_category(t.hot_events, RULES).select("id", "category"))

check("g06_count_number", f"""
SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(coalesce(CASE
  WHEN contains(r, '万') THEN floor(TRY_CAST(replace(r, '万', '') AS DOUBLE) * 10000)
  WHEN contains(r, '千') THEN floor(TRY_CAST(replace(r, '千', '') AS DOUBLE) * 1000)
  ELSE TRY_CAST(regexp_replace(r, '[^0-9]', '', 'g') AS BIGINT) END, 0) AS BIGINT) AS n
FROM (SELECT *, trim({RAW_COUNT}) AS r FROM lineitem)""")(
    lambda t: t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice",
                                       scalars.count_number(F.expr(RAW_COUNT)).alias("n")))

RAW_HEAT = """CASE o_orderkey % 4 WHEN 0 THEN concat(CAST(o_custkey AS STRING), ',', '000')
  WHEN 1 THEN concat(CAST(o_custkey AS STRING), '.25亿') WHEN 2 THEN concat('top ', CAST(o_custkey AS STRING), ' of 50')
  ELSE concat(CAST(o_custkey AS STRING), '万') END"""
check("g07_heat_number", f"""
SELECT o_orderkey, CAST(coalesce(CASE
  WHEN contains(r, '万') THEN floor(TRY_CAST(replace(r, '万', '') AS DOUBLE) * 10000)
  WHEN contains(r, '亿') THEN floor(TRY_CAST(replace(r, '亿', '') AS DOUBLE) * 100000000)
  ELSE TRY_CAST(regexp_extract(r, '([0-9]+)', 1) AS BIGINT) END, 0) AS BIGINT) AS heat
FROM (SELECT *, replace({RAW_HEAT}, ',', '') AS r FROM orders)""")(
    lambda t: t.raw("orders").select("o_orderkey", scalars.heat_number(F.expr(RAW_HEAT)).alias("heat")))

RAW_POST = """CASE event_id % 3 WHEN 0 THEN concat(' ', substr(CAST(ts AS STRING), 3, 14))
  WHEN 1 THEN concat(substr(CAST(ts AS STRING), 3, 8), ' 来自 phone 12') ELSE 'just now' END"""
check("g08_post_time", f"""
SELECT event_id, CASE WHEN regexp_matches(r, '\\d\\d-\\d{{1,2}}-\\d{{1,2}}') THEN concat('20', regexp_extract(r, '(\\d\\d-\\d\\d-\\d\\d)', 1), ' ',
  CASE WHEN regexp_matches(r, '\\d\\d:\\d\\d') THEN regexp_extract(r, '(\\d\\d:\\d\\d)', 1) ELSE '00:00' END) END AS post_time
FROM (SELECT event_id, {RAW_POST} AS r FROM events)""")(
    lambda t: t.raw("events").select("event_id", scalars.post_time(F.expr(RAW_POST)).alias("post_time")))

check("g09_time_and_place", f"""
SELECT event_id, trim(split_part(r, '来自', 1)) AS time_text,
       CASE WHEN contains(r, '来自') THEN trim(regexp_replace(trim(split_part(r, '来自', 2)), '\\d+', '', 'g')) ELSE 'unknown' END AS place
FROM (SELECT event_id, {RAW_POST} AS r FROM events)""")(
    lambda t: t.raw("events").select("event_id", scalars.time_part(F.expr(RAW_POST)).alias("time_text"),
                                     scalars.place_part(F.expr(RAW_POST)).alias("place")))

check("g10_surrogate_ids", """
SELECT article_id, md5(concat(author, '_', content)) AS made,
       CASE WHEN event_id % 2 = 0 THEN CAST(article_id AS STRING) ELSE md5(concat(CAST(event_id AS STRING), '_', content)) END AS comment_key
FROM articles""")(
    lambda t: t.articles.select(
        "article_id", scalars.article_key(F.col("author"), F.col("content")).alias("made"),
        scalars.comment_key(F.expr("CASE WHEN event_id % 2 = 0 THEN CAST(article_id AS STRING) ELSE '' END"),
                            F.expr("CAST(event_id AS STRING)"), F.col("content")).alias("comment_key")))

check("g11_key_sentence", """
SELECT article_id, coalesce(trim(list_filter(string_split(translate(content, '！？!?', '。。..'), '。'),
       lambda s: contains(s, 'thing') AND length(s) >= 10)[1]), left(content, 100)) AS sentence FROM articles""")(
    lambda t: t.articles.select("article_id", scalars.key_sentence(F.col("content"), "thing").alias("sentence")))

check("g12_plain_words", r"""
SELECT word, count(*) AS n FROM (
  SELECT unnest(regexp_split_to_array(translate(content, '，。！？,."', '       '), '\s+')) AS word FROM articles)
WHERE length(word) >= 2 AND word NOT IN ('the', 'and', 'of') GROUP BY 1 ORDER BY n DESC, word LIMIT 20""")(
    lambda t: t.articles.select(F.explode(scalars.plain_words(F.col("content"), "the", ["and", "of"])).alias("word"))
    .groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "word").limit(20))

check("g13_words", f"""
SELECT word, count(*) AS n, count(DISTINCT article_id) AS texts FROM (
  SELECT article_id, unnest({words_sql(clean_sql('content'))}) AS word FROM articles)
WHERE word NOT IN {tup(STOPS)} GROUP BY 1""")(
    lambda t: t.articles.select("article_id", F.explode(words.words_of(F.col("content"), STOPS)).alias("word"))
    .groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("article_id").alias("texts")))

check("g14_time_labels", """
SELECT comment_id, strftime(publish_time, '%Y-%m-%d %H:%M') AS minute, strftime(publish_time, '%Y-%m-%d %H:00') AS hour,
       CAST(CAST(publish_time AS DATE) AS VARCHAR) AS date, CAST(hour(publish_time) AS INT) AS hour_of_day,
       strftime(publish_time, '%m-%d') AS month_day FROM live_comments""")(
    lambda t: t.live_comments.select(
        "comment_id", times.minute_label(F.col("publish_time")).alias("minute"),
        times.hour_label(F.col("publish_time")).alias("hour"), times.day(F.col("publish_time")).alias("date"),
        F.hour("publish_time").alias("hour_of_day"), times.month_day(F.col("publish_time")).alias("month_day")))

check("g15_calendar_counts", """
SELECT CAST(CAST(d.d AS DATE) AS VARCHAR) AS date, count(c.comment_id) AS n
FROM generate_series(DATE '2023-12-30', DATE '2024-01-31', INTERVAL 1 DAY) d(d)
LEFT JOIN live_comments c ON CAST(c.publish_time AS DATE) = CAST(d.d AS DATE) GROUP BY 1""")(
    lambda t: times.calendar(t.spark, "2023-12-30", "2024-01-31").join(
        metrics.daily(t.live_comments, F.count(F.lit(1)).alias("n")), "date", "left").fillna(0, ["n"]))

check("g16_time_factor", f"""
SELECT id, round(least(greatest(exp(-0.1e0 * (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(crawl_time)) / 3.6e9 / 24.0e0), 0.1e0), 1.0e0), 6)
  AS factor FROM hot_events""")(
    lambda t: t.hot_events.select("id", F.round(times.time_factor(F.col("crawl_time"), AS_OF), 6).alias("factor")))

# ---- scores of texts

check("h01_calibrated_score", f"SELECT kind, text_id, score FROM ({scored_sql('all_texts')})", EXTRA)(
    lambda t: scored_texts(t).select("kind", "text_id", "score"))

check("h01_calibrated_score_by_table", "SELECT article_id, score FROM scored_articles", EXTRA)(
    lambda t: words.scored_by_join(
        t.articles, "article_id", F.col("sentiment_score"),
        t.spark.createDataFrame([(w, "pos") for w in LEX.positive] + [(w, "neg") for w in LEX.negative]
                                + [(w, "stop") for w in LEX.stopwords], "word string, kind string"), cal=CAL))

check("h02_rescored_table", """
SELECT article_id, score AS sentiment_score,
       CASE WHEN score > 0.7 THEN 'positive' WHEN score < 0.3 THEN 'negative' ELSE 'neutral' END AS sentiment_type
FROM scored_articles""", EXTRA)(
    lambda t: text.rescored(t.articles, F.col("sentiment_score"), cal=CAL)
    .select("article_id", "sentiment_score", "sentiment_type"))

check("h03_keywords", f"SELECT word, round(weight, 6) AS weight FROM ({top_sql('all_texts', 50, stops=STOPS)})", EXTRA)(
    lambda t: rounded(text.keywords(texts_of(t), 50, stopwords=STOPS), "weight"))

check("h03_keywords_filter_last", f"""
SELECT word, round(weight, 6) AS weight FROM ({top_sql('all_texts', 50)}) WHERE word NOT IN {tup(STOPS)}""", EXTRA)(
    lambda t: text.keywords(texts_of(t), 50, stopwords=STOPS, filter_first=False)
    .select("word", F.round("weight", 6).alias("weight")))

check("h04_word_counts", f"""
SELECT word, count(*) AS n FROM (SELECT unnest({words_sql(clean_sql('content'))}) AS word FROM all_texts)
WHERE length(word) > 1 AND NOT regexp_full_match(word, '[0-9]+') GROUP BY 1 ORDER BY n DESC, word LIMIT 20""", EXTRA)(
    lambda t: text.word_counts(texts_of(t), 20))

WORDS = ["nicht", "thing", "that", "pour", "worthless", "idiot", "best", "para", "Andthe", "zzz"]


def polarity_sql(texts: str, kws: str, score: str = "score") -> str:
    return f"""
SELECT keyword, coalesce(p, 0) AS positive_count, coalesce(u, 0) AS neutral_count, coalesce(q, 0) AS negative_count,
       CASE WHEN p > q AND p > u THEN 'positive' WHEN q > p AND q > u THEN 'negative' ELSE 'neutral' END AS sentiment
FROM (SELECT keyword, count(*) FILTER ({score} > 0.6) AS p, count(*) FILTER ({score} BETWEEN 0.4 AND 0.6) AS u,
             count(*) FILTER ({score} < 0.4) AS q
      FROM {kws} LEFT JOIN {texts} ON contains(content, keyword) GROUP BY 1)"""


WORD_LIST = f"(SELECT unnest({WORDS}) AS keyword)"
check("h05_polarity", polarity_sql("scored_texts", WORD_LIST), EXTRA)(
    lambda t: keywords.polarity(scored_texts(t), WORDS, "score"))

check("h06_keyword_report", f"""
WITH k AS ({top_sql('all_texts', 30, stops=STOPS)}), s AS ({polarity_sql('all_texts', '(SELECT word AS keyword FROM k)', 'sentiment_score')})
SELECT s.keyword, round(k.weight * 100, 6) AS frequency, s.sentiment FROM k JOIN s ON s.keyword = k.word""", EXTRA)(
    lambda t: keywords.report(texts_of(t), 30, STOPS, 6))

RESCORED = f"""
WITH k AS ({top_sql('all_texts', 30, stops=STOPS)}), s AS ({polarity_sql('scored_texts', '(SELECT word AS keyword FROM k)')})
SELECT s.keyword, round(k.weight * 100, 6) AS frequency, s.sentiment FROM k JOIN s ON s.keyword = k.word"""
check("h06_keyword_report_rescored", RESCORED, EXTRA)(lambda t: keywords.report(scored_texts(t), 30, STOPS, 6, "score"))

check("h06_keyword_report_page", f"""
SELECT * FROM ({RESCORED}) ORDER BY frequency DESC, keyword LIMIT 7 OFFSET 7""", EXTRA)(
    lambda t: keywords.report_page(keywords.report(scored_texts(t), 30, STOPS, 6, "score"), 2, 7))

TIMELINE = f"""
SELECT CAST(CAST(d.d AS DATE) AS VARCHAR) AS date, k.keyword, count(x.text_id) AS n
FROM {DATES} CROSS JOIN {WORD_LIST} k LEFT JOIN (SELECT * FROM all_texts WHERE {RECENT}) x
  ON CAST(x.publish_time AS DATE) = CAST(d.d AS DATE) AND contains(lower(x.content), lower(k.keyword)) GROUP BY 1, 2"""
check("h07_timeline", TIMELINE, EXTRA)(lambda t: keywords.timeline(texts_of(t), WORDS, LIVE, 30))

check("h07_timeline_wide", f"""
SELECT date, CAST(max(n) FILTER (keyword = 'that') AS BIGINT) AS "that", CAST(max(n) FILTER (keyword = 'nicht') AS BIGINT) AS nicht
FROM ({TIMELINE}) GROUP BY 1""", EXTRA)(
    lambda t: keywords.timeline_wide(keywords.timeline(texts_of(t), WORDS, LIVE, 30), ["that", "nicht"]))

VARIATION = f"""
SELECT keyword, CAST(sum(n) AS BIGINT) AS total,
       sqrt(CAST(count(*) * sum(n * n) - sum(n) * sum(n) AS DOUBLE)) / CAST(sum(n) AS DOUBLE) AS cv
FROM ({TIMELINE}) GROUP BY 1 HAVING sum(n) > 0"""
check("h08_burst_words", f"""
SELECT keyword, total, round(cv, 6) AS cv FROM ({VARIATION}) WHERE cv > 0.5 AND total > 5 ORDER BY cv DESC, keyword LIMIT 5""", EXTRA)(
    lambda t: keywords.burst_words(keywords.timeline(texts_of(t), WORDS, LIVE, 30), digits=6))
check("h08_longtail_words", f"""
SELECT keyword, total, round(cv, 6) AS cv FROM ({VARIATION}) WHERE cv < 5 AND total > 3 ORDER BY total DESC, keyword LIMIT 5""", EXTRA)(
    lambda t: keywords.longtail_words(keywords.timeline(texts_of(t), WORDS, LIVE, 30), below=5, digits=6))

check("h09_burst_points", """
SELECT date, n, prev_n, round(CAST(n AS DOUBLE) / prev_n, 6) AS change_rate, 'burst' AS type FROM (
  SELECT date, n, lag(n) OVER (ORDER BY date) AS prev_n, count(*) OVER () AS days FROM (
    SELECT CAST(CAST(publish_time AS DATE) AS VARCHAR) AS date, count(*) AS n FROM all_texts
    WHERE contains(lower(content), 'that') GROUP BY 1))
WHERE days >= 3 AND prev_n > 0 AND CAST(n AS DOUBLE) / prev_n >= 1.1""", EXTRA)(
    lambda t: keywords.burst_points(texts_of(t), "that", threshold=1.1, digits=6))

check("h10_cooccurrence", f"""
SELECT a.keyword AS source, b.keyword AS target, count(*) AS n FROM all_texts
JOIN {WORD_LIST} a ON contains(content, a.keyword) JOIN {WORD_LIST} b ON contains(content, b.keyword) AND a.keyword < b.keyword
GROUP BY 1, 2 HAVING count(*) >= 2""", EXTRA)(lambda t: keywords.cooccurrence(texts_of(t), WORDS))

NODES = f"""
WITH k AS ({top_sql('all_texts', 20, stops=STOPS)}), s AS ({polarity_sql('all_texts', '(SELECT word AS keyword FROM k)', 'sentiment_score')})
SELECT s.keyword, round(k.weight, 6) AS value, s.sentiment, CAST(greatest(15, least(60, CAST(floor(k.weight * 100) AS INT))) AS INT) AS size
FROM k JOIN s ON s.keyword = k.word"""
check("h10_network_nodes", NODES, EXTRA)(lambda t: keywords.network_nodes(texts_of(t), 20, STOPS, 6))

check("h10_network_nodes_rescored", NODES.replace("JOIN all_texts ON", "JOIN scored_texts ON").replace("sentiment_score", "score"), EXTRA)(
    lambda t: keywords.network_nodes(scored_texts(t), 20, STOPS, 6, "score"))

check("h10_network_links", f"""
WITH k AS ({top_sql('all_texts', 20, stops=STOPS)})
SELECT a.word AS source, b.word AS target, count(*) AS n FROM all_texts
JOIN k a ON contains(content, a.word) JOIN k b ON contains(content, b.word) AND a.word < b.word
GROUP BY 1, 2 HAVING count(*) >= 2""", EXTRA)(lambda t: keywords.network_links(texts_of(t), 20, STOPS))

check("h11_drivers", f"""
WITH hit AS (SELECT * FROM all_texts WHERE contains(lower(content), 'worthless')),
k AS ({top_sql('hit', 10, stops=['worthless'])}),
s AS ({polarity_sql('hit', '(SELECT word AS keyword FROM k)', 'sentiment_score')})
SELECT s.keyword, round(k.weight, 6) AS weight, CASE WHEN positive_count > negative_count THEN 'positive' ELSE 'negative' END AS sentiment,
       positive_count, negative_count FROM k JOIN s ON s.keyword = k.word WHERE positive_count + negative_count > 0""", EXTRA)(
    lambda t: keywords.drivers(texts_of(t), "worthless"))

check("h11_drivers_rescored", f"""
WITH hit AS (SELECT * FROM scored_texts WHERE contains(lower(content), 'worthless')),
k AS ({top_sql('hit', 10, stops=['worthless'])}), s AS ({polarity_sql('hit', '(SELECT word AS keyword FROM k)')})
SELECT s.keyword, round(k.weight, 6) AS weight, CASE WHEN positive_count > negative_count THEN 'positive' ELSE 'negative' END AS sentiment,
       positive_count, negative_count FROM k JOIN s ON s.keyword = k.word WHERE positive_count + negative_count > 0""", EXTRA)(
    lambda t: keywords.drivers(scored_texts(t), "worthless", score="score"))

check("h11_driver_bands", """
SELECT count(*) FILTER (sentiment_score > 0.6) AS positive_count, count(*) FILTER (sentiment_score BETWEEN 0.4 AND 0.6) AS neutral_count,
       count(*) FILTER (sentiment_score < 0.4) AS negative_count, count(*) AS total FROM all_texts WHERE contains(lower(content), 'worthless')""",
      EXTRA)(lambda t: keywords.driver_bands(texts_of(t), "worthless"))

check("h12_opinions", """
WITH top AS (SELECT * FROM all_texts WHERE contains(lower(content), 'that') AND length(content) >= 10
  ORDER BY publish_time DESC, kind, text_id LIMIT 10),
s AS (SELECT *, coalesce(trim(list_filter(string_split(translate(content, '！？!?', '。。..'), '。'),
        lambda s: contains(s, 'that') AND length(s) >= 10)[1]), left(content, 100)) AS sentence FROM top)
SELECT kind, text_id, CASE WHEN length(sentence) > 200 THEN left(sentence, 200) || '...' ELSE sentence END AS summary,
       CASE WHEN sentiment_score > 0.6 THEN 'positive' WHEN sentiment_score < 0.4 THEN 'negative' ELSE 'neutral' END AS sentiment,
       CAST(publish_time AS VARCHAR) AS publish_time FROM s""", EXTRA)(
    lambda t: keywords.opinions(texts_of(t), "that"))

check("h14_sentiment_by_date", f"""
SELECT CAST(CAST(d.d AS DATE) AS VARCHAR) AS date, count(*) FILTER (x.score > 0.6) AS positive_count,
       count(*) FILTER (x.score BETWEEN 0.4 AND 0.6) AS neutral_count, count(*) FILTER (x.score < 0.4) AS negative_count
FROM {DATES} LEFT JOIN (SELECT * FROM scored_texts WHERE {RECENT}) x
  ON CAST(x.publish_time AS DATE) = CAST(d.d AS DATE) GROUP BY 1""", EXTRA)(
    lambda t: keywords.sentiment_by_date(scored_texts(t), LIVE, 30, "score"))

COMPARED = f"""
WITH x AS (SELECT *, CAST(CAST(publish_time AS DATE) AS VARCHAR) AS date FROM all_texts WHERE {{}})
SELECT d.date, k.keyword, count(x.text_id) AS n, CAST(sum(count(x.text_id)) OVER (PARTITION BY k.keyword) AS BIGINT) AS total
FROM (SELECT DISTINCT date FROM x) d CROSS JOIN {WORD_LIST} k LEFT JOIN x ON x.date = d.date AND contains(lower(x.content), lower(k.keyword))
GROUP BY 1, 2"""
check("h15_compare", COMPARED.format("true"), EXTRA)(lambda t: keywords.compare(texts_of(t), WORDS))
check("h15_compare_recent", COMPARED.format(inside("publish_time", EARLY, days=4)), EXTRA)(
    lambda t: keywords.compare(texts_of(t), WORDS, EARLY, 4))

check("h16_keyword_trend", f"""
SELECT CAST(CAST(publish_time AS DATE) AS VARCHAR) AS date, count(*) FILTER (sentiment_score > 0.1) AS positive_count,
       count(*) FILTER (sentiment_score BETWEEN -0.1 AND 0.1) AS neutral_count,
       count(*) FILTER (sentiment_score < -0.1) AS negative_count, count(*) AS total
FROM all_texts WHERE contains(lower(content), 'nicht') AND {RECENT} GROUP BY 1""", EXTRA)(
    lambda t: keywords.keyword_trend(texts_of(t), "nicht", LIVE, 30))

check("h17_co_words", r"""
SELECT name, count(*) AS n FROM (
  SELECT unnest(regexp_split_to_array(translate(concat(a.content, ' ', e.title), '，。！？,."', '       '), '\s+')) AS name
  FROM articles a JOIN hot_events e ON e.id = a.event_id AND contains(lower(e.title), 'rod'))
WHERE length(name) >= 2 AND name <> 'rod' GROUP BY 1 ORDER BY n DESC, name LIMIT 20""")(
    lambda t: keywords.co_words(t.articles, t.hot_events, "rod"))

check("h18_hot_words", f"""
WITH recent_titles AS (SELECT title FROM hot_events WHERE {inside('crawl_time', AS_OF, days=30)})
SELECT word, round(weight, 6) AS weight FROM ({top_sql('recent_titles', 20, 'title', STOPS)})""")(
    lambda t: rounded(keywords.hot_words(t.hot_events, AS_OF, 30, stopwords=STOPS), "weight"))

check("h19_word_cloud", f"""
WITH recent AS (SELECT * FROM articles WHERE {inside('publish_time', EARLY, days=7)})
SELECT word, round(weight, 6) AS weight, round(weight * 1000, 3) AS frequency FROM ({top_sql('recent', 50, stops=STOPS)})""")(
    lambda t: rounded(keywords.word_cloud(t.articles, EARLY, 7, 50, STOPS, digits=3), "weight"))

check("h20_high_risk_words", f"""
WITH low AS (SELECT * FROM replies WHERE sentiment_score < 0.3 AND content <> ''),
k AS ({top_sql('low', 10, stops=STOPS)})
SELECT word, round(weight, 6) AS weight, CAST(row_number() OVER (ORDER BY weight DESC, word) AS INT) AS position,
       round(1.0e0 - (row_number() OVER (ORDER BY weight DESC, word) - 1) * 0.05e0, 2) AS display_weight FROM k""")(
    lambda t: rounded(keywords.high_risk_words(t.replies, stopwords=STOPS), "weight"))

PER_EVENT = f"""
SELECT event_id, word, round(weight, 6) AS weight, position FROM (
WITH src AS (SELECT event_id, content FROM replies UNION ALL SELECT id, title FROM hot_events),
docs AS (SELECT DISTINCT event_id, c FROM (SELECT event_id, {clean_sql('content')} AS c FROM src) WHERE c <> ''),
tok AS (SELECT event_id, c, unnest({words_sql('c')}) AS word FROM docs),
cnt AS (SELECT event_id, word, count(*) AS n, count(DISTINCT c) AS df FROM tok GROUP BY 1, 2),
w AS (SELECT event_id, word, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY event_id) AS DOUBLE)
        * ln(CAST((SELECT count(*) FROM docs) + 1 AS DOUBLE) / CAST(sum(df) OVER (PARTITION BY word) + 1 AS DOUBLE)) AS weight FROM cnt)
SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY weight DESC, word) AS INT) AS position FROM w) WHERE position <= 30"""
check("h21_keywords_per_event", PER_EVENT)(
    lambda t: rounded(text.keywords_per_event(keywords.texts_with_titles(t.hot_events, t.replies)), "weight"))

check("h21_keywords_per_event_stops", f"""
SELECT * FROM (
  SELECT event_id, word, CAST(row_number() OVER (PARTITION BY event_id ORDER BY weight DESC, word) AS INT) AS position FROM (
  {PER_EVENT.replace("WHERE position <= 30", "WHERE word NOT IN " + tup(["widget", "the"])).replace("round(weight, 6) AS weight", "weight")})
) WHERE position <= 3""")(
    lambda t: text.keywords_per_event(keywords.texts_with_titles(t.hot_events, t.replies), 3, stopwords=["widget", "the"])
    .select("event_id", "word", "position"))


# ---- reports built on scores and keywords

check("d36_refreshed_scores", f"""
SELECT e.id, coalesce(c.a, e.score) AS sentiment_score FROM ({scored_sql('hot_events', 'title', '0.5e0')}) e
LEFT JOIN (SELECT event_id, round(CAST(sum(sentiment_score) AS DOUBLE) / count(sentiment_score), 6) AS a FROM comments GROUP BY 1) c
  ON c.event_id = e.id""")(
    lambda t: metrics.refreshed_scores(words.with_score(t.hot_events, F.lit(0.5), "title", cal=CAL), t.comments,
                                       F.col("score"), 6).select("id", "sentiment_score"))

check("d40_landing_stats", f"""
WITH recent_titles AS (SELECT title FROM hot_events WHERE {inside('crawl_time', AS_OF, days=7)}),
k AS ({top_sql('recent_titles', 20, 'title', STOPS)})
SELECT (SELECT count(*) FROM comments WHERE {on('publish_time', AS_OF)}) AS today_comments,
       (SELECT count(DISTINCT e.id) FROM hot_events e LEFT JOIN comments c ON c.event_id = e.id
        WHERE {on('e.crawl_time', AS_OF)} AND e.heat >= 1000
          AND (c.sentiment_score < 0.4 OR c.sentiment_score IS NULL)) AS risk_count, (SELECT count(*) FROM k) AS burst_count""")(
    lambda t: text.landing_stats(t.hot_events, t.comments,
                                 joins.risky_or_silent_events(t.hot_events, t.comments, AS_OF, 1000),
                                 AS_OF, stopwords=STOPS))

check("d41_overview", """
SELECT (SELECT count(*) FROM hot_events) AS total_events, count(*) AS total_comments,
       round(CAST(sum(like_count) AS DOUBLE) / count(*), 4) AS avg_likes, round(avg(CAST(score AS DOUBLE)), 4) AS avg_sentiment
FROM scored_articles""", EXTRA)(
    lambda t: text.overview(t.hot_events, t.articles, F.col("sentiment_score"), key="article_id", cal=CAL, digits=4))

check("d42_rescored_daily", """
SELECT CAST(CAST(publish_time AS DATE) AS VARCHAR) AS date,
       round(CAST(sum(CAST(score AS DECIMAL(4,3))) AS DOUBLE) / count(*), 6) AS avg_sentiment FROM scored_articles GROUP BY 1""", EXTRA)(
    lambda t: text.rescored_daily(t.articles, F.col("sentiment_score"), cal=CAL, digits=6))

check("d42_rescored_bands", """
SELECT count(*) FILTER (score > 0.7) AS positive_count, count(*) FILTER (score BETWEEN 0.3 AND 0.7) AS neutral_count,
       count(*) FILTER (score < 0.3) AS negative_count FROM scored_articles""", EXTRA)(
    lambda t: text.rescored_bands(t.articles, F.col("sentiment_score"), cal=CAL))
