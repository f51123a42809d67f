"""Influence, anomalies, forecasts, findings and combined reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks.registry import check
from checks.relational import AS_OF, EVENT_BANDS, FEATURES, T1, T4, before, inside
from checks.textual import CAL, PER_EVENT, clean_sql, scored_sql, top_sql, words_sql
from murmur.functions import words
from murmur.operators import forecast, forest, insights, keywords, metrics, scoring, text
from murmur.plans import base_score, reports


def influence_sql(events: str) -> str:
    return f"""
SELECT *, round((heat_factor * 0.25e0 + comment_factor * 0.20e0 + engagement_factor * 0.25e0 + sentiment_factor * 0.15e0
                 + time_factor * 0.15e0) * 100, 6) AS influence_score FROM (
  SELECT e.*, coalesce(n, 0) AS comment_count, least(CAST(heat AS DOUBLE) / 1000.0e0, 1.0e0) AS heat_factor,
         least(coalesce(n, 0) / 100.0e0, 1.0e0) AS comment_factor,
         least(coalesce(CAST(l AS DOUBLE) / n, 0.0e0) / 10.0e0, 1.0e0) AS engagement_factor,
         0.5e0 + abs(coalesce(s, 0.5e0) - 0.5e0) AS sentiment_factor,
         least(greatest(exp(-0.1e0 * ((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(crawl_time)) / 3.6e9) / 24.0e0), 0.1e0), 1.0e0) AS time_factor
  FROM {events} e LEFT JOIN (
    SELECT event_id, count(*) AS n, sum(like_count) AS l, CAST(sum(sentiment_score) AS DOUBLE) / count(*) AS s
    FROM comments GROUP BY 1) c ON c.event_id = e.id)"""


FACTORS = ["heat_factor", "comment_factor", "engagement_factor", "sentiment_factor", "time_factor"]
ROUND_FACTORS = ", ".join(f"round({f}, 6) AS {f}" for f in FACTORS)

check("i01_influence", f"SELECT id, title, comment_count, influence_score, {ROUND_FACTORS} FROM ({influence_sql('hot_events')})")(
    lambda t: scoring.influence(t.hot_events, t.comments, AS_OF, digits=6).select(
        "id", "title", "comment_count", "influence_score", *[F.round(f, 6).alias(f) for f in FACTORS]))

check("i01_influence_per_comment", f"""
SELECT id, round((least(CAST(heat AS DOUBLE) / 1000.0e0, 1.0e0) * 0.25e0 + least(coalesce(n, 0) / 100.0e0, 1.0e0) * 0.20e0
  + least(coalesce(CAST(l AS DOUBLE) / n, 0.0e0) / 10.0e0, 1.0e0) * 0.25e0 + (0.5e0 + coalesce(d, 0.0e0)) * 0.15e0
  + least(greatest(exp(-0.1e0 * ((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(crawl_time)) / 3.6e9) / 24.0e0), 0.1e0), 1.0e0) * 0.15e0) * 100, 6)
  AS influence_score
FROM hot_events e LEFT JOIN (SELECT event_id, count(*) AS n, sum(like_count) AS l,
  CAST(sum(abs(sentiment_score - 0.5)) AS DOUBLE) / count(*) AS d FROM comments GROUP BY 1) c ON c.event_id = e.id""")(
    lambda t: scoring.influence(t.hot_events, t.comments, AS_OF, True, digits=6).select("id", "influence_score"))

check("e12_influential", f"""
SELECT id, title, heat, comment_count, influence_score FROM ({influence_sql('hot_events')})
ORDER BY influence_score DESC, heat DESC, id LIMIT 10""")(
    lambda t: scoring.influential(t.hot_events, t.comments, AS_OF, 10, digits=6)
    .select("id", "title", "heat", "comment_count", "influence_score"))

check("e12_influential_of_month", f"""
SELECT id, heat, influence_score FROM ({influence_sql(f"(SELECT * FROM hot_events WHERE {inside('crawl_time', AS_OF, days=30)})")})
ORDER BY influence_score DESC, heat DESC, id LIMIT 10""")(
    lambda t: scoring.influential(t.hot_events, t.comments, AS_OF, 10, 30, digits=6).select("id", "heat", "influence_score"))

check("d39_influence_summary", f"""
SELECT count(*) AS total_events, round(avg(influence_score), 4) AS avg_influence_score, max(influence_score) AS max_score,
       arg_max(title, (influence_score, heat, -id)) AS top_event FROM ({influence_sql('hot_events')})""")(
    lambda t: scoring.influence_summary(scoring.influence(t.hot_events, t.comments, AS_OF, digits=6), 4))

check("d39_factor_breakdown", f"""
UNPIVOT (SELECT id, {ROUND_FACTORS} FROM ({influence_sql('hot_events')})) ON {', '.join(FACTORS)} INTO NAME factor VALUE value"""
      .replace("UNPIVOT", "SELECT id, factor, value, CAST(map {'heat_factor': 0.25, 'comment_factor': 0.20, 'engagement_factor': 0.25, "
               "'sentiment_factor': 0.15, 'time_factor': 0.15}[factor] AS DOUBLE) AS weight FROM (UNPIVOT") + ")")(
    lambda t: scoring.factor_breakdown(scoring.influence(t.hot_events, t.comments, AS_OF), 6))

Z = ", ".join(f"round((f.{c} - s.m{i}) / CASE WHEN s.d{i} > 0 THEN s.d{i} ELSE 1 END, 6) AS z_{c}"
              for i, c in enumerate(scoring.FEATURES))
FILLED = f"""
SELECT id, title, CAST(coalesce(heat, 0) AS DOUBLE) AS heat, CAST(comment_count AS DOUBLE) AS comment_count,
       coalesce(avg_sentiment, 0.5e0) AS avg_sentiment, coalesce(avg_likes, 0.0e0) AS avg_likes,
       CAST(hour(crawl_time) AS DOUBLE) AS hour FROM ({FEATURES})"""
STATS = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS d{i}" for i, c in enumerate(scoring.FEATURES))
STANDARD = f"SELECT f.id, f.heat, f.comment_count, f.avg_sentiment, {Z} FROM ({FILLED}) f, (SELECT {STATS} FROM ({FILLED})) s"


def standard(t):
    return scoring.standardised(scoring.features(t.hot_events, t.comments), digits=6)


check("i02_standardised_features", STANDARD)(
    lambda t: standard(t).drop("title", "avg_likes", "hour"))

check("i04_anomaly_reasons", f"""
SELECT id, array_to_string(list_filter([CASE WHEN abs(z_heat) > 1.5 THEN 'heat_spike' END,
  CASE WHEN abs(z_comment_count) > 1.5 THEN 'comment_spike' END,
  CASE WHEN abs(z_avg_sentiment) > 1.5 THEN CASE WHEN z_avg_sentiment < 0 THEN 'sentiment_drop' ELSE 'sentiment_spike' END END,
  CASE WHEN abs(z_avg_likes) > 1.5 THEN 'engagement_spike' END], lambda x: x IS NOT NULL), ',') AS types FROM ({STANDARD})""")(
    lambda t: scoring.reasons(standard(t)).select("id", F.array_join("anomaly_types", ",").alias("types")))

check("i05_risk_signals", f"""
SELECT *, CASE WHEN risk_count >= 3 THEN 'critical' WHEN risk_count >= 2 THEN 'high' WHEN risk_count >= 1 THEN 'medium'
  ELSE 'low' END AS signal_level FROM (
  SELECT id, CASE WHEN avg_sentiment > 0.7e0 THEN 'low' WHEN avg_sentiment < 0.3e0 THEN 'high' ELSE 'medium' END AS sentiment_level,
    CASE WHEN heat > 50000 THEN 'high' WHEN heat > 10000 THEN 'medium' ELSE 'low' END AS heat_level,
    CASE WHEN comment_count > 1000 THEN 'high' WHEN comment_count > 100 THEN 'medium' ELSE 'low' END AS comment_level,
    CAST(CAST(avg_sentiment < 0.4e0 AS INT) + CAST(heat > 80000 AS INT) + CAST(comment_count > 2000 AS INT) AS INT) AS risk_count
  FROM (SELECT id, heat * 20 AS heat, comment_count * 400 AS comment_count, avg_sentiment FROM ({FILLED})))""")(
    lambda t: scoring.signals(
        scoring.features(t.hot_events, t.comments).withColumn("heat", F.col("heat") * 20)
        .withColumn("comment_count", F.col("comment_count") * 400))
    .select("id", "sentiment_level", "heat_level", "comment_level", "risk_count", "signal_level"))

check("i06_severity", f"""
SELECT id, CASE WHEN z_heat < -0.5 THEN 'high' WHEN z_heat < -0.2 THEN 'medium' ELSE 'low' END AS severity FROM ({STANDARD})""")(
    lambda t: standard(t).select("id", scoring.severity(F.col("z_heat")).alias("severity")))

# The forest draws its own random numbers: what must hold of its result whatever they are.
check("i03_anomalies", f"""
SELECT count(*) AS n_events, true AS share_is_right, true AS scores_are_below_zero, true AS severity_follows_score,
       true AS reasons_are_those_of_the_features FROM hot_events WHERE crawl_time <= TIMESTAMP '{AS_OF}'""")(
    lambda t: anomaly_laws(t))


def anomaly_laws(t):
    """One row: events looked at, and whether the flagged ones obey the rules."""
    found = forest.detect(t.hot_events, t.comments, AS_OF)
    rows = scoring.reasons(scoring.standardised(scoring.features(t.hot_events, t.comments, AS_OF)))
    n = metrics.row_count(rows, "n").scalar()
    wrong = (found.select("id", F.col("anomaly_types").alias("types")).join(rows, "id", "left")
             .filter(~F.col("types").eqNullSafe(F.col("anomaly_types"))))
    score, severity = F.col("anomaly_score"), F.col("severity")
    level = F.when(score < -0.5, "high").when(score < -0.2, "medium").otherwise("low")
    flagged, n_rows = F.count(F.lit(1)), F.max("_n")
    fits = (flagged > n_rows * 0.03) & (flagged <= F.ceil(n_rows * forest.CONTAMINATION))
    return (found.withColumn("_n", n).agg(
        F.max("_n").alias("n_events"), fits.alias("share_is_right"),
        F.bool_and(score < 0).alias("scores_are_below_zero"), F.bool_and(severity == level).alias("severity_follows_score"))
            .withColumn("reasons_are_those_of_the_features", metrics.row_count(wrong).scalar() == 0))


# A forest of two trees, small enough to be written as SQL.
SMALL = forest.Forest(
    ("z_heat", "z_comment_count", "z_avg_sentiment"), np.array([[0, 1, -1, -1, -1], [2, -1, -1, -1, -1]]),
    np.array([[0.5, -0.25, 0.0, 0.0, 0.0], [0.1, 0.0, 0.0, 0.0, 0.0]]), np.array([[1, 3, 0, 0, 0], [1, 0, 0, 0, 0]]),
    np.array([[2, 4, 0, 0, 0], [2, 0, 0, 0, 0]]), np.array([[0.0, 0.0, 1.5, 3.0, 2.25], [0.0, 2.0, 1.0, 0.0, 0.0]]), 2.5)
check("i03_forest_scores", f"""
WITH RECURSIVE node(tree, node, feature, split, l, r, path) AS (VALUES
  (0, 0, 0, 0.5e0, 1, 2, 0.0e0), (0, 1, 1, -0.25e0, 3, 4, 0.0e0), (0, 2, -1, 0.0e0, 0, 0, 1.5e0), (0, 3, -1, 0.0e0, 0, 0, 3.0e0),
  (0, 4, -1, 0.0e0, 0, 0, 2.25e0), (1, 0, 2, 0.1e0, 1, 2, 0.0e0), (1, 1, -1, 0.0e0, 0, 0, 2.0e0), (1, 2, -1, 0.0e0, 0, 0, 1.0e0)),
x AS (SELECT id, [z_heat, z_comment_count, z_avg_sentiment] AS v FROM ({STANDARD})),
walk AS (
  SELECT id, v, tree, node, feature, split, l, r, path FROM x, node WHERE node = 0
  UNION ALL
  SELECT w.id, w.v, n.tree, n.node, n.feature, n.split, n.l, n.r, n.path FROM walk w JOIN node n
    ON n.tree = w.tree AND n.node = CASE WHEN w.v[w.feature + 1] < w.split THEN w.l ELSE w.r END WHERE w.feature >= 0)
SELECT id, round(-power(2.0e0, -(sum(path) / 2) / 2.5e0), 6) AS raw_score FROM walk WHERE feature < 0 GROUP BY 1""")(
    lambda t: forest.score(standard(t), SMALL).select("id", "raw_score"))

# Anomalies by a rule, in the place of those that a forest finds.
RULED = f"""
SELECT id, title, round(-z_heat / 3, 6) AS anomaly_score, CASE WHEN round(-z_heat / 3, 6) < -0.5 THEN 'high'
         WHEN round(-z_heat / 3, 6) < -0.2 THEN 'medium' ELSE 'low' END AS severity,
       list_filter([CASE WHEN abs(z_heat) > 1.5 THEN 'heat_spike' END, CASE WHEN abs(z_comment_count) > 1.5 THEN 'comment_spike' END,
         CASE WHEN abs(z_avg_sentiment) > 1.5 THEN CASE WHEN z_avg_sentiment < 0 THEN 'sentiment_drop' ELSE 'sentiment_spike' END END,
         CASE WHEN abs(z_avg_likes) > 1.5 THEN 'engagement_spike' END], lambda x: x IS NOT NULL) AS anomaly_types
FROM ({STANDARD}) JOIN (SELECT id, title FROM hot_events) USING (id) WHERE z_heat > 0.1"""


def ruled(t):
    score = F.round(-F.col("z_heat") / 3, 6)
    return (scoring.reasons(standard(t).filter("z_heat > 0.1")).withColumn("anomaly_score", score)
            .withColumn("severity", scoring.severity(F.col("anomaly_score"))))


check("d38_severity_counts", f"""
SELECT count(*) AS total, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
       count(*) FILTER (severity = 'low') AS low FROM ({RULED})""")(lambda t: forest.severity_counts(ruled(t)))
check("d38_type_counts", f"""
SELECT anomaly_type, count(*) AS n FROM (SELECT unnest(anomaly_types) AS anomaly_type FROM ({RULED})) GROUP BY 1""")(
    lambda t: forest.type_counts(ruled(t)))

FORECAST = """
WITH d AS (SELECT *, CAST(row_number() OVER (ORDER BY date) AS DOUBLE) AS i, CAST(count(*) OVER () AS DOUBLE) AS n FROM (
  SELECT CAST(publish_time AS DATE) AS date, round(CAST(sum(sentiment_score) AS DOUBLE) / count(*), 6) AS y FROM {table}
  WHERE sentiment_score IS NOT NULL GROUP BY 1)),
w AS (SELECT *, least(greatest(14.0e0, floor(n / 4)), n) AS w FROM d),
o AS (SELECT 0.3e0 * regr_slope(y, i) FILTER (i > n - w) + 0.7e0 * regr_slope(y, i) FILTER (i > n - 7) AS slope,
        sum(y * exp((i - (n - w) - 1) / (w - 1))) FILTER (i > n - w) / sum(exp((i - (n - w) - 1) / (w - 1))) FILTER (i > n - w) AS baseline,
        count(*) AS data_days FROM w)
SELECT CAST(step AS INT) AS step, round(greatest(0.1e0, least(0.9e0, baseline + slope * step / (1.0e0 + 0.1e0 * step))), 6) AS prediction,
       CASE WHEN slope > 0.02 THEN 'up' WHEN slope < -0.02 THEN 'down' ELSE 'flat' END AS current_trend,
       round(least(0.5e0 + data_days / 200.0e0 + abs(slope) * 5, 0.95e0), 6) AS confidence, data_days
FROM o, range(1, 8) s(step)"""
check("i07_forecast", FORECAST.format(table="live_comments"))(
    lambda t: forecast.forecast(metrics.daily_history(t.live_comments), 7, digits=6))
check("i07_forecast_long_history", FORECAST.format(table="comments"))(
    lambda t: forecast.forecast(metrics.daily_history(t.comments), 7, digits=6))

# As they stood at AS_OF, with the anomalies of the rule.
THEN = {"then_events": f"SELECT * FROM hot_events WHERE crawl_time <= TIMESTAMP '{AS_OF}'",
        "then_comments": f"SELECT * FROM comments WHERE publish_time <= TIMESTAMP '{AS_OF}'"}
REPORT = f"""
f AS ({FORECAST.format(table="then_comments").replace("WITH d AS", "WITH d AS")}),
top AS (SELECT *, round(influence_score, 2) AS score FROM (
  {influence_sql("then_events").replace("FROM comments", "FROM then_comments")}) ORDER BY score DESC, heat DESC, id LIMIT 5),
best AS (SELECT title, score FROM top ORDER BY score DESC, heat DESC, title DESC LIMIT 1),
b AS (SELECT {T4}, count(*) AS total FROM then_comments WHERE {inside('publish_time', AS_OF, days=30)}),
odd AS ({RULED}),
s AS (SELECT round(CAST(sum(sentiment_score) AS DOUBLE) / count(*), 3) AS a, count(*) AS n FROM then_comments),
r AS (
  SELECT (SELECT count(*) FROM then_events) AS total_events, n AS total_comments, a AS avg_sentiment,
    CASE WHEN a > 0.6 THEN 'positive' WHEN a < 0.4 THEN 'negative' ELSE 'neutral' END AS mood,
    (SELECT concat(positive_count, '/', neutral_count, '/', negative_count, '/', total) FROM b) AS bands,
    (SELECT string_agg(title, ',' ORDER BY score DESC, heat DESC, title DESC) FROM top) AS top_titles,
    (SELECT count(*) FROM odd) AS n_anomalies, (SELECT count(*) FROM odd WHERE severity = 'high') AS high_severity_count,
    (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY anomaly_score, id) FROM (SELECT * FROM odd ORDER BY anomaly_score, id LIMIT 3))
      AS worst, (SELECT string_agg(printf('%.3f', round(prediction, 3)), ',' ORDER BY step) FROM f) AS predictions,
    (SELECT max(current_trend) FROM f) AS current_trend, (SELECT title FROM best) AS top_title,
    (SELECT score FROM best) AS top_influence FROM s)"""


def reported(t):
    return reports.summary(t.hot_events, t.comments, AS_OF, 30, anomalies=ruled(t))


check("i08_report", f"WITH {REPORT.strip()} SELECT * FROM r", THEN)(
    lambda t: reported(t).select(
        "total_events", "total_comments", "avg_sentiment", "mood",
        F.concat_ws("/", *[f"bands.{n}_count" for n in ("positive", "neutral", "negative")], "bands.total").alias("bands"),
        F.array_join(F.transform("top_influential", lambda x: x["title"]), ",").alias("top_titles"),
        F.col("anomalies.total").alias("n_anomalies"), "high_severity_count",
        F.array_join(F.transform("recent_anomalies", lambda x: x["id"].cast("string")), ",").alias("worst"),
        F.array_join(F.transform("predictions", lambda x: F.format_string("%.3f", x["prediction"])), ",").alias("predictions"),
        "current_trend", "top_title", "top_influence"))

check("i08_recommendations", f"""
WITH {REPORT.strip()}
SELECT x.type, x.priority, x.content FROM (SELECT unnest(CASE WHEN len(found) > 0 THEN found ELSE
    [{{'type': 'normal', 'priority': 'low', 'content': 'nothing unusual was found'}}] END) AS x FROM (
  SELECT list_filter([
    CASE WHEN avg_sentiment < 0.4 THEN {{'type': 'negative opinion', 'priority': 'high',
           'content': 'many negative comments lately: answer public concerns soon'}}
         WHEN avg_sentiment > 0.6 THEN {{'type': 'good opinion', 'priority': 'low', 'content': 'opinion is good: keep the present pace'}} END,
    CASE WHEN high_severity_count > 0 THEN {{'type': 'risky events', 'priority': 'high',
           'content': concat(high_severity_count, ' events need attention')}} END,
    CASE WHEN current_trend = 'down' THEN {{'type': 'falling trend', 'priority': 'medium',
           'content': 'scores are falling: guide the discussion'}}
         WHEN current_trend = 'up' THEN {{'type': 'rising trend', 'priority': 'low', 'content': 'scores are rising: keep watching'}} END,
    CASE WHEN top_influence > 80 THEN {{'type': 'hot event', 'priority': 'medium', 'content': concat(
           CASE WHEN length(top_title) > 15 THEN left(top_title, 15) || '..' ELSE top_title END, ' draws much attention')}} END],
    lambda y: y IS NOT NULL) AS found FROM r))""", THEN)(lambda t: insights.recommendations(reported(t)))

check("i09_rule_insights", f"""
SELECT id, CASE WHEN total = 0 THEN 'no comments yet' WHEN positive_count > negative_count * 1.5 THEN 'positive mood prevails'
    WHEN negative_count > positive_count * 1.5 THEN 'negative mood prevails'
    WHEN negative_count > 0 AND negative_count / total > 0.4 THEN 'many negative comments' ELSE 'balanced mood' END AS mood,
  CASE WHEN total = 0 THEN 'waiting for data' WHEN sentiment_score * 100 >= 70 THEN 'healthy'
    WHEN sentiment_score * 100 >= 40 THEN 'unsteady' ELSE 'unhealthy' END AS health,
  CASE WHEN total = 0 THEN 'watching' WHEN sentiment_score < 0.3 THEN 'high risk' WHEN sentiment_score < 0.6 THEN 'medium risk'
    ELSE 'low risk' END AS risk
FROM ({EVENT_BANDS}) b JOIN hot_events e USING (id)""")(
    lambda t: insights.rule_insights(
        metrics.event_bands(t.hot_events, t.comments, columns=("id", "sentiment_score"))
        .withColumn("health_score", F.col("sentiment_score") * 100)
        .withColumn("risk_level", metrics.bands.risk_level(F.col("sentiment_score"))))
    .select("id", "mood", "health", "risk"))

check("i10_event_insights", f"""
WITH s AS (SELECT event_id AS id, count(*) AS total, CAST(sum(like_count) AS BIGINT) AS total_likes, {T1},
             round(CAST(sum(sentiment_score) AS DOUBLE) / count(*), 3) AS avg_sentiment FROM live_comments GROUP BY 1),
h AS (SELECT event_id AS id, strftime(publish_time, '%Y-%m-%d %H') AS hr,
             round(CAST(sum(sentiment_score) AS DOUBLE) / count(*), 3) AS a FROM live_comments GROUP BY 1, 2),
x AS (SELECT id, arg_min(a, hr) AS f, arg_max(a, hr) AS l FROM h GROUP BY 1)
SELECT e.id, CASE WHEN e.sentiment_score < 0.3 THEN 'high' WHEN e.sentiment_score < 0.6 THEN 'medium' ELSE 'low' END AS risk_level,
  CAST(CAST(coalesce(round(100.0e0 * negative_count / total, 1) > 50, false) AS INT)
     + CAST(coalesce(total > 100 AND avg_sentiment < 0.4, false) AS INT) + CAST(heat > 1000 AS INT) AS INT) AS n_risks,
  CASE WHEN coalesce(total, 0) = 0 THEN NULL
       WHEN positive_count > negative_count THEN concat('more positive (', positive_count, ') than negative (', negative_count, ') comments')
       WHEN negative_count > positive_count THEN concat('more negative (', negative_count, ') than positive (', positive_count, ') comments')
       ELSE 'as many positive as negative comments' END AS balance,
  CASE WHEN round(l - f, 3) > 0.1 THEN concat('scores rise from ', printf('%.3f', f), ' to ', printf('%.3f', l))
       WHEN round(l - f, 3) < -0.1 THEN concat('scores fall from ', printf('%.3f', f), ' to ', printf('%.3f', l), ', keep watching')
       ELSE 'scores are steady' END AS direction_text
FROM hot_events e LEFT JOIN s USING (id) LEFT JOIN x USING (id)""")(
    lambda t: insights.event_insights(t.hot_events, t.live_comments).select(
        "id", "risk_level",
        F.size(F.filter("risk_reasons", lambda r: ~r.startswith("the risk of"))).alias("n_risks"),
        F.get("key_findings", F.lit(0)).alias("balance"), "direction_text"))

check("i10_event_insights_full", f"""
WITH c AS (SELECT event_id AS id, count(*) AS total, CAST(sum(like_count) AS BIGINT) AS total_likes, {T1},
             round(CAST(sum(sentiment_score) AS DOUBLE) / count(*), 3) AS avg_sentiment FROM comments GROUP BY 1),
w AS (SELECT event_id AS id, list(word ORDER BY position) AS words FROM ({PER_EVENT}) WHERE position <= 5 GROUP BY 1),
odd AS ({RULED}), i AS (SELECT id, influence_score FROM ({influence_sql('hot_events')})),
x AS (SELECT e.id, e.heat, coalesce(total, 0) AS total, coalesce(total_likes, 0) AS total_likes, coalesce(positive_count, 0) AS p,
        coalesce(negative_count, 0) AS n, avg_sentiment, round(100.0e0 * negative_count / total, 1) AS pct, words, odd.severity,
        odd.anomaly_score, influence_score
      FROM hot_events e LEFT JOIN c ON c.id = e.id LEFT JOIN w ON w.id = e.id LEFT JOIN odd ON odd.id = e.id LEFT JOIN i ON i.id = e.id)
SELECT id, influence_score, severity AS anomaly_severity, anomaly_score,
  array_to_string(CASE WHEN len(risks) > 0 THEN risks ELSE ['the risk of this event is under control'] END, '; ') AS risks,
  array_to_string(findings, '; ') AS findings
FROM (SELECT *, list_filter([
    CASE WHEN pct > 50 THEN concat('negative comments are ', pct, '%, more than half') END,
    CASE WHEN total > 100 AND avg_sentiment < 0.4 THEN concat('many comments (', total, ') with a low mean score (', avg_sentiment, ')') END,
    CASE WHEN heat > 1000 THEN concat('high heat (', heat, '), may spread') END], lambda y: y IS NOT NULL) AS risks,
  list_filter([
    CASE WHEN total > 0 THEN CASE WHEN p > n THEN concat('more positive (', p, ') than negative (', n, ') comments')
      WHEN n > p THEN concat('more negative (', n, ') than positive (', p, ') comments') ELSE 'as many positive as negative comments' END END,
    CASE WHEN total > 0 AND total_likes > 0 THEN concat('lively, with ', total_likes, ' likes') END,
    CASE WHEN len(words) >= 3 THEN concat('talk is about: ', array_to_string(words, ', ')) END,
    CASE WHEN severity IS NOT NULL THEN concat('flagged as an anomaly (', severity, ')') END], lambda y: y IS NOT NULL) AS findings
  FROM x)""")(
    lambda t: insights.event_insights(
        t.hot_events, t.comments, influence=scoring.influence(t.hot_events, t.comments, AS_OF, digits=6), anomalies=ruled(t),
        top_words=text.keywords_per_event(keywords.texts_with_titles(t.hot_events, t.replies)))
    .select("id", "influence_score", "anomaly_severity", "anomaly_score", F.array_join("risk_reasons", "; ").alias("risks"),
            F.array_join("key_findings", "; ").alias("findings")))

check("i11_risk_warning", """
WITH top AS (SELECT e.id, e.title, e.heat FROM hot_events e JOIN (
  SELECT event_id, round(CAST(sum(sentiment_score) AS DOUBLE) / count(*), 6) AS a FROM comments GROUP BY 1) c ON c.event_id = e.id
  WHERE a < 0.3 ORDER BY heat DESC, id LIMIT 2),
first AS (SELECT * FROM top ORDER BY heat DESC, id LIMIT 1)
SELECT *, concat(n_events, ' high-risk events (', titles, '); ', first_title, ': negative ', negative_ratio, '%, spread ', spread, '+')
  AS content FROM (
SELECT (SELECT count(*) FROM top) AS n_events, (SELECT string_agg(title, ',' ORDER BY heat DESC, id) FROM top) AS titles,
       f.title AS first_title, round(100.0e0 * count(*) FILTER (sentiment_score < 0.3) / count(*), 1) AS negative_ratio,
       CAST(count(*) + sum(like_count) AS BIGINT) AS spread
FROM first f JOIN comments c ON c.event_id = f.id GROUP BY f.title)""")(
    lambda t: insights.risk_warning(t.hot_events, t.comments, 2, 1))

# ---- combined reports


def evolved(t):
    return reports.evolution(t.hot_events, t.comments, t.articles, AS_OF, days=180, count=10, title_days=30)


# The dates of the window, and a word that is said as often on every day.
FIRST = before(AS_OF, days=179)[:10]


def even(t):
    long = evolved(t)["timeline"]
    steady = long.select("date").distinct().select("date", F.lit("steady").alias("keyword"), F.lit(4).cast("bigint").alias("n"))
    return long.unionByName(steady)


DAYS = f"generate_series(DATE '{FIRST}', DATE '{AS_OF}', INTERVAL 1 DAY) d(d)"
RECENT = inside("publish_time", AS_OF, days=180)
TEXTS = {"talk": """
SELECT comment_id AS text_id, content, publish_time, sentiment_score FROM comments WHERE content <> '' UNION ALL
SELECT article_id, content, publish_time, sentiment_score FROM articles WHERE content <> ''"""}


def evolution_sql(tail: str) -> str:
    return f"""
WITH recent_titles AS (SELECT title FROM hot_events WHERE {inside('crawl_time', AS_OF, days=30)}),
k AS ({top_sql('recent_titles', 20, 'title')}),
r AS (SELECT *, row_number() OVER (ORDER BY weight DESC, word) AS p, count(*) OVER () AS n FROM k),
c AS (SELECT word AS keyword, weight FROM r WHERE n < 10 OR p <= 5 OR p > n - 5),
recent AS (SELECT * FROM talk WHERE {RECENT}),
line AS (SELECT CAST(CAST(d.d AS DATE) AS VARCHAR) AS date, c.keyword, count(x.text_id) AS n FROM {DAYS} CROSS JOIN c
  LEFT JOIN recent x ON CAST(x.publish_time AS DATE) = CAST(d.d AS DATE) AND contains(lower(x.content), lower(c.keyword))
  GROUP BY 1, 2),
v AS (SELECT keyword, CAST(sum(n) AS BIGINT) AS total,
        sqrt(CAST(count(*) * sum(n * n) - sum(n) * sum(n) AS DOUBLE)) / CAST(sum(n) AS DOUBLE) AS cv
      FROM line GROUP BY 1 HAVING sum(n) > 0),
x AS (SELECT content, min(sentiment_score) AS s FROM recent GROUP BY 1),
b AS (SELECT keyword, weight, count(*) FILTER (s > 0.6) AS p, count(*) FILTER (s BETWEEN 0.4 AND 0.6) AS u,
        count(*) FILTER (s < 0.4) AS q FROM c LEFT JOIN x ON contains(content, keyword) GROUP BY 1, 2)
{tail}"""


check("h13_evolution_mood", f"""
SELECT CAST(CAST(d.d AS DATE) AS VARCHAR) AS date, count(*) FILTER (x.sentiment_score > 0.6) AS positive_count,
       count(*) FILTER (x.sentiment_score BETWEEN 0.4 AND 0.6) AS neutral_count, count(*) FILTER (x.sentiment_score < 0.4) AS negative_count
FROM {DAYS} LEFT JOIN (SELECT * FROM talk WHERE {RECENT}) x
  ON CAST(x.publish_time AS DATE) = CAST(d.d AS DATE) GROUP BY 1""", TEXTS)(lambda t: evolved(t)["mood"])

check("h13_evolution_timeline", evolution_sql("SELECT * FROM line"), TEXTS)(lambda t: evolved(t)["timeline"])

check("h13_evolution_keywords", evolution_sql("""
SELECT keyword, round(weight * 100, 2) AS frequency,
       CASE WHEN p > q AND p > u THEN 'positive' WHEN q > p AND q > u THEN 'negative' ELSE 'neutral' END AS sentiment FROM b"""),
      TEXTS)(lambda t: evolved(t)["keywords"])

check("h13_evolution_burst", evolution_sql("""
SELECT keyword, total, round(cv, 2) AS cv FROM v WHERE cv > 0.5 AND total > 5 ORDER BY v.cv DESC, keyword LIMIT 5"""), TEXTS)(
    lambda t: evolved(t)["burst"])

check("h13_evolution_longtail", evolution_sql("""
SELECT * FROM (SELECT keyword, total, round(cv, 2) AS cv FROM v WHERE cv < 0.3 AND total > 3
UNION ALL SELECT 'steady', 4 * 180, 0.0e0) ORDER BY total DESC, keyword LIMIT 5"""), TEXTS)(
    lambda t: keywords.longtail_words(even(t)))

check("h17_profile_timeline", """
SELECT CAST(CAST(crawl_time AS DATE) AS VARCHAR) AS date, count(*) AS n FROM hot_events
WHERE contains(lower(title), 'rod') GROUP BY 1""")(
    lambda t: reports.hotword_profile(t.hot_events, t.articles, "rod")["timeline"])

check("h17_profile_total", "SELECT count(*) AS total FROM hot_events WHERE contains(lower(title), 'rod')")(
    lambda t: reports.hotword_profile(t.hot_events, t.articles, "rod")["total"])

BAYES = f"""
WITH tok AS (SELECT article_id, quality, unnest({words_sql(clean_sql('content'))}) AS word FROM articles),
cnt AS (SELECT word, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad FROM tok
        WHERE quality IN (0, 1) GROUP BY 1),
sums AS (SELECT sum(good) AS good, sum(bad) AS bad, count(*) AS words FROM cnt),
w AS (SELECT word, ln((cnt.good + 1.0e0) / (sums.good + words)) - ln((cnt.bad + 1.0e0) / (sums.bad + words)) AS weight FROM cnt, sums),
prior AS (SELECT ln(CAST(count(*) FILTER (quality = 1) AS DOUBLE)) - ln(CAST(count(*) FILTER (quality = 0) AS DOUBLE)) AS p
          FROM articles),
odds AS (SELECT article_id, sum(weight) AS s FROM tok JOIN w USING (word) GROUP BY 1)
SELECT a.*, round(1.0e0 / (1.0e0 + exp(-(coalesce(s, 0.0e0) + p))), 6) AS base_score
FROM articles a LEFT JOIN odds USING (article_id), prior"""
check("h01_trained_base_score", f"SELECT article_id, base_score, score FROM ({scored_sql(f'({BAYES})', 'content', 'base_score')})")(
    lambda t: words.with_score(
        base_score.with_base(t.articles, base_score.fit(t.articles)), F.col("base_score"), cal=CAL)
    .select("article_id", "base_score", "score"))
