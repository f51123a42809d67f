"""Findings in words, as rules over the numbers of other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import bands
from murmur.operators import joins, metrics


def text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def rule_insights(df: DataFrame) -> DataFrame:
    """Adds three findings per row from band counts, health_score (0..100) and risk_level."""
    p, n, u = (F.col(f"{x}_count") for x in ("positive", "negative", "neutral"))
    total = p + n + u
    share = F.try_divide(n.cast("double"), total.cast("double"))
    health, risk = F.col("health_score"), F.col("risk_level")
    some = total > 0
    return (df
            .withColumn("mood", F.when(~some, "no comments yet")
                        .when(p > n * 1.5, "positive mood prevails")
                        .when(n > p * 1.5, "negative mood prevails")
                        .when((n > 0) & (share > 0.4), "many negative comments")
                        .otherwise("balanced mood"))
            .withColumn("health", F.when(~some, "waiting for data")
                        .when(health >= 70, "healthy").when(health >= 40, "unsteady").otherwise("unhealthy"))
            .withColumn("risk", F.when(~some, "watching")
                        .when(risk == "high", "high risk").when(risk == "medium", "medium risk").otherwise("low risk")))


def event_insights(events: DataFrame, comments: DataFrame, influence: DataFrame | None = None,
                   anomalies: DataFrame | None = None, top_words: DataFrame | None = None,
                   digits: int = 1) -> DataFrame:
    """Per event: risk reasons, key findings and direction; optionally with words, influence and anomaly."""
    stats = metrics.deep_stats(comments, digits=digits).withColumn("avg_sentiment", F.round("avg_sentiment", 3))
    rows = events.select("id", "title", "heat", "sentiment_score").join(stats, "id", "left")
    for c in ("total", "total_likes", "positive_count", "neutral_count", "negative_count"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(0)).cast("bigint"))
    rows = rows.withColumn("direction", F.coalesce("direction", F.lit("stable")))
    if top_words is not None:
        # Five places and no list: a list of every event would be sorted by event once more, in both steps of its grouping.
        places = [f"_w{k}" for k in range(1, 6)]
        words = (top_words.filter("position <= 5").groupBy(F.col("event_id").alias("id"))
                 .agg(*[F.max(F.when(F.col("position") == k, F.col("word"))).alias(c) for k, c in enumerate(places, 1)]))
        rows = rows.join(words, "id", "left").withColumn("_words", F.array_compact(F.array(*places))).drop(*places)
    else:
        rows = rows.withColumn("_words", F.lit(None).cast("array<string>"))
    if anomalies is not None:
        rows = rows.join(anomalies.select("id", F.col("severity").alias("anomaly_severity"), "anomaly_score"), "id", "left")
    else:
        rows = rows.withColumn("anomaly_severity", F.lit(None).cast("string"))
    if influence is not None:
        rows = rows.join(influence.select("id", "influence_score"), "id", "left")
    total, p, n = F.col("total"), F.col("positive_count"), F.col("negative_count")
    low = (total > 100) & (F.col("avg_sentiment") < 0.4)
    risks = F.array_compact(F.array(
        F.when(F.col("negative_pct") > 50, text("negative comments are ", F.col("negative_pct"), "%, more than half")),
        F.when(low, text("many comments (", total, ") with a low mean score (", F.col("avg_sentiment"), ")")),
        F.when(F.col("heat") > 1000, text("high heat (", F.col("heat"), "), may spread"))))
    calm = F.array(F.lit("the risk of this event is under control"))
    balance = (F.when(p > n, text("more positive (", p, ") than negative (", n, ") comments"))
               .when(n > p, text("more negative (", n, ") than positive (", p, ") comments"))
               .otherwise(F.lit("as many positive as negative comments")))
    findings = F.array_compact(F.array(
        F.when(total > 0, balance),
        F.when((total > 0) & (F.col("total_likes") > 0), text("lively, with ", F.col("total_likes"), " likes")),
        F.when(F.size("_words") >= 3, text("talk is about: ", F.array_join("_words", ", "))),
        F.when(F.col("anomaly_severity").isNotNull(), text("flagged as an anomaly (", F.col("anomaly_severity"), ")"))))
    path = text("from ", F.format_string("%.3f", F.col("first_hour")), " to ", F.format_string("%.3f", F.col("last_hour")))
    why = (F.when(F.col("direction") == "up", text("scores rise ", path))
           .when(F.col("direction") == "down", text("scores fall ", path, ", keep watching"))
           .otherwise(F.lit("scores are steady")))
    return (rows.withColumn("risk_level", bands.risk_level(F.col("sentiment_score")))
            .withColumn("risk_reasons", F.when(F.size(risks) > 0, risks).otherwise(calm))
            .withColumn("key_findings", findings).withColumn("direction_text", why).drop("_words"))


def risk_warning(events: DataFrame, comments: DataFrame, k: int = 2, digits: int = 1) -> DataFrame:
    """One row about the hottest events whose comments average low, no row when there is none."""
    top = joins.low_mean_events(events, comments, k=k)
    detail = metrics.negative_ratio_and_spread(joins.only_events(comments, top), digits)
    rows = top.join(detail, "id")
    order = F.sort_array(F.collect_list(F.struct((-F.col("heat")).alias("o"), "id", "title", "negative_ratio", "spread")))
    one = rows.agg(order.alias("e")).filter(F.size("e") > 0)
    first = F.col("e")[0]
    titles = F.array_join(F.transform("e", lambda x: x["title"]), ",")
    return one.select(F.size("e").cast("bigint").alias("n_events"), titles.alias("titles"),
                      first["title"].alias("first_title"), first["negative_ratio"].alias("negative_ratio"),
                      first["spread"].alias("spread")).withColumn(
        "content", text(F.col("n_events"), " high-risk events (", F.col("titles"), "); ", F.col("first_title"),
                        ": negative ", F.col("negative_ratio"), "%, spread ", F.col("spread"), "+"))


def recommendations(report: DataFrame) -> DataFrame:
    """(type, priority, content) from one report row."""
    def advice(kind: str, priority: str, content: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(priority).alias("priority"), content.alias("content"))

    s, t = F.col("avg_sentiment"), F.col("current_trend")
    title = F.when(F.length("top_title") > 15, F.concat(F.substring("top_title", 1, 15), F.lit(".."))).otherwise(F.col("top_title"))
    found = F.array_compact(F.array(
        F.when(s < 0.4, advice("negative opinion", "high", F.lit("many negative comments lately: answer public concerns soon")))
        .when(s > 0.6, advice("good opinion", "low", F.lit("opinion is good: keep the present pace"))),
        F.when(F.col("high_severity_count") > 0,
               advice("risky events", "high", text(F.col("high_severity_count"), " events need attention"))),
        F.when(t == "down", advice("falling trend", "medium", F.lit("scores are falling: guide the discussion")))
        .when(t == "up", advice("rising trend", "low", F.lit("scores are rising: keep watching"))),
        F.when(F.col("top_influence") > 80,
               advice("hot event", "medium", text(title, " draws much attention")))))
    usual = F.array(advice("normal", "low", F.lit("nothing unusual was found")))
    return report.select(F.explode(F.when(F.size(found) > 0, found).otherwise(usual)).alias("r")).select("r.*")
