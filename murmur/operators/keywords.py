"""Keyword reports over texts.

Texts are rows (event_id, text_id, content, publish_time, sentiment_score). Keywords are a list, or a top-k
table (word, weight) such as the result of text.keywords. They become one literal array, so every text is read
once. The score column is an argument: the stored one, or one that words.with_score gives anew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmur.functions import bands, scalars, times
from murmur.operators import filters, joins, metrics, ranking, text

Keywords = Sequence[str] | DataFrame
SCORE = "sentiment_score"


def as_list(keywords: Keywords) -> list[str]:
    """The keywords ascending. A table is a top-k result: its words become literals, so the containment tests are part
    of the scan. A vocabulary in a table belongs in joins.keyword_hits_by_join."""
    if isinstance(keywords, DataFrame):
        keywords = [r["word"] for r in keywords.select("word").collect()]
    return sorted(set(keywords))


def fixed(top: DataFrame) -> DataFrame:
    """A top-k result, k rows, as a local table, so that later steps do not compute it again."""
    return top.sparkSession.createDataFrame(top.collect(), top.schema)


def as_array(keywords: Keywords) -> Column:
    return F.array(*[F.lit(k) for k in as_list(keywords)]).cast("array<string>")


def as_rows(spark, keywords: Keywords, name: str = "keyword") -> DataFrame:
    return spark.createDataFrame([(k,) for k in as_list(keywords)], f"{name} string")


def polarity(texts: DataFrame, keywords: Keywords, score: str = SCORE, band: bands.Band = bands.T4) -> DataFrame:
    """Per keyword: how many texts with it are positive, neutral, negative; the strict plurality, else neutral."""
    keywords = as_list(keywords)
    hits = joins.keyword_hits(texts.select("content", score), as_array(keywords))
    seen = hits.groupBy("keyword").agg(*bands.counts(F.col(score), band))
    every = as_rows(texts.sparkSession, keywords)
    p, u, n = (F.col(f"{x}_count") for x in ("positive", "neutral", "negative"))
    filled = every.join(seen, "keyword", "left").fillna(0)
    return filled.withColumn("sentiment", F.when((p > n) & (p > u), "positive")
                             .when((n > p) & (n > u), "negative").otherwise("neutral"))


def report(texts: DataFrame, k: int = 30, stopwords: Sequence[str] = (), digits: int = 2,
           score: str = SCORE) -> DataFrame:
    """Keywords of the texts with frequency (weight x 100) and polarity."""
    top = fixed(text.keywords(texts, k, stopwords=stopwords))
    kinds = polarity(texts, top, score).select(F.col("keyword"), "sentiment")
    return (top.withColumnRenamed("word", "keyword").join(kinds, "keyword")
            .select("keyword", F.round(F.col("weight") * 100, digits).alias("frequency"), "sentiment"))


def report_page(rows: DataFrame, number: int, size: int, sentiment: str | None = None) -> DataFrame:
    """One page of a report, most frequent first, optionally of one polarity. filters.page_count gives the total."""
    kept = rows if sentiment is None else rows.filter(F.col("sentiment") == sentiment)
    return filters.page(kept, [F.col("frequency").desc(), F.col("keyword").asc()], number, size)


def calendar_of(texts: DataFrame, as_of, days: int) -> DataFrame:
    """The last `days` dates up to as_of."""
    end = times.as_datetime(as_of)
    return times.calendar(texts.sparkSession, end - times.dt.timedelta(days=days - 1), end)


def calendar_grid(texts: DataFrame, keywords: Keywords, as_of, days: int) -> DataFrame:
    """Every (date, keyword). The keywords ride on the dates as one array, so this is an explode."""
    dates = calendar_of(texts, as_of, days)
    return dates.withColumn("keyword", as_array(keywords)).withColumn("keyword", F.explode("keyword"))


def timeline(texts: DataFrame, keywords: Keywords, as_of, days: int, ignore_case: bool = True) -> DataFrame:
    """(date, keyword, n) over the calendar, zeros included."""
    keywords = as_list(keywords)
    recent = texts.filter(times.since(F.col("publish_time"), as_of, days=days)).select("content", "publish_time")
    hits = joins.keyword_hits(recent, as_array(keywords), ignore_case=ignore_case)
    seen = hits.groupBy(times.day(F.col("publish_time")).alias("date"), "keyword").agg(F.count(F.lit(1)).alias("n"))
    return calendar_grid(texts, keywords, as_of, days).join(seen, ["date", "keyword"], "left").fillna(0, ["n"])


def timeline_wide(long: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """One row per date, one column per keyword."""
    return long.groupBy("date").pivot("keyword", list(keywords)).agg(F.first("n"))


def variation(long: DataFrame) -> DataFrame:
    """Per keyword: total and coefficient of variation over the calendar; keywords without a hit drop out."""
    s, ss, c = F.sum("n"), F.sum(F.col("n") * F.col("n")), F.count(F.lit(1))
    sums = long.groupBy("keyword").agg(s.alias("total"), ss.alias("squares"), c.alias("days"))
    total, squares, n = (F.col(x).cast("double") for x in ("total", "squares", "days"))
    # sqrt(n * sum(x^2) - sum(x)^2) / sum(x): population deviation over mean, from whole numbers only.
    spread = F.sqrt(n * squares - total * total) / total
    return sums.filter(F.col("total") > 0).select("keyword", "total", spread.alias("cv"))


def burst_words(long: DataFrame, k: int = 5, above: float = 0.5, more_than: int = 5, digits: int = 2) -> DataFrame:
    rows = variation(long).filter((F.col("cv") > above) & (F.col("total") > more_than))
    top = rows.orderBy(F.col("cv").desc(), "keyword").limit(k)
    return top.withColumn("cv", F.round("cv", digits))


def longtail_words(long: DataFrame, k: int = 5, below: float = 0.3, more_than: int = 3, digits: int = 2) -> DataFrame:
    rows = variation(long).filter((F.col("cv") < below) & (F.col("total") > more_than))
    top = rows.orderBy(F.col("total").desc(), "keyword").limit(k)
    return top.withColumn("cv", F.round("cv", digits))


def mention_days(texts: DataFrame, keyword: str, as_of=None, days: int | None = None) -> DataFrame:
    rows = texts if days is None else texts.filter(times.since(F.col("publish_time"), as_of, days=days))
    return rows.filter(filters.contains(F.col("content"), keyword))


def burst_points(texts: DataFrame, keyword: str, as_of=None, days: int | None = None, threshold: float = 2.0,
                 digits: int = 2) -> DataFrame:
    """Days whose count is at least `threshold` times that of the previous active day; nothing when fewer than
    three days are active. The windows run over one row per date."""
    by_day = metrics.daily(mention_days(texts, keyword, as_of, days), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("date")
    rows = (by_day.withColumn("prev_n", F.lag("n").over(order))
            .withColumn("_days", F.count(F.lit(1)).over(Window.partitionBy())))
    rate = F.col("n").cast("double") / F.col("prev_n").cast("double")
    return (rows.filter((F.col("_days") >= 3) & (F.col("prev_n") > 0)).withColumn("change_rate", rate)
            .filter(F.col("change_rate") >= threshold)
            .select("date", "n", "prev_n", F.round("change_rate", digits).alias("change_rate"),
                    F.lit("burst").alias("type")))


def cooccurrence(texts: DataFrame, keywords: Keywords, least: int = 2) -> DataFrame:
    """(source, target, n): in how many texts two keywords occur together.

    Texts are first grouped by the set of keywords they hold, so pairs are formed once per distinct set and not
    once per text. Pairs are formed as rows, one member of the set after the other.
    """
    rows = texts.select("content").withColumn("_keys", as_array(keywords))
    present = rows.select(F.filter("_keys", lambda k: F.contains(F.col("content"), k)).alias("present"))
    grouped = present.filter(F.size("present") > 1).groupBy("present").agg(F.count(F.lit(1)).alias("n"))

    members = grouped.select("present", "n", F.posexplode("present").alias("i", "source"))
    rest = F.slice(F.col("present"), F.col("i") + 2, F.size("present"))
    pairs = members.select("n", "source", F.explode(rest).alias("target"))
    counted = pairs.groupBy("source", "target").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least)


def network_nodes(texts: DataFrame, k: int = 30, stopwords: Sequence[str] = (), digits: int = 4,
                  score: str = SCORE) -> DataFrame:
    """Keywords as nodes: weight, polarity, and a display size between 15 and 60."""
    top = fixed(text.keywords(texts, k, stopwords=stopwords))
    kinds = polarity(texts, top, score).select("keyword", "sentiment")
    size = F.greatest(F.lit(15), F.least(F.lit(60), F.floor(F.col("weight") * 100).cast("int")))
    return (top.join(kinds, top["word"] == kinds["keyword"])
            .select("keyword", F.round("weight", digits).alias("value"), "sentiment", size.alias("size")))


def network_links(texts: DataFrame, k: int = 30, stopwords: Sequence[str] = (), least: int = 2) -> DataFrame:
    return cooccurrence(texts, text.keywords(texts, k, stopwords=stopwords), least)


def drivers(texts: DataFrame, keyword: str, k: int = 10, stopwords: Sequence[str] = (),
            score: str = SCORE, digits: int = 6) -> DataFrame:
    """The k other words that weigh most in the texts with the keyword, with the positive and negative texts that hold
    them."""
    hits = texts.filter(filters.contains(F.col("content"), keyword))
    words = fixed(text.keywords(hits, k, stopwords=[*stopwords, keyword.lower()]))
    counts = polarity(hits, words, score)
    p, n = F.col("positive_count"), F.col("negative_count")
    return (words.join(counts, words["word"] == counts["keyword"]).filter(p + n > 0)
            .select("keyword", F.round("weight", digits).alias("weight"),
                    F.when(p > n, "positive").otherwise("negative").alias("sentiment"),
                    "positive_count", "negative_count"))


def driver_bands(texts: DataFrame, keyword: str, score: str = SCORE) -> DataFrame:
    hits = texts.filter(filters.contains(F.col("content"), keyword))
    return hits.agg(*bands.counts(F.col(score), bands.T4, null_is_neutral=True), F.count(F.lit(1)).alias("total"))


def opinions(texts: DataFrame, keyword: str, k: int = 10, score: str = SCORE, least: int = 10,
             longest: int = 200) -> DataFrame:
    """The k newest texts with the keyword that are long enough: key sentence, label, time."""
    hits = texts.filter(filters.contains(F.col("content"), keyword))
    usable = hits.filter(F.length("content") >= least)
    top = usable.orderBy(F.col("publish_time").desc(), "kind", "text_id", "content").limit(k)
    sentence = scalars.key_sentence(F.col("content"), keyword)
    return top.select("kind", "text_id", scalars.clip(sentence, longest).alias("summary"),
                      bands.label(F.col(score), bands.T4).alias("sentiment"),
                      F.col("publish_time").cast("string").alias("publish_time"))


def sentiment_by_date(texts: DataFrame, as_of, days: int, score: str = SCORE) -> DataFrame:
    """Daily band counts over the calendar, zeros included."""
    recent = texts.filter(times.since(F.col("publish_time"), as_of, days=days))
    seen = metrics.daily(recent, *bands.counts(F.col(score), bands.T4, null_is_neutral=True))
    return calendar_of(texts, as_of, days).join(seen, "date", "left").fillna(0)


def compare(texts: DataFrame, keywords: Sequence[str], as_of=None, days: int | None = None) -> DataFrame:
    """(date, keyword, n, total) over every date that has any text, zeros included; two keywords at least."""
    if len(set(keywords)) < 2:
        raise ValueError("two keywords are needed")
    rows = texts if days is None else texts.filter(times.since(F.col("publish_time"), as_of, days=days))
    slim = rows.filter(F.col("publish_time").isNotNull()).select(
        times.day(F.col("publish_time")).alias("date"), F.lower("content").alias("_body"))
    names = sorted(set(keywords))
    marks = [F.count_if(F.contains(F.col("_body"), F.lit(k.lower()))).alias(f"k{i}") for i, k in enumerate(names)]
    wide = slim.groupBy("date").agg(*marks)
    pairs = F.array(*[F.struct(F.lit(k).alias("keyword"), F.col(f"k{i}").alias("n")) for i, k in enumerate(names)])
    long = wide.select("date", F.explode(pairs).alias("p")).select("date", "p.keyword", "p.n")
    return long.withColumn("total", F.sum("n").over(Window.partitionBy("keyword")))


def keyword_trend(texts: DataFrame, keyword: str, as_of=None, days: int | None = None,
                  band: bands.Band = bands.T5) -> DataFrame:
    """Daily band counts of the texts with the keyword."""
    hits = mention_days(texts, keyword, as_of, days)
    return metrics.daily(hits, *bands.counts(F.col(SCORE), band), F.count(F.lit(1)).alias("total"))


def co_words(articles: DataFrame, events: DataFrame, keyword: str, k: int = 20,
             stopwords: Sequence[str] = ()) -> DataFrame:
    """Frequent plain words in articles, and titles, of events titled with the keyword."""
    rows = joins.articles_of_titled(articles, events, filters.titled(events, keyword))
    body = F.concat(F.coalesce("content", F.lit("")), F.lit(" "), F.coalesce("title", F.lit("")))
    found = rows.select(F.explode(scalars.plain_words(body, keyword, stopwords)).alias("name"))
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "name").limit(k)


def hot_words(events: DataFrame, as_of, days: int = 7, pool: int | None = None, k: int = 20,
              stopwords: Sequence[str] = ()) -> DataFrame:
    """Keywords of the titles of the period; `pool` looks at the hottest titles only."""
    rows = events.filter(times.since(F.col("crawl_time"), as_of, days=days))
    return text.keywords(rows if pool is None else ranking.hottest(rows, pool), k, "title", stopwords)


def word_cloud(texts: DataFrame, as_of=None, days: int | None = None, k: int = 50,
               stopwords: Sequence[str] = (), scale: float = 1000.0, digits: int = 2) -> DataFrame:
    rows = texts if days is None else texts.filter(times.since(F.col("publish_time"), as_of, days=days))
    top = text.keywords(rows, k, stopwords=stopwords)
    return top.withColumn("frequency", F.round(F.col("weight") * scale, digits))


def high_risk_words(comments: DataFrame, k: int = 10, below: float = 0.3, stopwords: Sequence[str] = ()) -> DataFrame:
    """Keywords of low-scored comments; the display weight falls by 0.05 per rank."""
    low = comments.filter(bands.is_negative(F.col(SCORE), bands.Band(below, 1.0))
                          & scalars.valid_content(F.col("content")))
    top = text.keywords(low, k, stopwords=stopwords)
    position = F.row_number().over(Window.orderBy(F.col("weight").desc(), "word"))
    return top.withColumn("position", position).withColumn(
        "display_weight", F.round(F.lit(1.0) - (F.col("position") - 1) * F.lit(0.05), 2))


def texts_with_titles(events: DataFrame, comments: DataFrame) -> DataFrame:
    """Comment texts and event titles as one table (event_id, content)."""
    titles = events.select(F.col("id").alias("event_id"), F.col("title").alias("content"))
    return comments.select("event_id", "content").unionByName(titles)
