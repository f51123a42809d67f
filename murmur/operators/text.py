"""Word counts, weighted keywords and re-scoring of whole text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmur.functions import bands, numbers, scalars, times, words
from murmur.operators import metrics


def rescored(df: DataFrame, base: Column | None = None, text: str = "content",
             cal: words.Calibration | None = None, digits: int = 3) -> DataFrame:
    """The table with score and type computed anew from its texts; partitions do the work in parallel."""
    base = F.lit(0.5) if base is None else base
    scored = words.with_score(df, base, text, "_score", cal)
    return (scored.withColumn("sentiment_score", F.round("_score", digits))
            .withColumn("sentiment_type", bands.label(F.col("_score"))).drop("_score"))


def word_counts(df: DataFrame, k: int, text: str = "content") -> DataFrame:
    """Most frequent words longer than one character that are not numbers."""
    rows = df.select(F.explode(words.words_of(F.col(text))).alias("word"))
    kept = rows.filter((F.length("word") > 1) & ~F.col("word").rlike(r"^\p{Nd}+$"))
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "word").limit(k)


def word_totals(texts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., word, n, texts): occurrences and number of texts of each word; the null word counts the texts that
    are not blank.

    One explode and one shuffle. Inside a text the words are sorted, so its first occurrence is known without
    grouping by text; counts are combined in the map tasks.
    """
    ends = F.array(F.lit(None).cast("string"))
    ordered = texts.select(*by, (F.col("clean") != "").cast("int").alias("_some"), F.concat(
        ends, F.sort_array(words.split_words(F.col("clean")))).alias("_words"))
    # A plain column and its positions, no function of elements: so rows are made and counted in compiled code. Outer,
    # because else a test on the array would be pushed below the cleaning and clean every text twice.
    rows = ordered.select(*by, "_some", "_words", F.posexplode_outer("_words").alias("_i", "word"))
    again = F.get(F.col("_words"), F.col("_i") - 1).eqNullSafe(F.col("word"))
    first = F.when(F.col("word").isNull(), F.col("_some")).otherwise((~again).cast("int"))
    return rows.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"), F.sum(first).alias("texts"))


def clean_distinct(df: DataFrame, text: str = "content", by: Sequence[str] = ()) -> DataFrame:
    """Cleaned texts without repeats (within each group). The blank text may be among them: a filter here would be
    pushed below the cleaning and clean every text twice."""
    return df.select(*by, scalars.clean_text(F.col(text)).alias("clean")).distinct()


def weighted_words(df: DataFrame, text: str = "content", idf: DataFrame | None = None,
                   default_idf: float = 1.0, allow: DataFrame | None = None) -> DataFrame:
    """(word, weight) of every word: share of all words times idf.

    idf comes from the texts themselves, or from a table (word, idf); `allow` (word) restricts the words.
    """
    counts = word_totals(clean_distinct(df, text))
    is_word = F.col("word").isNotNull()
    totals = counts.agg(F.struct(
        F.sum(F.when(is_word, F.col("n"))).alias("words"),
        F.sum(F.when(~is_word, F.col("texts"))).alias("texts"))).scalar()
    rows = counts.withColumn("_t", totals)
    share = F.col("n").cast("double") / F.col("_t.words").cast("double")
    if idf is None:
        value = words.log_idf(F.col("_t.texts"), F.col("texts"))
    else:
        rows = rows.join(idf, "word", "left")
        value = F.coalesce("idf", F.lit(default_idf))
    # The test on the weight, not on the word, keeps both uses of the counts one shuffle.
    weighted = (rows.withColumn("weight", F.when(is_word, share * value)).filter(F.col("weight").isNotNull())
                .select("word", "weight"))
    return weighted if allow is None else weighted.join(allow.select("word").distinct(), "word", "left_semi")


def keywords(df: DataFrame, k: int = 20, text: str = "content", stopwords: Sequence[str] = (),
             filter_first: bool = True, **options) -> DataFrame:
    """The k heaviest words that are no stopwords. With `filter_first=False` the stopwords are removed from the k
    heaviest afterwards, so fewer than k may remain."""
    rows = weighted_words(df, text, **options)
    kept = ~words.member(F.col("word"), stopwords)
    if filter_first:  # a test on the weight again: one on the word would go below the counts and make a second pass
        rows = rows.filter(F.when(kept, F.col("weight")).isNotNull())
    top = rows.orderBy(F.col("weight").desc(), F.col("word").asc()).limit(k)
    return top if filter_first or not stopwords else top.filter(kept)


def keywords_per_event(df: DataFrame, k: int = 30, event: str = "event_id", text: str = "content",
                       stopwords: Sequence[str] = ()) -> DataFrame:
    """The k heaviest words of every event that are no stopwords: share within the event, idf over all texts."""
    # Joins on the event leave out rows without one, while idf counts them. They are taken apart here, else the test for
    # them would go into some uses of the texts only, and all texts would be cleaned, dealt out and counted twice.
    texts, others = (clean_distinct(df.filter(f), text, [event]) for f in (F.col(event).isNotNull(), F.col(event).isNull()))
    n_texts = texts.unionByName(others).agg(F.count_if(F.col("clean") != "")).scalar()
    counts, more = (word_totals(x, [event]).filter(F.col("word").isNotNull()) for x in (texts, others))
    # Both sums name both counts, which are never negative: the three uses then have the same columns and share
    # one pass over the texts and one shuffle.
    n, held = F.col("n"), F.col("texts")
    per_event = counts.groupBy(event).agg(F.sum(F.when(held >= 0, n)).alias("_words"))
    overall = counts.unionByName(more).groupBy("word").agg(F.sum(F.when(n >= 0, held)).alias("_df"))
    rows = counts.join(per_event, event).join(overall, "word").withColumn("_n", n_texts)
    share = n.cast("double") / F.col("_words").cast("double")
    idf = F.when(held >= 0, words.log_idf(F.col("_n"), F.col("_df")))
    weighted = rows.select(event, "word", (share * idf).alias("weight"))
    if stopwords:
        weighted = weighted.filter(~words.member(F.col("word"), stopwords))
    order = Window.partitionBy(event).orderBy(F.col("weight").desc(), F.col("word").asc())
    return weighted.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def newest_rows(df: DataFrame, n: int | None, key: str, time: str = "publish_time") -> DataFrame:
    return df if n is None else df.orderBy(F.col(time).desc(), F.col(key).asc()).limit(n)


def overview(events: DataFrame, comments: DataFrame, base: Column, newest: int | None = None,
             key: str = "comment_id", cal: words.Calibration | None = None, digits: int = 3) -> DataFrame:
    """One row: events, comments, mean likes, mean of the re-scored comments (all in one pass, or the newest n)."""
    n_events = metrics.row_count(events).scalar()
    mean = F.round(F.coalesce(numbers.mean_score(F.col("score")), F.lit(0.5)), digits).alias("avg_sentiment")
    likes = F.round(F.coalesce(numbers.mean(F.coalesce("like_count", F.lit(0))), F.lit(0.0)), digits).alias("avg_likes")
    counts = [F.count(F.lit(1)).alias("total_comments"), likes]
    if newest is None:
        rows = words.with_score(comments, base, cal=cal).agg(*counts, mean)
    else:
        part = words.with_score(newest_rows(comments, newest, key), base, cal=cal).agg(mean)
        rows = comments.agg(*counts).withColumn("avg_sentiment", part.scalar())
    return rows.select(n_events.alias("total_events"), "total_comments", "avg_likes", "avg_sentiment")


def rescored_daily(comments: DataFrame, base: Column, newest: int | None = None, key: str = "comment_id",
                   cal: words.Calibration | None = None, digits: int = 3) -> DataFrame:
    scored = words.with_score(newest_rows(comments, newest, key), base, cal=cal)
    return metrics.daily(scored, F.round(numbers.mean_score(F.col("score")), digits)
                         .alias("avg_sentiment"))


def rescored_bands(comments: DataFrame, base: Column, newest: int | None = None, key: str = "comment_id",
                   band: bands.Band = bands.T1, cal: words.Calibration | None = None) -> DataFrame:
    scored = words.with_score(newest_rows(comments, newest, key), base, cal=cal)
    return scored.agg(*bands.counts(F.col("score"), band))


def landing_stats(events: DataFrame, comments: DataFrame, risky: DataFrame, as_of, days: int = 7, k: int = 20,
                  stopwords: Sequence[str] = ()) -> DataFrame:
    """Comments of the day, risky events, and how many keywords the titles of the last days give."""
    titles = events.filter(times.since(F.col("crawl_time"), as_of, days=days))
    found = metrics.row_count(keywords(titles, k, "title", stopwords)).scalar()
    today = comments.filter(times.on_day(F.col("publish_time"), as_of))
    return today.agg(F.count(F.lit(1)).alias("today_comments")).select(
        "today_comments", metrics.row_count(risky).scalar().alias("risk_count"), found.alias("burst_count"))
