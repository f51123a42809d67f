"""Nulls, empty tables, ties, hot groups and constants."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.functions import bands, marks, words
from murmur.operators import filters, forecast, forest, insights, joins, keywords, metrics, ranking, scoring, sets, text
from murmur.plans import base_score, reports

TOPICS = [("sport", "football|足球"), ("technology", "phone|手机"), ("never met", "zzzz")]

DAY = dt.datetime(2024, 1, 10)
COMMENT = "comment_id long, event_id long, user_id long, content string, like_count int, sentiment_score decimal(4,3), publish_time timestamp_ntz"
EVENT = "id long, title string, heat long, crawl_time timestamp_ntz, sentiment_score decimal(4,3)"


def comments(spark, rows):
    from decimal import Decimal
    full = [(i, e, u, c, l, None if s is None else Decimal(str(s)), p) for i, e, u, c, l, s, p in rows]
    return spark.createDataFrame(full, COMMENT)


def events(spark, rows):
    from decimal import Decimal
    return spark.createDataFrame([(i, t, h, c, None if s is None else Decimal(str(s))) for i, t, h, c, s in rows], EVENT)


@pytest.fixture
def talk(spark):
    return comments(spark, [
        (1, 1, 1, "good thing", 5, 0.9, DAY), (2, 1, 1, "good thing", None, None, DAY), (3, 1, 2, "", 2, 0.1, DAY),
        (4, None, 1, "x", 1, 0.2, DAY), (5, None, 1, "x", 1, 0.2, DAY), (6, 2, 3, None, 200, 0.3, None)])


def test_null_policies(talk):
    row = {r.id: r for r in metrics.mean_sentiment(talk, True).collect()}
    assert row[1].avg_sentiment == 0.5 and row[2].avg_sentiment == 0.3 and None not in row
    assert metrics.mean_likes(talk).first().avg_likes == round(209 / 6, 1)
    assert metrics.band_counts(talk, null_is_neutral=True).first() == (1, 2, 3, 6)
    assert metrics.like_histogram(talk).first() == (1, 4, 0, 1)
    assert metrics.known_mean_sentiment(talk).first().avg_sentiment == round((0.9 + 0.2 + 0.2) / 3, 2)


def test_empty_tables(spark):
    none, no_events = comments(spark, []), events(spark, [])
    assert metrics.mean_sentiment(none).first()[0] == 0.5
    assert metrics.whole_percents(none).first() == (35, 50, 15)
    assert metrics.risk_index(no_events, none, DAY).first().risk_index == 0.0
    assert insights.risk_warning(no_events, none).count() == 0
    assert forecast.forecast(metrics.daily_history(none)).count() == 0
    assert forest.detect(no_events, none).count() == 0
    assert text.keywords(none, 5).count() == 0
    assert metrics.hour_counts(none).count() == 24
    board = ranking.event_board(events(spark, [(1, "t", 5, DAY, None)]), none).first()
    assert (board.positive_pct, board.neutral_pct, board.negative_pct, board.risk_level) == (0.0, 100.0, 0.0, "low")


def test_whole_percents_add_up(spark):
    rows = [(i, 1, 1, "x", 0, s, DAY) for i, s in enumerate([0.9, 0.5, 0.1])]
    assert sum(metrics.whole_percents(comments(spark, rows)).first()) == 100


def test_duplicates_with_null_keys(talk):
    kept = sorted(r.comment_id for r in sets.without_duplicates(talk, key="comment_id").collect())
    assert kept == [1, 3, 4, 6]
    assert metrics.duplicate_groups(talk).first() == (2, 2)
    assert metrics.duplicate_groups(sets.without_duplicates(talk, key="comment_id")).first() == (0, 0)


def test_silent_events_count_as_risky(spark, talk):
    e = events(spark, [(1, "a", 9000, DAY, 0.5), (7, "silent", 9000, DAY, 0.5), (8, "cool", 10, DAY, 0.5)])
    assert sorted(r.id for r in joins.risky_or_silent_events(e, talk, DAY).collect()) == [1, 7]
    assert [r.id for r in joins.negative_events(e, talk).collect()] == [1]


def test_literal_search(spark):
    e = events(spark, [(1, "100% sure", 1, DAY, None), (2, "100 sure", 1, DAY, None)])
    assert [r.id for r in filters.titled(e, "100%").collect()] == [1]
    assert [r.id for r in filters.titled(e, "SURE").orderBy("id").collect()] == [1, 2]


def test_paging(spark):
    e = events(spark, [(i, "t", 5, DAY, None) for i in range(25)])
    pages = [[r.id for r in filters.page(e, ranking.hottest_first(), n, 10).collect()] for n in (1, 2, 3)]
    assert [len(p) for p in pages] == [10, 10, 5] and sorted(sum(pages, [])) == list(range(25))
    assert filters.page_count(e, 10).first() == (25, 3)
    assert filters.clamp_page(9, 3) == 3 and filters.clamp_page(0, 3) == 1


def test_hot_event_keeps_all_its_rows(spark):
    rows = [(i, 1 if i % 3 else 2, 1, f"c{i}", 1, 0.5, DAY + dt.timedelta(seconds=i)) for i in range(3000)]
    df = comments(spark, rows)
    assert {r.id: r.comment_count for r in metrics.comment_count(df, True).collect()} == {1: 2000, 2: 1000}
    top = filters.newest_per_event(df, 5, "comment_id")
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.comment_id for r in top.filter("event_id = 1").collect()) == [2993, 2995, 2996, 2998, 2999]


def test_windows_that_widen(spark):
    rows = [(i, 1, 1, "x", 1, 0.5, DAY - dt.timedelta(days=200)) for i in range(3)]
    df = comments(spark, rows)
    assert sets.recent_or_wider(df, DAY, 30).count() == 3          # empty window: 365 days
    near = df.unionByName(comments(spark, [(9, 1, 1, "y", 1, 0.5, DAY)]))
    assert sets.recent_or_wider(near, DAY, 30).count() == 1        # few texts: 180 days
    assert sets.recent_or_wider(near, DAY, 30, least=1).count() == 1


def texts(spark, rows):
    return spark.createDataFrame([("comment", i, 1, c, p, s) for i, (c, p, s) in enumerate(rows)],
                                 "kind string, text_id long, event_id long, content string, publish_time timestamp_ntz, sentiment_score double")


def test_keyword_rules(spark):
    df = texts(spark, [("apple pie", DAY, 0.9), ("apple tart", DAY, 0.1), ("apple", DAY, 0.8), ("pear pie", DAY, 0.5)])
    got = {r.keyword: r.sentiment for r in keywords.polarity(df, ["apple", "pie", "none"]).collect()}
    assert got == {"apple": "positive", "pie": "neutral", "none": "neutral"}
    pairs = {(r.source, r.target): r.n for r in keywords.cooccurrence(df, ["apple", "pie", "tart"], least=1).collect()}
    assert pairs == {("apple", "pie"): 1, ("apple", "tart"): 1}


def test_cooccurrence_against_brute_force(spark, t):
    words = ["the", "of", "thing", "nicht", "pour", "is", "and", "th"]
    df = sets.all_texts(t.replies, t.articles)
    rows = [r.content for r in df.select("content").collect()]
    want = {}
    for body in rows:
        inside = sorted(w for w in words if w in body)
        for i, a in enumerate(inside):
            for b in inside[i + 1:]:
                want[a, b] = want.get((a, b), 0) + 1
    got = {(r.source, r.target): r.n for r in keywords.cooccurrence(df, words, least=1).collect()}
    assert got == want


def test_burst_points_need_three_days(spark):
    two = texts(spark, [("k", DAY, 0.5)] + [("k", DAY + dt.timedelta(days=1), 0.5)] * 5)
    assert keywords.burst_points(two, "k").count() == 0
    three = two.unionByName(texts(spark, [("k", DAY + dt.timedelta(days=9), 0.5)]))
    assert [(r.n, r.prev_n, r.change_rate) for r in keywords.burst_points(three, "k").collect()] == [(5, 1, 5.0)]


def test_compare_needs_two_words(spark):
    with pytest.raises(ValueError):
        keywords.compare(texts(spark, []), ["a", "a"])


def test_supplied_idf(spark):
    df = texts(spark, [("a a b", DAY, 0.5), ("a a b", DAY, 0.5), ("c", DAY, 0.5)])
    idf = spark.createDataFrame([("a", 2.0), ("b", 10.0)], "word string, idf double")
    got = {r.word: r.weight for r in text.keywords(df, 5, idf=idf).collect()}
    assert got == {"a": 2 / 4 * 2.0, "b": 1 / 4 * 10.0, "c": 1 / 4}
    allow = spark.createDataFrame([("b",)], "word string")
    assert [r.word for r in text.keywords(df, 5, idf=idf, allow=allow).collect()] == ["b"]


def test_stopwords_after_the_cut(spark):
    df = texts(spark, [("the the the cat", DAY, 0.5), ("dog", DAY, 0.5)])
    assert [r.word for r in text.keywords(df, 1, stopwords=["the"], filter_first=False).collect()] == []
    assert [r.word for r in text.keywords(df, 1, stopwords=["the"]).collect()] == ["cat"]


def test_word_weights_read_the_texts_once(spark, t):
    df = text.weighted_words(t.articles)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_constant_feature(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (2, 2.0, 3.0)], "id int, a double, b double")
    got = [(r.z_a, r.z_b) for r in scoring.standardised(df, ("a", "b")).orderBy("id").collect()]
    assert got == [(0.0, -1.0), (0.0, 1.0)]


def test_forecast_against_numpy(spark):
    rng = np.random.default_rng(3)
    for n in (2, 5, 14, 90):
        y = np.round(rng.uniform(0.2, 0.8, n), 6)
        daily = spark.createDataFrame([(f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", float(v)) for i, v in enumerate(y)],
                                      "date string, avg_sentiment double")
        w = min(max(14, n // 4), n)
        s = 0.3 * np.polyfit(range(w), y[-w:], 1)[0] + 0.7 * np.polyfit(range(min(7, n)), y[-min(7, n):], 1)[0]
        weights = np.exp(np.linspace(0, 1, w))
        base = np.average(y[-w:], weights=weights)
        want = [min(max(base + s * i / (1 + 0.1 * i), 0.1), 0.9) for i in range(1, 8)]
        got = forecast.forecast(daily, 7, digits=9).orderBy("step").collect()
        assert [r.prediction for r in got] == pytest.approx(want, abs=1e-8)
        assert got[0].confidence == pytest.approx(min(0.5 + n / 200 + abs(s) * 5, 0.95), abs=1e-6)


def planted(spark, n=400, odd=8):
    rng = np.random.default_rng(1)
    body = rng.normal(size=(n, 3))
    body[:odd] += 12
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(body)], "id long, a double, b double, c double")


def test_forest_finds_planted_outliers(spark):
    df = planted(spark)
    made = forest.fit(df, "id", ["a", "b", "c"])
    scores = forest.score(df, made).orderBy("raw_score", "id").collect()
    assert {r.id for r in scores[:8]} == set(range(8))
    flagged = [r for r in scores if round(r.raw_score - made.cutoff, 6) < 0]
    assert abs(len(flagged) - 20) <= 1
    again = forest.fit(df.repartition(7), "id", ["a", "b", "c"])
    assert again.cutoff == made.cutoff and np.array_equal(again.split, made.split)


def test_forest_cutoff_is_the_percentile(spark):
    df = planted(spark, 57)
    made = forest.fit(df, "id", ["a", "b", "c"], contamination=0.1)
    raw = [r.raw_score for r in forest.score(df, made).collect()]
    assert made.cutoff == pytest.approx(np.percentile(raw, 10))


def test_forest_needs_ten_rows(spark):
    assert forest.fit(planted(spark, 9, 1), "id", ["a", "b", "c"]) is None


def test_trained_score_follows_labels(t):
    scored = base_score.with_base(t.articles, base_score.fit(t.articles))
    got = {r.quality: r.m for r in scored.filter("quality is not null").groupBy("quality").agg(F.avg("base_score").alias("m")).collect()}
    assert got[1] > got[0]


def test_trained_score_sends_neither_texts_nor_words(spark):
    """Before, each different word of each text was sent three times."""
    rows = [(1, "good good day", 1), (2, "bad day", 0), (3, "bad bad bad", 0), (4, None, None), (5, "", None), (6, "unseen words", None),
            (7, "good bad day", None), (7, "good bad day", None), (None, "good unseen", None), (8, "good good day", 1)]
    df = spark.createDataFrame(rows, "id long, content string, quality int")
    model = base_score.fit(df)
    scored = base_score.with_base(df, model)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString() and scored.columns == [*df.columns, "base_score"]
    weights = {r.word: r.weight for r in model.weights.collect()}
    assert set(weights) == {"good", "bad", "day"}

    def score(text):
        return round(1 / (1 + np.exp(-(sum(weights.get(w, 0.0) for w in (text or "").split()) + model.prior))), 6)

    got = [(r.id, r.content, r.base_score) for r in scored.collect()]
    assert sorted(map(str, got)) == sorted(str((i, c, float(score(c)))) for i, c, _ in rows)
    nothing = base_score.Model(model.weights.filter("word = ''"), model.prior)
    assert {r.base_score for r in base_score.with_base(df, nothing).collect()} == {float(score(""))}


def test_recommendations(spark):
    row = spark.createDataFrame([(0.3, 2, "down", "a very long title indeed", 90.0)],
                                "avg_sentiment double, high_severity_count long, current_trend string, top_title string, top_influence double")
    kinds = [r.type for r in insights.recommendations(row).collect()]
    assert kinds == ["negative opinion", "risky events", "falling trend", "hot event"]
    calm = spark.createDataFrame([(0.5, 0, "flat", "t", 1.0)], row.schema)
    assert [r.type for r in insights.recommendations(calm).collect()] == ["normal"]


def test_report_has_one_row(t):
    row = reports.summary(t.hot_events, t.comments, "2001-08-01", 30, None).collect()
    assert len(row) == 1 and len(row[0].predictions) == 7 and row[0].anomalies.total > 0


def test_large_keyword_tables_use_the_join(spark, t):
    df = t.articles
    bodies = {r.article_id: r.content for r in df.select("article_id", "content").collect()}
    some = sorted({b[i:i + n] for b in list(bodies.values())[:20] for i in (0, 40) for n in (1, 2, 5, 9)} | {"zzzz", ""})
    table = spark.createDataFrame([(w,) for w in some], "keyword string")
    want = sorted((k, w) for k, b in bodies.items() for w in some if w and w in b)
    got = sorted((r.article_id, r.keyword) for r in joins.keyword_hits_by_join(df, "article_id", table).collect())
    assert got == want
    assert joins.keyword_hits_by_join(df, "article_id", table.limit(0)).count() == 0
    assert len(keywords.as_list([str(i) for i in range(3000)])) == 3000


def test_both_keyword_ways_agree_on_repeated_keys_and_texts(spark):
    rows = [(1, "red widget"), (1, "red widget"), (1, "blue rod"), (2, "red widget"), (3, None), (3, "")]
    df = spark.createDataFrame(rows, "id long, content string")
    some = ["red", "red widget", "w", "rod", "widgets"]
    table = spark.createDataFrame([(w,) for w in some], "keyword string")
    joined = sorted((r.id, r.keyword) for r in joins.keyword_hits_by_join(df, "id", table).collect())
    inline = sorted((r.id, r.keyword) for r in joins.keyword_hits(df, some).collect())
    assert joined == inline and joined.count((1, "red")) == 2


def test_scores_by_table_keep_rows_with_equal_keys(spark):
    df = spark.createDataFrame([(1, "good day", 0.5), (1, "bad day", 0.5), (1, "bad day", 0.5), (2, None, 0.9)],
                               "id long, content string, base double")
    lexicon = spark.createDataFrame([("good", "pos"), ("bad", "neg")], "word string, kind string")
    got = sorted((r.id, r.score) for r in words.scored_by_join(df, "id", F.col("base"), lexicon).collect())
    cal = words.Calibration(lexicon=words.Lexicon(("good",), ("bad",), ()))
    want = sorted((r.id, r.score) for r in words.with_score(df, F.col("base"), cal=cal).collect())
    assert got == want and len(got) == 4


def test_windows_end_at_as_of(spark):
    rows = [(i, 1, 1, "x", 1, 0.5, DAY + dt.timedelta(hours=h)) for i, h in enumerate((-50, -24, -1, 0, 1, 30))]
    df = comments(spark, rows)
    inside = df.filter(filters.times.since(F.col("publish_time"), DAY, hours=24))
    assert sorted(r.comment_id for r in inside.collect()) == [1, 2, 3]
    assert metrics.daily_availability(df, DAY, (1, 7)).first() == (2, 3)
    factor = df.select(filters.times.time_factor(F.col("publish_time"), DAY).alias("f")).collect()
    assert max(r.f for r in factor) == 1.0


def test_no_event_is_left_out_of_category_heat(spark):
    e = events(spark, [(i, "football" if i % 2 else "x", i, DAY, None) for i in range(1500)])
    got = {r.category: r.n for r in ranking.category_heat(e, TOPICS).collect()}
    assert got["sport"] == 750 and got["other"] == 750
    assert sum(r.n for r in ranking.category_heat(e, TOPICS, pool=10).collect()) == 10


def test_cutoff_of_ties_and_negative_scores(spark):
    for raw in ([-0.5] * 30, [-0.9, -0.1] * 20 + [-0.123456], [-(i % 17) / 17 for i in range(200)]):
        df = spark.createDataFrame([(round(v, 6),) for v in raw], "raw_score double")
        assert forest.cutoff(df, len(raw), 0.05) == pytest.approx(np.percentile(np.round(raw, 6), 5))


def test_categories_by_rules(spark):
    e = events(spark, [(1, "足球 决赛", 1, DAY, None), (2, "New PHONE", 1, DAY, None), (3, "nothing", 1, DAY, None), (4, " ", 1, DAY, None)])
    assert {r.category: r.n for r in ranking.category_counts(e, TOPICS).collect()} == {"sport": 1, "technology": 1, "other": 1}
    assert ranking.category_heat(e, TOPICS).count() == 4


def test_band_bounds_are_arguments(spark, talk):
    assert metrics.band_counts(talk, bands.T5).first()[:3] == (4, 1, 0)


def test_counts_of_keywords_equal_those_of_the_hits(spark, monkeypatch):
    rows = [(1, "red widget"), (1, "red widget"), (1, "blue rod"), (2, "red widget"), (3, None), (3, ""), (None, "red rod"),
            *[(4, f"red {i}") for i in range(9)], (5, "red 1"), (5, "red 2"), (6, "red 2"), (6, "red 1")]
    df = spark.createDataFrame(rows, "id long, content string")
    table = spark.createDataFrame([(w,) for w in ("red", "red widget", "w", "rod", "1", "2", "none", "")], "keyword string")
    hits = joins.keyword_hits_by_join(df, "id", table).groupBy("keyword").agg(F.count(F.lit(1)), F.countDistinct("id"))
    want = sorted(tuple(r) for r in hits.collect())
    for few in (64, 3):  # with the key of nine texts among the sets, and by itself
        monkeypatch.setattr(joins, "FEW_TEXTS", few)
        assert sorted(tuple(r) for r in joins.keyword_counts_by_join(df, "id", table).collect()) == want
    assert ("red", 17, 5) in want


def test_few_pieces_of_a_long_text_go_to_the_join_with_keywords(spark):
    body = "".join(f"{i} Ж𝄞 " for i in range(3000)) + "worthless thing"
    texts = spark.createDataFrame([("a", body)], "_hash string, _body string")
    words_ = ["7", "99 ", "2999 Ж𝄞", "worthless t", "worthless thing", "worthless thing and more", "absent"]
    starts = joins.keyword_starts(spark.createDataFrame([(w,) for w in words_], "keyword string"))
    assert joins.marked_pieces(texts, starts).count() < 20
    got = joins.keyword_hits_by_join(texts.select(F.lit(1).alias("id"), F.col("_body").alias("content")), "id", starts)
    assert sorted(r.keyword for r in got.collect()) == sorted(w for w in words_ if w in body)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_lists_are_counted_without_sending_texts(spark):
    df = spark.createDataFrame([(1, "good the good bad", 0.5), (1, "good the good bad", 0.1), (2, "", 0.5), (3, None, 0.5),
                                (4, "the", 0.9), (5, "stop good stop", 0.5), (6, "plain words", 0.7)], "id long, content string, base double")
    lists = [("good", "pos"), ("bad", "neg"), ("the", "stop"), ("stop", "stop"), ("stop", "pos")]
    scored = words.scored_by_join(df, "id", F.col("base"), spark.createDataFrame(lists, "word string, kind string"))
    assert "first(_text" not in plan_of(scored) and "first(content" not in plan_of(scored)
    cal = words.Calibration(lexicon=words.Lexicon(("good",), ("bad",), ("the", "stop")))
    want = sorted((r.id, r.score) for r in words.with_score(df, F.col("base"), cal=cal).collect())
    assert sorted((r.id, r.score) for r in scored.collect()) == want and len(want) == 7
    got = df.filter("id = 5").select(words.counted(F.split("content", " ")).alias("c")).first().c
    assert [tuple(r) for r in got] == [("good", 1), ("stop", 2)]


def test_marks_of_many_values_let_few_others_pass(spark):
    values = spark.range(200_000).select(F.concat(F.lit("keyword "), "id").alias("v"))
    bits = marks.of(values, "v")
    assert values.filter(marks.is_marked(F.col("v"), bits)).count() == 200_000
    others = spark.range(200_000).select(F.concat(F.lit("other "), "id").alias("v"))
    assert others.filter(marks.is_marked(F.col("v"), bits)).count() < 200  # about 9,300 with one bit of 4 million


def test_keywords_with_stopwords_count_words_in_one_pass(spark):
    """A filter on the word went below one of the two uses of the counts, so words were split and counted twice."""
    texts = spark.createDataFrame([("b b a the",), ("b c the",), ("b c the",), ("",), (None,)], "content string")
    counts = {r.word: (r.n, r.texts) for r in text.word_totals(text.clean_distinct(texts)).filter("word IS NOT NULL").collect()}
    assert counts == {"b": (3, 2), "a": (1, 1), "c": (1, 1), "the": (2, 2)}
    top = text.keywords(texts, 5, stopwords=["the"])
    rows = top.collect()
    assert {r.word for r in rows} == {"a", "b", "c"}
    lines = top._jdf.queryExecution().optimizedPlan().toString().splitlines()
    tests = [line for line in lines if "Filter" in line and "= the" in line]
    assert tests and all("CASE WHEN" in line for line in tests)
    assert not any("size(_words" in line for line in lines if "Filter" in line)  # which would clean the texts twice
