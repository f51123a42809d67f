"""Hand-made fields: scripts, units, times and junk the generated tables lack."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from murmur.functions import bands, numbers, scalars, times, words


def one(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x")).alias("y")).collect()]


def test_clean_text(spark):
    raw = ["看 https://t.cn/abc 这里 @小明 #话题# 好！", "a@b.c  d", None, "  x\n\ty…(z) ", "#one# #two", "it's"]
    assert one(spark, raw, "string", scalars.clean_text) == ["看 这里 话题 好！", "a d", "", "x yz", "one two", "its"]


def test_clip(spark):
    assert one(spark, ["abcdef", "abc", None], "string", lambda c: scalars.clip(c, 3)) == ["abc...", "abc", None]


@pytest.mark.parametrize("raw,want", [("1.2万", 12000), ("3千", 3000), (" 45 ", 45), ("12赞", 12), ("赞", 0), ("", 0),
                                      (None, 0), ("x万", 0), ("1,234", 1234)])
def test_count_number(spark, raw, want):
    assert one(spark, [raw], "string", scalars.count_number) == [want]


@pytest.mark.parametrize("raw,want", [("1,234,567", 1234567), ("2.5亿", 250000000), ("30万", 300000), ("剧集 88", 88),
                                      ("n/a", 0), (None, 0)])
def test_heat_number(spark, raw, want):
    assert one(spark, [raw], "string", scalars.heat_number) == [want]


@pytest.mark.parametrize("raw,want", [("24-1-5 9:07", "2024-01-05 09:07"), ("\n 24-12-31  23:59 来自 x", "2024-12-31 23:59"),
                                      ("24-1-5", "2024-01-05 00:00"), ("刚刚", None), (None, None)])
def test_post_time(spark, raw, want):
    assert one(spark, [raw], "string", scalars.post_time) == [want]


def test_time_and_place(spark):
    raw = ["24-1-5 9:07 来自 北京12 。", "24-1-5", "来自上海"]
    assert one(spark, raw, "string", scalars.time_part) == ["24-1-5 9:07", "24-1-5", ""]
    assert one(spark, raw, "string", scalars.place_part) == ["北京", "unknown", "上海"]


def test_keys_are_stable(spark):
    df = spark.createDataFrame([("a", "t", None), ("a", "t", "7"), ("a", "t", "")], "u string, c string, id string")
    made = [r[0] for r in df.select(scalars.comment_key(F.col("id"), F.col("u"), F.col("c"))).collect()]
    assert made[0] == made[2] != "7" and made[1] == "7"


def test_validation(spark):
    assert one(spark, ["12", "-3", "x", None], "string", scalars.valid_heat) == [12, 0, 0, 0]
    assert one(spark, ["0.12349", "7", "-1", "x", None], "string", scalars.valid_score) == [0.123, 1.0, 0.0, 0.5, 0.5]
    stamps = one(spark, ["2024-01-05 01:02:03", "2024-01-05", "2024-1-5", None], "string",
                 lambda c: scalars.parse_datetime(c, date_only=True))
    assert stamps == [dt.datetime(2024, 1, 5, 1, 2, 3), dt.datetime(2024, 1, 5), None, None]


def test_key_sentence(spark):
    raw = ["短句。这一句里面有关键词而且足够长！末尾", "nothing here " * 20, "no"]
    got = one(spark, raw, "string", lambda c: scalars.key_sentence(c, "关键词"))
    assert got == ["这一句里面有关键词而且足够长", ("nothing here " * 20)[:100], "no"]


def test_words_of_mixed_scripts(spark):
    raw = ["Hello WORLD，再见", "中文分词 test", "好", "été ça va", "", None]
    got = one(spark, raw, "string", words.words_of)
    assert got == [["hello", "world", "再见"], ["中文", "文分", "分词", "test"], ["好"], ["été", "ça", "va"], [], []]


def test_bands_at_their_edges(spark):
    values = [Decimal("0.300"), Decimal("0.700"), Decimal("0.299"), Decimal("0.701"), None]
    assert one(spark, values, "decimal(4,3)", bands.label) == ["neutral", "neutral", "negative", "positive", "neutral"]
    assert one(spark, values, "decimal(4,3)", lambda c: bands.label(c, bands.T2))[1] == "positive"
    risk = one(spark, [Decimal("0.000"), Decimal("0.3"), Decimal("0.6"), None], "decimal(4,3)", bands.risk_level)
    assert risk == ["high", "medium", "low", "low"]


def test_means_of_nothing(spark):
    empty = spark.createDataFrame([], "x decimal(4,3)")
    got = empty.agg(numbers.mean(F.col("x")).alias("a"), numbers.mean_or(F.col("x"), 0.5).alias("b")).first()
    assert got == (None, 0.5)


def test_time_factor(spark):
    now = dt.datetime(2024, 1, 2)
    got = one(spark, [now, now - dt.timedelta(days=1), now - dt.timedelta(days=900), None], "timestamp_ntz",
              lambda c: times.time_factor(c, now))
    assert got[0] == 1.0 and got[1] == pytest.approx(0.904837418) and got[2] == 0.1 and got[3] == 0.5


def test_score_rules(spark):
    lex = words.Lexicon(("good",), ("bad",), ("the",))
    df = spark.createDataFrame([("good good day",), ("bad",), ("good bad",), ("the the",), ("",), (None,)], "content string")
    got = [r.score for r in words.with_score(df, F.lit(0.5), cal=words.Calibration(lexicon=lex)).collect()]
    weight = 0.08 / (1 + 0.01 * 3 ** 0.5)
    assert got == [round(0.5 + 2 * weight, 3), round(0.5 - 0.08 / 1.01, 3), 0.5, 0.5, 0.5, 0.5]


def test_long_text_is_scored_whole(spark):
    lex = words.Lexicon(("good",), ("bad",), ())
    df = spark.createDataFrame([("x " * 5000 + "good",)], "content string")
    assert words.with_score(df, F.lit(0.5), cal=words.Calibration(lexicon=lex)).first().score > 0.5


def test_lexicon_can_grow():
    lex = words.Lexicon(("a",), ("b",), ()).extended(["a", "c"], ["d"], ["e"])
    assert (lex.positive, lex.negative, lex.stopwords) == (("a", "c"), ("b", "d"), ("e",))
