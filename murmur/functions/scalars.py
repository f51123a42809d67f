"""Column expressions that turn raw post fields into clean columns. All stay JVM-side."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, units and markers of the source platform.
URL = r"https?://\S+"
MENTION = r"@\S+"
NOT_KEPT = r"[^\p{L}\p{N}_\s，。！？]+"
SPACES = r"\s+"
TEN_THOUSAND, THOUSAND, HUNDRED_MILLION = "万", "千", "亿"
PLACE_MARKER = "来自"
POST_DATE = r"(\d{2})-(\d{1,2})-(\d{1,2})"
POST_DATE_TIME = POST_DATE + r" (\d{1,2}):(\d{2})"
WORD_BREAKS = "，。！？,.\""
HIGH_HEAT = 1000


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once although the body names it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kept_text(text: Column) -> Column:
    """The text without links, mentions and all but letters, digits, spaces and four marks.

    One pass: links and mentions run to the next space, so it does not matter which is removed first, and a
    #topic# is unwrapped because # is not kept.
    """
    raw = F.coalesce(text, F.lit(""))
    marked = F.contains(raw, F.lit("@")) | F.contains(raw, F.lit("http"))
    return (F.when(marked, F.regexp_replace(raw, f"{URL}|{MENTION}|{NOT_KEPT}", ""))
            .otherwise(F.regexp_replace(raw, NOT_KEPT, "")))


def clean_text(text: Column) -> Column:
    """The kept text with spaces squeezed and trimmed."""
    return F.trim(F.regexp_replace(kept_text(text), SPACES, " "))


def clip(text: Column, length: int, mark: str = "...") -> Column:
    """The text, or its first `length` characters and a mark when it is longer. A display column."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(mark))).otherwise(text)


def valid_content(content: Column) -> Column:
    return content.isNotNull() & (content != "")


def valid_heat(raw: Column) -> Column:
    """Whole number, 0 when missing or unreadable, never negative."""
    return F.greatest(F.coalesce(raw.try_cast("bigint"), F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))


def valid_score(raw: Column) -> Column:
    """Three decimals in 0..1, 0.5 when missing or unreadable."""
    number = F.coalesce(raw.try_cast("double"), F.lit(0.5))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(number, 3)))


def parse_datetime(raw: Column, date_only: bool = False) -> Column:
    """yyyy-MM-dd HH:mm:ss, optionally also yyyy-MM-dd; otherwise null."""
    stamp = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), raw.try_cast("timestamp_ntz"))
    if not date_only:
        return stamp
    date = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), raw.try_cast("timestamp_ntz"))
    return F.coalesce(stamp, date)


def _scaled(text: Column, unit: str, factor: int) -> Column:
    return F.floor(F.replace(text, F.lit(unit), F.lit("")).try_cast("double") * factor).cast("bigint")


def count_number(raw: Column) -> Column:
    """Counter text to a number: unit suffixes, else the digits of the text, else 0."""
    text = F.trim(raw)
    digits = F.regexp_replace(text, r"\D", "").try_cast("bigint")
    value = (F.when(F.contains(text, F.lit(TEN_THOUSAND)), _scaled(text, TEN_THOUSAND, 10_000))
             .when(F.contains(text, F.lit(THOUSAND)), _scaled(text, THOUSAND, 1_000))
             .otherwise(digits))
    return F.coalesce(value, F.lit(0).cast("bigint"))


def heat_number(raw: Column) -> Column:
    """Heat text to a number: commas dropped, unit suffixes, else the first run of digits, else 0."""
    text = F.replace(F.trim(raw), F.lit(","), F.lit(""))
    first = F.regexp_extract(text, r"(\d+)", 1).try_cast("bigint")
    value = (F.when(F.contains(text, F.lit(TEN_THOUSAND)), _scaled(text, TEN_THOUSAND, 10_000))
             .when(F.contains(text, F.lit(HUNDRED_MILLION)), _scaled(text, HUNDRED_MILLION, 100_000_000))
             .otherwise(first))
    return F.coalesce(value, F.lit(0).cast("bigint"))


def post_time(raw: Column) -> Column:
    """yy-M-d with optional H:mm, anywhere in the text, to 20yy-MM-dd HH:mm; null when there is none."""
    def stamp(text: Column) -> Column:
        def part(pattern: str, group: int) -> Column:
            return F.lpad(F.regexp_extract(text, pattern, group), 2, "0")

        def date(pattern: str) -> Column:
            return F.concat(F.lit("20"), part(pattern, 1), F.lit("-"), part(pattern, 2), F.lit("-"), part(pattern, 3))

        timed = F.concat(date(POST_DATE_TIME), F.lit(" "), part(POST_DATE_TIME, 4), F.lit(":"), part(POST_DATE_TIME, 5))
        return (F.when(text.rlike(POST_DATE_TIME), timed)
                .when(text.rlike(POST_DATE), F.concat(date(POST_DATE), F.lit(" 00:00"))))

    return bound(F.regexp_replace(raw, SPACES, " "), stamp)


def time_part(raw: Column, marker: str = PLACE_MARKER) -> Column:
    return F.trim(F.split_part(raw, F.lit(marker), F.lit(1)))


def place_part(raw: Column, marker: str = PLACE_MARKER, unknown: str = "unknown") -> Column:
    """What stands after the marker, without digits and trailing marks."""
    place = F.trim(F.split_part(raw, F.lit(marker), F.lit(2)))
    place = F.trim(F.regexp_replace(F.regexp_replace(place, r"[，。！？\s]+$", ""), r"\d+", ""))
    return F.when(F.contains(raw, F.lit(marker)) & (place != ""), place).otherwise(F.lit(unknown))


def article_key(author: Column, content: Column) -> Column:
    return F.md5(F.concat(F.coalesce(author, F.lit("")), F.lit("_"), F.coalesce(content, F.lit(""))))


def comment_key(native_id: Column, user_id: Column, content: Column) -> Column:
    """The platform's own id, else a hash of author and text."""
    made = F.md5(F.concat(F.coalesce(user_id, F.lit("")), F.lit("_"), F.coalesce(content, F.lit(""))))
    return F.coalesce(F.nullif(native_id, F.lit("")), made)


def key_sentence(text: Column, keyword: str, least: int = 10) -> Column:
    """First sentence of at least ten characters that holds the keyword, else the head of the text."""
    sentences = F.split(F.translate(text, "！？!?", "。。.."), "。")
    hits = F.filter(sentences, lambda s: F.contains(s, F.lit(keyword)) & (F.length(s) >= least))
    return F.coalesce(F.trim(F.get(hits, F.lit(0))), F.substring(text, 1, 100))


def plain_words(text: Column, keyword: str, stops: Sequence[str] = ()) -> Column:
    """Split on spaces and common marks; words of two characters or more that are neither the keyword nor among the
    stop words of the caller."""
    words = F.split(F.translate(text, WORD_BREAKS, " " * len(WORD_BREAKS)), SPACES)
    dropped = [keyword, *stops]
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(dropped))


def category(clean_title: Column, rules: Sequence[tuple[str, str]], other: str = "other") -> Column:
    """First rule (category, pattern) whose pattern is found in the cleaned title, ignoring case. The caller brings the
    rules."""
    out = None
    for name, pattern in rules:
        hit = clean_title.rlike("(?i)" + pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(other) if out is None else out.otherwise(other)
