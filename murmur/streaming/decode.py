"""From message text to clean rows. Works on batch and streaming DataFrames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur import schemas

TIMES = ("publish_time", "crawl_time")


def decode(messages: DataFrame, kind: str, value: str = "value") -> DataFrame:
    """Envelope text to one row per element. `data` may be a list or one object; anything else gives no row.

    An envelope whose elements all fit the schema is parsed once. In others each element is parsed by itself, so that a
    bad one does not spoil its neighbours."""
    body = F.col(value).cast("string")
    message = schemas.MESSAGES[kind]
    # The mode is the usual one; from_json with an option is not split by the optimizer into a parse for each field.
    whole = F.from_json(body, schemas.whole_envelope(message), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": schemas.CORRUPT})
    many = F.from_json(body, schemas.ENVELOPE)["data"]
    one = F.from_json(body, schemas.ENVELOPE_ONE)["data"]
    items = F.coalesce(many, F.when(F.ltrim(one).startswith("{"), F.array(one)))
    each = F.transform(items, lambda item: F.from_json(item, message))
    # Generators, not projections: what they give is then not parsed again for every field or filter that uses it.
    rows = messages.select(F.col(value), F.explode(F.array(whole)).alias("whole"))
    fits = F.col("whole")[schemas.CORRUPT].isNull() & F.col("whole")["data"].isNotNull()
    return rows.select(F.inline(F.when(fits, F.col("whole")["data"]).otherwise(each)))


def clean(rows: DataFrame, kind: str) -> DataFrame:
    """Times parsed, rows without required fields dropped, the rest filled. Extra ranking fields are dropped."""
    out = rows
    for c in TIMES:
        if c in out.columns:
            out = out.withColumn(c, F.col(c).try_cast("timestamp_ntz"))
    for c in schemas.REQUIRED[kind]:
        out = out.filter(F.col(c).isNotNull())
    out = out.fillna(schemas.FILLS[kind])
    if "sentiment_score" in out.columns:
        out = out.withColumn("sentiment_score", F.col("sentiment_score").cast(schemas.SCORE))
    return out.drop("hot_rank")


def distinct_stream(rows: DataFrame, key: str, time: str = "publish_time", delay: str = "10 minutes") -> DataFrame:
    """Valid rows, one per id as long as repeats arrive within the delay."""
    stamped = rows.filter(F.col("content").isNotNull() & (F.col("content") != ""))
    return (stamped.withColumn(time, F.col(time).cast("timestamp"))
            .withWatermark(time, delay).dropDuplicatesWithinWatermark([key]))
