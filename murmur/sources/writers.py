"""Exports, validated appends and publishing."""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import scalars, times, words
from murmur.schemas import SCORE

# Columns and their order in the exported files.
EXPORT_COLUMNS = {
    "events": ["id", "title", "crawl_time", "heat", "sentiment_score", "url", "created_at"],
    "articles": ["id", "event_id", "article_id", "author", "content", "publish_time", "like_count", "repost_count",
                 "comment_count", "crawl_time", "hot_title", "sentiment_score", "sentiment_type"],
    "comments": ["id", "event_id", "comment_id", "username", "user_id", "content", "publish_time", "location",
                 "like_count", "crawl_time", "hot_title", "sentiment_score", "sentiment_type"],
}
KEYS = {"events": "id", "articles": "article_id", "comments": "comment_id"}


def export(df: DataFrame, kind: str, start, end, time: str = "crawl_time") -> DataFrame:
    """Rows of a date range, both days included, newest first, in the column order of the kind."""
    columns = [c for c in EXPORT_COLUMNS[kind] if c in df.columns]
    rows = df.filter(times.between_days(F.col(time), start, end))
    return rows.select(*columns).orderBy(F.col(time).desc(), F.col(KEYS[kind]).asc())


def export_preview(tables: dict[str, DataFrame], start, end, time: str = "crawl_time") -> DataFrame:
    """(kind, n) for every table of the range, and their total."""
    counts = None
    for kind, df in tables.items():
        stamp = time if time in df.columns else "publish_time"
        one = (df.filter(times.between_days(F.col(stamp), start, end))
               .agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n"))
        counts = one if counts is None else counts.unionByName(one)
    return counts.unionByName(counts.agg(F.sum("n").alias("n")).select(F.lit("total").alias("kind"), "n"))


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)


def export_all(tables: dict[str, DataFrame], start, end, folder: str, time: str = "crawl_time") -> list[str]:
    """One CSV folder per kind that has rows in the range; an error when none has."""
    written = []
    for kind, df in tables.items():
        stamp = time if time in df.columns else "publish_time"
        rows = export(df, kind, start, end, stamp)
        if not rows.isEmpty():
            write_csv(rows, f"{folder}/{kind}")
            written.append(kind)
    if not written:
        raise ValueError("nothing to export in this range")
    return written


def raw_backup(df: DataFrame, folder: str) -> None:
    """Crawled rows as CSV, one folder per rank of their topic."""
    df.write.mode("append").option("header", True).partitionBy("hot_rank").csv(folder)


def valid_events(raw: DataFrame, as_of) -> DataFrame:
    """Events ready to append: titles trimmed and present, heat not negative, score in 0..1, time defaulted."""
    rows = raw.filter(F.trim("title") != "")
    return rows.select(
        F.xxhash64(F.trim("title")).alias("id"), F.trim("title").alias("title"),
        F.coalesce(scalars.parse_datetime(F.col("crawl_time"), date_only=True), times.moment(as_of)).alias("crawl_time"),
        scalars.valid_heat(F.col("heat")).alias("heat"),
        scalars.valid_score(F.col("sentiment_score")).cast(SCORE).alias("sentiment_score"))


def valid_texts(raw: DataFrame, base: Column, key: str = "comment_id", cal: words.Calibration | None = None) -> DataFrame:
    """Comments or articles ready to append: key present, times parsed, counts not negative, text scored
    (0.5 when blank)."""
    rows = raw.filter(F.col(key).isNotNull())
    scored = words.with_score(rows, base, "content", "_score", cal)
    out = scored.withColumn("sentiment_score", F.col("_score").cast(SCORE)).drop("_score")
    for c in ("publish_time", "crawl_time"):
        if c in out.columns:
            out = out.withColumn(c, scalars.parse_datetime(F.col(c).cast("string")))
    for c in ("like_count", "repost_count", "comment_count"):
        if c in out.columns:
            out = out.withColumn(c, F.greatest(F.coalesce(F.col(c).try_cast("int"), F.lit(0)), F.lit(0)))
    return out


def append(df: DataFrame, folder: str) -> None:
    df.write.mode("append").parquet(folder)


def to_jdbc(df: DataFrame, url: str, table: str, **options) -> None:
    """Appends to a staging table of a relational store; the store merges it by its unique key."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode("append").save()


def envelopes(df: DataFrame, send_time: str, size: int = 100) -> DataFrame:
    """Rows as envelopes of at most `size` objects, one text value each, those of a partition in its order. They are put
    together where the rows are, so no row moves."""
    items = df.select(F.to_json(F.struct(*df.columns)).alias("item"))
    head = f'{{"send_time": {json.dumps(send_time)}, "data": ['

    def joined(found):
        """Envelopes of an array of objects, the last one with what is left."""
        ends = pa.array([*range(0, len(found), size), len(found)], pa.int32())
        bodies = pc.binary_join(pa.ListArray.from_arrays(ends, found), ",")
        values = pc.binary_join_element_wise(head, bodies, "]}", "")
        return pa.RecordBatch.from_arrays([values.cast(pa.string())], ["value"])

    def packed(batches):
        held: list[str] = []
        for batch in batches:
            found = batch.column(0)
            found = found.filter(pc.not_equal(found, "{}"))  # here: a filter in the plan would write every object twice
            if held:
                missing = size - len(held)
                held += found[:missing].to_pylist()
                found = found[missing:]
                if len(held) < size:
                    continue
                yield joined(pa.array(held, pa.string()))
            whole = len(found) - len(found) % size
            if whole:
                yield joined(found[:whole])
            held = found[whole:].to_pylist()
        if held:
            yield joined(pa.array(held, pa.string()))

    return items.mapInArrow(packed, "value string")


def keyed_messages(df: DataFrame, key: str, send_time: str) -> DataFrame:
    """One envelope per row, keyed for the topic."""
    body = F.concat(F.lit(f'{{"send_time": {json.dumps(send_time)}, "data": ['),
                    F.to_json(F.struct(*df.columns)), F.lit("]}"))
    return df.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), body.alias("value"))


def publish_files(messages: DataFrame, folder: str, compression: str = "lz4", per_file: int = 500) -> None:
    """One message a line. Messages repeat their field names, so the files are packed; a packed file is read by one task,
    so it holds `per_file` messages at most."""
    (messages.select("value").write.mode("append").option("compression", compression)
     .option("maxRecordsPerFile", per_file).text(folder))


def publish_kafka(messages: DataFrame, servers: str, topic: str) -> None:
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
