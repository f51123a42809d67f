"""The three upsert streams: events, articles, comments.

Titles are resolved against the events. Where those are kept in this store, an event's id is a hash of its title, so a
replay gives the same id and no join is made. Where they are kept in another store, `known` gives its events (id,
title) to every batch: a message's own id counts if that store has it, else the title decides. Unseen titles get a
stub event.

Scores and histories follow the batch. Beside its rows a batch of comments leaves the change of score sum and count for
every event it touches, and of the counts, sums and bands of every hour (streaming.histories reads them); a comment that comes again takes off what it had added before. For that a batch looks up the earlier rows of
its own comments by their keys (tables.earlier_rows), and of the known titles only those that it names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from murmur.functions import bands, numbers, scalars
from murmur.schemas import SCORE
from murmur.sources.readers import event_titles
from murmur.streaming import decode, tables
from murmur.streaming.folders import remove, shuffles_removed
from murmur.streaming.tables import latest_snapshot, read_rank  # noqa: F401

TRIGGER = "5 seconds"
SPREAD = 1024  # rows without an own id are dealt out by as many values
Known = Callable[[SparkSession], DataFrame]


def titles_of(rows: DataFrame) -> DataFrame:
    return rows.select("hot_title").distinct()


def unseen_titles(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Titles of the rows that no event has; `known` is (hot_title, known_id)."""
    return titles_of(rows).join(known, "hot_title", "left_anti")


def stub_events(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Events to add for unseen titles: no heat, no score yet, crawled when the title was first met."""
    first = rows.groupBy("hot_title").agg(F.min("crawl_time").alias("crawl_time"))
    new = first.join(known, "hot_title", "left_anti")
    return new.select(F.col("hot_title").alias("title"), F.lit(0).cast("bigint").alias("heat"), "crawl_time",
                      F.lit(None).cast(SCORE).alias("sentiment_score"))


def own_key(own: Column, columns: list[str]) -> Column:
    """What rows with their own id meet events by; the others have SPREAD keys that no event has."""
    place = F.when(own.isNull(), F.pmod(F.xxhash64(*columns), F.lit(SPREAD))).otherwise(F.lit(0).cast("bigint"))
    return F.struct(own.alias("id"), place.alias("place"))


def titles_there(rows: DataFrame, events: DataFrame) -> DataFrame:
    """(hot_title, known_id): the least id that another store has for each title of the rows."""
    return event_titles(events).join(titles_of(rows), "hot_title", "left_semi")


def resolved(rows: DataFrame, events: DataFrame | None = None, titles: DataFrame | None = None) -> DataFrame:
    """Sets event_id. With the events (id, title) of another store: the message's own id if that store has it, else
    the least id of the title there, else the id the title's stub gets. Without: the id that the title has here. Rows
    without an own id meet no event and are dealt out by a hash of themselves, else one task would get them all. `titles`
    is titles_there, where the caller has it."""
    made = F.xxhash64("hot_title")
    if events is None:
        return rows.withColumn("event_id", made)
    titles = titles_there(rows, events) if titles is None else titles
    if "event_id" not in rows.columns:  # no row has an own id, so none has to meet the events by it
        return rows.join(titles, "hot_title", "left").withColumn("event_id", F.coalesce("known_id", made)).drop("known_id")
    own = F.col("event_id")
    rows = rows.withColumn("_own", own).withColumn("_key", own_key(own, rows.columns))
    ids = events.select(F.col("id").alias("_id")).distinct()
    there = (ids.join(rows.select(F.col("_own").alias("_id")).distinct(), "_id", "left_semi")
             .withColumn("_place", F.struct(F.col("_id").alias("id"), F.lit(0).cast("bigint").alias("place"))))
    return (rows.join(there, F.col("_key") == F.col("_place"), "left").join(titles, "hot_title", "left")
            .withColumn("event_id", F.coalesce("_id", "known_id", made))
            .drop("_own", "_key", "_place", "_id", "known_id"))


def placed(batch: DataFrame, events: DataFrame, titles: DataFrame) -> DataFrame:
    """A stored batch, resolved. Only rows with an own id are sent to meet the events of another store by it."""
    if "event_id" not in batch.columns:
        return resolved(batch, events, titles)
    owned = resolved(batch.filter(F.col("event_id").isNotNull()), events, titles)
    return owned.unionByName(resolved(batch.filter(F.col("event_id").isNull()).drop("event_id"), events, titles))


def steps(spark: SparkSession, root: str, rows: DataFrame, epoch: int) -> DataFrame:
    """What each comment of a batch, one row each, changes: id, hour and valid of the event, hour and kind of content it
    was first placed in, and a signed step for each measure of the history. Rows of this epoch or a later one are not
    looked at, so a replay gives the same steps."""
    placed, counted = ["event_id", "hour", "valid"], ["sentiment_score", "like_count"]
    new = _narrow(rows).select("comment_id", F.struct(*placed, *counted).alias("new"))
    if tables.has_earlier(spark, root, "comments", "comment", epoch):
        log = _narrow(tables.earlier_rows(spark, root, "comments", rows, "comment", epoch), "at")
        old = tables.merged(tables.gathered(log, "comment_id"), "comment_id", placed, counted, F.col("at"))
        both = new.join(old.select("comment_id", F.struct(*placed, *counted).alias("old")), "comment_id", "left")
    else:  # nothing is moved to look for rows that cannot be there
        both = new.withColumn("old", F.lit(None).cast(new.schema["new"].dataType))
    place = F.coalesce("old", "new")
    after, before = _measures(F.col("new")), _measures(F.col("old"))
    return both.select(place["event_id"].alias("id"), place["hour"].alias("hour"), place["valid"].alias("valid"),
                       *[(after[c] - before[c]).alias(c) for c in tables.HISTORY_MEASURES])


def _narrow(comments: DataFrame, *more: str) -> DataFrame:
    """What a history takes from a comment: of its content only whether it is valid, of its time the hour."""
    return comments.select(
        "comment_id", "event_id", F.date_trunc("hour", "publish_time").cast("timestamp_ntz").alias("hour"),
        F.coalesce(scalars.valid_content(F.col("content")), F.lit(False)).alias("valid"), "sentiment_score", "like_count", *more)


def _measures(comment: Column) -> dict[str, Column]:
    """What one comment, a struct that may be null, adds to each measure."""
    score = comment["sentiment_score"]
    bits = {"n": comment.isNotNull(), "scored": score.isNotNull(), "positive": bands.is_positive(score),
            "neutral": bands.is_neutral(score), "negative": bands.is_negative(score)}
    found = {c: F.coalesce(bit, F.lit(False)).cast("bigint") for c, bit in bits.items()}
    found["total"] = F.coalesce(numbers.wide_score(score), F.lit(0).cast("decimal(8,3)"))
    found["likes"] = F.coalesce(comment["like_count"], F.lit(0)).cast("bigint")
    return found


def changes(steps: DataFrame) -> DataFrame:
    """(id, total, n): the change of score sum and count for every event of a batch, from its steps or from their sums
    by hour."""
    return steps.groupBy("id").agg(F.sum("total").cast("decimal(18,3)").alias("total"), F.sum("scored").alias("n"))


def history_changes(steps: DataFrame) -> DataFrame:
    """The change of the history for every event, hour and kind of content of a batch; what changes nothing is left out."""
    sums = [F.sum(c).cast(tables.HISTORY_LOG[c].dataType).alias(c) for c in tables.HISTORY_MEASURES]
    return (steps.groupBy("id", "hour", "valid").agg(*sums)
            .filter(F.greatest(*[F.abs(c) for c in tables.HISTORY_MEASURES]) > 0))


def save_events(batch: DataFrame, epoch: int, root: str) -> None:
    order = F.struct("crawl_time", "heat", "sentiment_score")
    last = tables.merged(batch, "title", [], ["heat", "crawl_time", "sentiment_score"], order).persist()
    try:
        known = tables.known_titles(batch.sparkSession, root, last.select(F.col("title").alias("hot_title")), "event", epoch)
        tables.write_epoch(last.withColumn("told", F.lit(True)), f"{root}/events", "event", epoch)
        tables.write_titles(last.join(known, F.col("title") == F.col("hot_title"), "left_anti"), root, "event", epoch)
    finally:
        last.unpersist()


def save_texts(batch: DataFrame, epoch: int, root: str, kind: str, known: Known | None = None) -> None:
    """One batch of articles or comments: reduce, resolve, add stubs, upsert, change the score sums. The reduced rows are
    stored beside their table, read from there, and put in place last."""
    spark, table = batch.sparkSession, f"{kind}s"
    events = known(spark) if known else None
    with shuffles_removed(spark):
        if events is None:  # the batch is read once, into rows
            rows = tables.stage_texts(tables.reduced(resolved(batch), table), root, table, kind, epoch)
        else:
            told = f"{root}/{table}_told/source={kind}/epoch={epoch}"
            batch.write.mode("overwrite").option("compression", "zstd").parquet(told)
            batch = spark.read.schema(batch.schema).parquet(told)
            there = titles_there(batch, events).persist()
            there.count()  # so that the planner knows its size before it decides whether rows have to be sent to it
            rows = tables.stage_texts(tables.reduced(placed(batch, events, there), table), root, table, kind, epoch)
            there.unpersist()
            remove(spark, told)
        named = rows.filter(F.col("event_id") == F.xxhash64("hot_title"))  # those no other store has placed
        met = named.groupBy("hot_title").agg(F.min("crawl_time").alias("crawl_time")).persist()  # one pass over the rows
        titles = tables.known_titles(spark, root, met, kind, epoch) if events is None else event_titles(events)
        stubs = stub_events(met, titles).withColumn("told", F.lit(False)).persist()
        tables.write_epoch(stubs, f"{root}/events", kind, epoch)
        tables.write_titles(stubs, root, kind, epoch)
        stubs.unpersist()
        met.unpersist()
        if kind == "comment":
            history = f"{root}/comment_history"
            tables.write_epoch(history_changes(steps(spark, root, rows, epoch)), history, kind, epoch)
            tables.write_epoch(changes(tables.read_epoch(spark, history, tables.HISTORY_LOG, kind, epoch)), f"{root}/event_sums", kind, epoch)
        tables.publish_texts(spark, root, table, kind, epoch)


def quality_stream(rows: DataFrame, name: str) -> DataFrame:
    """Counts rows and missing times of every batch while it passes; read them from the query's progress."""
    counted = [F.count(F.lit(1)).alias("rows")]
    counted += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in decode.TIMES if c in rows.columns]
    return rows.observe(name, *counted)


def start(messages: DataFrame, kind: str, root: str, checkpoint: str, available_now: bool = False,
          trigger: str = TRIGGER, known: Known | None = None) -> StreamingQuery:
    """Starts the stream of one kind: event, article or comment. `known` reads the events of another store, anew for
    every batch."""
    rows = decode.clean(quality_stream(decode.decode(messages, kind), f"{kind}_quality"), kind)

    def save(batch: DataFrame, epoch: int) -> None:
        if kind == "event":
            save_events(batch, epoch, root)
        else:
            save_texts(batch, epoch, root, kind, known)

    writer = (rows.writeStream.queryName(f"{kind}_{uuid.uuid4().hex}").outputMode("append")
              .option("checkpointLocation", f"{checkpoint}/{kind}").foreachBatch(save))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    return writer.start()


def run(spark: SparkSession, sources: dict[str, DataFrame], root: str, checkpoint: str,
        available_now: bool = False, **options) -> None:
    """Starts one query per kind and waits; when one ends or fails, or on interrupt, the others are stopped."""
    spark.streams.resetTerminated()
    queries = [start(df, kind, root, checkpoint, available_now, **options) for kind, df in sources.items()]
    try:
        if available_now:
            for q in queries:
                q.awaitTermination()
        else:
            spark.streams.awaitAnyTermination()
    finally:
        for q in queries:
            if q.isActive:
                q.stop()


def save_rank(batch: DataFrame, epoch: int, root: str) -> None:
    named = batch.withColumn("taken", tables.taken(F.col("crawl_time")))
    tables.write_epoch(named, f"{root}/rank", "rank", epoch, "taken")


def start_rank(messages: DataFrame, root: str, checkpoint: str, available_now: bool = False,
               trigger: str = TRIGGER) -> StreamingQuery:
    """The hot-rank topic: every snapshot is kept, the latest one is the table."""
    rows = decode.clean(decode.decode(messages, "rank"), "rank")
    writer = (rows.writeStream.option("checkpointLocation", f"{checkpoint}/rank")
              .foreachBatch(lambda batch, epoch: save_rank(batch, epoch, root)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    return writer.start()
