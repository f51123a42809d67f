"""Upserted tables as append-only logs.

Each micro-batch writes one folder `source=<stream>/epoch=<n>` holding one row per key. Writing an epoch again
replaces its folder, so a replay changes nothing; the cost of a write follows the batch, not the table. Reading
merges the rows of a key: columns of the first insert keep their first value, the others take the last one.

Files of articles and comments are sorted by key, carry a Bloom filter of it, and have small pages with an index, so the
rows of a batch's keys are found by a filter on the key: files without such a key are left out after a look at their filter,
and of the others only the pages that may hold one are read. Titles that have an event are a log of their own, one row for
each at the time it was new, in folders by hash; a batch opens the folders of its own titles.

`compact` puts all epochs of a log into one, in place. It first notes which epochs it replaces and then writes the new
one; from the moment that is complete, readers leave the replaced ones out, whether or not their folders are gone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur import schemas
from murmur.functions import marks, words
from murmur.streaming.folders import shuffles_removed

# What an upsert leaves as first inserted.
KEEP_FIRST = {
    "articles": ["event_id", "author", "content", "publish_time"],
    "comments": ["event_id", "username", "user_id", "content", "publish_time", "location"],
}
KEYS = {"articles": "article_id", "comments": "comment_id"}
TABLES = {"articles": schemas.ARTICLES, "comments": schemas.COMMENTS}
EVENT_LOG = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("heat", T.LongType()),
    T.StructField("crawl_time", T.TimestampNTZType()), T.StructField("sentiment_score", schemas.SCORE),
    T.StructField("told", T.BooleanType())])  # a message told of it; else it is a stub
SUM_LOG = T.StructType([T.StructField("id", T.LongType()), T.StructField("total", T.DecimalType(18, 3)),
                        T.StructField("n", T.LongType())])
HISTORY_MEASURES = ["n", "scored", "total", "likes", "positive", "neutral", "negative"]
HISTORY_LOG = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("hour", T.TimestampNTZType()), T.StructField("valid", T.BooleanType()),
    *[T.StructField(c, T.DecimalType(18, 3) if c == "total" else T.LongType()) for c in HISTORY_MEASURES]])
RANK_LOG = T.StructType([f if f.name != "crawl_time" else T.StructField("crawl_time", T.TimestampNTZType())
                         for f in schemas.RANK_MESSAGE.fields])
TITLE_LOG = T.StructType([T.StructField("title", T.StringType())])
SLOTS = 64  # folders of new titles, by hash
FEW_KEYS = 5000  # keys of a batch that become a filter of the scan; more are joined
PAGE_ROWS = 500  # rows of a page in files that are sorted by key
COMPACTED = "compacted"
AFTER = 1 << 62  # what a compacted epoch lies below all others; one number, because merges compare it for every row
_REPLACED = T.StructType([T.StructField("source", T.StringType()), T.StructField("epoch", T.LongType())])


def slot(title: str) -> Column:
    return F.pmod(F.xxhash64(title), F.lit(SLOTS)).cast("int")


def taken(crawl_time: Column) -> Column:
    """The name of a rank snapshot, in the order of time."""
    return F.date_format(crawl_time, "yyyyMMddHHmmssSSSSSS")


def keyed(df: DataFrame, key: str) -> DataFrameWriter:
    """A writer of files in which rows can be looked up by a key. df is sorted by it within its partitions."""
    return (df.write.option(f"parquet.bloom.filter.enabled#{key}", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")  # a filter as small as its keys allow, 512 bytes or more
            .option(f"parquet.bloom.filter.candidates.number#{key}", "12")
            .option(f"parquet.bloom.filter.fpp#{key}", "1e-6")  # so that thousands of keys seldom match by chance
            .option(f"parquet.enable.dictionary#{key}", "false").option("parquet.page.row.count.limit", str(PAGE_ROWS)))


def write_epoch(df: DataFrame, folder: str, source: str, epoch: int, by: str | None = None, key: str | None = None) -> None:
    """Writes one epoch: in folders by a column, or in files that can be searched by a key."""
    writer = (keyed(df.sortWithinPartitions(key), key) if key else df.write).mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(f"{folder}/source={source}/epoch={epoch}")


class _Files:
    """The few file operations that compaction needs, through the file system of the path."""

    def __init__(self, spark: SparkSession, folder: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._system = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def there(self, path: str) -> bool:
        return self._system.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(str(s.getPath().getName()) for s in self._system.listStatus(self._path(path))) if self.there(path) else []

    def delete(self, path: str) -> None:
        self._system.delete(self._path(path), True)

    def move(self, path: str, to: str) -> None:
        """Puts a folder in the place of another, which may be there or not."""
        self._system.mkdirs(self._path(to).getParent())
        self.delete(to)
        if not self._system.rename(self._path(path), self._path(to)):
            raise OSError(f"could not move {path} to {to}")


def _folds(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete compactions of a log."""
    files = _Files(spark, folder)
    made = [int(n.split("=")[1]) for n in files.names(f"{folder}_folds") if n.startswith("fold=")]
    return [n for n in made if files.there(f"{folder}/source={COMPACTED}/epoch={n}/_SUCCESS")]


def read_log(spark: SparkSession, folder: str, schema: T.StructType, by: str | None = None) -> DataFrame:
    """All epochs that count, with source, epoch and `at`, their order; empty before the first write."""
    parts = T.StructType([T.StructField("source", T.StringType()), T.StructField("epoch", T.LongType())]
                         + ([T.StructField(by, T.IntegerType() if by == "slot" else T.StringType())] if by else []))
    full = T.StructType(schema.fields + parts.fields)
    try:
        log = spark.read.schema(full).parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        log = spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in full.fields])
    folds = _folds(spark, folder)
    if folds:
        gone = spark.read.schema(_REPLACED).parquet(*[f"{folder}_folds/fold={n}" for n in folds]).distinct()
        log = log.join(gone, ["source", "epoch"], "left_anti").select(*full.names)
    return log.withColumn("at", F.when(F.col("source") == COMPACTED, F.col("epoch") - AFTER).otherwise(F.col("epoch")))


def merged(log: DataFrame, key: str, first: Sequence[str], last: Sequence[str], order: Column) -> DataFrame:
    """One row per key. Rows of one key are combined in the map tasks before the shuffle."""
    parts = [F.min_by(F.struct(*first), order).alias("f")] if first else []
    parts.append(F.max_by(F.struct(*last), order).alias("l"))
    rows = log.groupBy(key).agg(*parts)
    return rows.select(key, *[F.col("f")[c].alias(c) for c in first], *[F.col("l")[c].alias(c) for c in last])


def gathered(rows: DataFrame, key: str) -> DataFrame:
    """The rows, each once, in the task of their key, so that a merge by key sorts them there and nowhere else. For keys
    that few rows share: combining those in the map tasks sorts all rows for little and sends what is compared twice."""
    return rows.repartition(F.col(key))


def merged_rows(log: DataFrame, key: str, first: Sequence[str], last: Sequence[str], order: Column) -> DataFrame:
    """As merged, for rows that lie in the task of their key; columns that nobody asks for are not read."""
    rows = log.groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in first], *[F.max_by(c, order).alias(c) for c in last])
    return rows.select(key, *first, *last)


def columns_of(table: str) -> tuple[str, list[str], list[str]]:
    key, first = KEYS[table], KEEP_FIRST[table]
    last = [c for c in TABLES[table].names if c != key and c not in first]
    return key, first, last


def reduced(rows: DataFrame, table: str) -> DataFrame:
    """A batch with one row per key, merged as the table is; later crawls win, then higher counts, then the greater
    row in all columns."""
    key, first, last = columns_of(table)
    lead = ["crawl_time", "like_count", "publish_time", "sentiment_score", "content"]
    order = F.struct(*lead, *[c for c in TABLES[table].names if c != key and c not in lead])  # all but the key
    # The row is put together before it is sent, so the merge compares and copies it whole, not column by column.
    whole = gathered(rows.select(key, order.alias("row")), key)
    ends = whole.groupBy(key).agg(F.min("row").alias("f"), F.max("row").alias("l"))
    return ends.select(key, *[F.col("f")[c].alias(c) for c in first], *[F.col("l")[c].alias(c) for c in last]).select(
        *TABLES[table].names)


def write_texts(rows: DataFrame, root: str, table: str, source: str, epoch: int) -> None:
    write_epoch(rows, f"{root}/{table}", source, epoch, key=KEYS[table])


def read_epoch(spark: SparkSession, folder: str, schema: T.StructType, source: str, epoch: int) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/source={source}/epoch={epoch}")


def stage_texts(rows: DataFrame, root: str, table: str, source: str, epoch: int) -> DataFrame:
    """Writes the rows of an epoch beside the table, where no reader sees them, and gives them back from there: a batch is
    stored once, and not held a second time by a cache. publish_texts puts the files in place."""
    folder = f"{root}/{table}_staged"
    write_epoch(rows, folder, source, epoch, key=KEYS[table])
    return read_epoch(rows.sparkSession, folder, TABLES[table], source, epoch)


def publish_texts(spark: SparkSession, root: str, table: str, source: str, epoch: int) -> None:
    _Files(spark, root).move(f"{root}/{table}_staged/source={source}/epoch={epoch}", f"{root}/{table}/source={source}/epoch={epoch}")


def _present(files: _Files, folder: str) -> list[tuple[str, int]]:
    """(source, epoch) of the folders of a log."""
    sources = [n.split("=")[1] for n in files.names(folder) if n.startswith("source=")]
    return [(s, int(e.split("=")[1])) for s in sources for e in files.names(f"{folder}/source={s}") if e.startswith("epoch=")]


def read_texts_log(spark: SparkSession, root: str, table: str) -> DataFrame:
    return read_log(spark, f"{root}/{table}", TABLES[table])


def has_earlier(spark: SparkSession, root: str, table: str, source: str, epoch: int) -> bool:
    """Whether a log holds an epoch that the given one of a stream follows."""
    return any(s != source or e < epoch for s, e in _present(_Files(spark, root), f"{root}/{table}"))


def earlier_rows(spark: SparkSession, root: str, table: str, rows: DataFrame, source: str, epoch: int) -> DataFrame:
    """The rows of the log that have the key of one of `rows`, of epochs that the given one of a stream follows. Up to
    FEW_KEYS keys go to the driver and into the scan, as a filter that Parquet applies to its files and pages. More are
    marked, and rows whose mark is not set are left out where they are read. A few rows of other keys may remain, and of a
    batch of more rows than can be marked all do."""
    key = KEYS[table]
    keys = rows.select(key).distinct()
    wanted = [r[0] for r in keys.limit(FEW_KEYS + 1).collect()]
    log = read_texts_log(spark, root, table).filter((F.col("source") != source) | (F.col("epoch") < epoch))
    if len(wanted) <= FEW_KEYS:
        return log.filter(F.col(key).isin(wanted))
    return log.filter(marks.is_marked(F.col(key), marks.of(keys, key))) if rows.count() <= 1 << marks.MOST else log


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    key, first, last = columns_of(table)
    log = gathered(read_texts_log(spark, root, table), key)
    return merged_rows(log, key, first, last, F.col("at")).select(*TABLES[table].names)


def _whole_texts(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table in ranges of its key. Rows meet in their range, so they move once for the merge and for the ranges."""
    key, first, last = columns_of(table)
    log = read_texts_log(spark, root, table).repartitionByRange(key)
    return merged_rows(log, key, first, last, F.col("at")).select(*TABLES[table].names)


def _as_they_are(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of a log of one compacted epoch: one for each key, in ranges of it."""
    return read_texts_log(spark, root, table).select(*TABLES[table].names)


def known_titles(spark: SparkSession, root: str, titles: DataFrame, source: str, epoch: int) -> DataFrame:
    """(hot_title, known_id) of those of the titles (hot_title) that have an event, as the given epoch of a stream finds
    them: without that epoch's own, so that a replay sees what the first run saw and does not read the folder it
    replaces. The driver gets the numbers of the titles' folders, SLOTS at most."""
    titles = titles.select("hot_title").distinct()
    slots = [r[0] for r in titles.select(slot("hot_title")).distinct().collect()]
    log = read_log(spark, f"{root}/titles", TITLE_LOG, "slot").filter(F.col("slot").isin(slots))
    before = log.filter((F.col("source") != source) | (F.col("epoch") < epoch))
    there = before.join(titles, F.col("title") == F.col("hot_title"), "left_semi").select(F.col("title").alias("hot_title"))
    return there.distinct().withColumn("known_id", F.xxhash64("hot_title"))


def write_titles(titles: DataFrame, root: str, source: str, epoch: int) -> None:
    """Adds titles (title) that are new in this epoch."""
    placed = titles.select("title").distinct().withColumn("slot", slot("title")).repartition("slot")
    write_epoch(placed, f"{root}/titles", source, epoch, "slot")


def _merged_events(spark: SparkSession, root: str) -> DataFrame:
    """title, heat, crawl_time, sentiment_score, told: a stub stands until a message tells of the event."""
    log = read_log(spark, f"{root}/events", EVENT_LOG)
    told = F.when(F.col("told"), F.col("at"))
    scored = F.when(F.col("sentiment_score").isNotNull(), told)
    return log.groupBy("title").agg(
        F.max_by("heat", told).alias("heat"),
        F.coalesce(F.max_by("crawl_time", told), F.min("crawl_time")).alias("crawl_time"),
        F.max_by("sentiment_score", scored).alias("sentiment_score"), F.bool_or("told").alias("told"))


def _merged_sums(spark: SparkSession, root: str) -> DataFrame:
    log = read_log(spark, f"{root}/event_sums", SUM_LOG)
    return log.groupBy("id").agg(F.sum("total").cast("decimal(18,3)").alias("total"), F.sum("n").alias("n"))


def read_history(spark: SparkSession, root: str) -> DataFrame:
    """What is known of the comments of every event and hour, added up from the changes that the batches left: their
    number, those with a score and its exact sum, likes, and the three bands. `valid` tells apart those with content."""
    log = read_log(spark, f"{root}/comment_history", HISTORY_LOG)
    sums = [F.sum(c).cast(HISTORY_LOG[c].dataType).alias(c) for c in HISTORY_MEASURES]
    return log.groupBy("id", "hour", "valid").agg(*sums).filter("n <> 0")


def comment_scores(spark: SparkSession, root: str) -> DataFrame:
    """(id, score): the mean comment score of every event that has comments, from the sums that the batches left."""
    mean = F.round(F.col("total").cast("double") / F.col("n").cast("double"), 3).cast(schemas.SCORE)
    return _merged_sums(spark, root).filter("n > 0").select("id", mean.alias("score"))


def read_events(spark: SparkSession, root: str, cal: words.Calibration | None = None) -> DataFrame:
    """Events by title. The score is the mean of the comments, else the last one a message carried, else that of the
    event's own title."""
    events = _merged_events(spark, root).withColumn("id", F.xxhash64("title"))
    fresh = comment_scores(spark, root).withColumnRenamed("score", "_fresh")
    titled = words.with_score(events, F.lit(0.5), "title", "_title", cal)
    return (titled.join(fresh, "id", "left")
            .select("id", "title", "crawl_time", F.coalesce("heat", F.lit(0).cast("bigint")).alias("heat"),
                    F.coalesce("_fresh", "sentiment_score", F.col("_title").cast(schemas.SCORE)).alias("sentiment_score")))


def latest_snapshot(ranks: DataFrame) -> DataFrame:
    """The rows of the newest snapshot."""
    return ranks.filter(F.col("crawl_time") == ranks.agg(F.max("crawl_time")).scalar())


def _ranks(spark: SparkSession, root: str) -> DataFrame:
    return read_log(spark, f"{root}/rank", RANK_LOG, "taken").drop("source", "epoch", "at").distinct()


def read_rank(spark: SparkSession, root: str) -> DataFrame:
    """The newest snapshot. The folders tell which that is, and only those of its time are read."""
    ranks = _ranks(spark, root)
    known = [m.group(1) for m in (re.search(r"/taken=(\d+)/", f) for f in ranks.inputFiles()) if m]
    return (ranks.filter(F.col("taken") == max(known)) if known else ranks.filter(F.lit(False))).drop("taken")


# How each log is read as one epoch.
_WHOLE: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "articles": lambda spark, root: _whole_texts(spark, root, "articles"),
    "comments": lambda spark, root: _whole_texts(spark, root, "comments"),
    "events": _merged_events,
    "event_sums": _merged_sums,
    "comment_history": read_history,
    "rank": _ranks,
    "titles": lambda spark, root: (read_log(spark, f"{root}/titles", TITLE_LOG, "slot").select("title", "slot")
                                   .distinct().repartition("slot")),
}
_BY = {"titles": "slot", "rank": "taken"}


def compact(spark: SparkSession, root: str, table: str) -> None:
    """Puts the epochs of one log into one, in place, and removes what that replaces. Run it while the log's stream is
    between two batches. An epoch that is replayed afterwards stays replaced: the new one holds its rows."""
    if table == "comments":  # first the sums: a replayed epoch finds no change to make once its comments are folded
        compact(spark, root, "event_sums")
        compact(spark, root, "comment_history")
    folder, files = f"{root}/{table}", _Files(spark, root)
    present = _present(files, folder)
    if not present:
        return
    number = max([0, *_folds(spark, folder)]) + 1
    spark.createDataFrame(present, _REPLACED).coalesce(1).write.mode("overwrite").parquet(f"{folder}_folds/fold={number}")
    done = table in KEYS and [source for source, _ in present] == [COMPACTED]  # else its rows have to meet
    whole = _as_they_are(spark, root, table) if done else _WHOLE[table](spark, root)
    with shuffles_removed(spark):
        write_epoch(whole, folder, COMPACTED, number, _BY.get(table), KEYS.get(table))
    for source, epoch in present:
        files.delete(f"{folder}/source={source}/epoch={epoch}")
    if table == "events":  # then the titles: a replayed epoch makes no stub for a title once it is folded
        compact(spark, root, "titles")
