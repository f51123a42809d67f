"""Batch and stream sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kafka_stream(spark: SparkSession, servers: str, topic: str, starting: str = "latest",
                 max_offsets: int | None = None, **options) -> DataFrame:
    """One topic as a stream of text. Missing offsets are tolerated; `max_offsets` caps a micro-batch.
    Needs the Kafka connector on the class path."""
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("subscribe", topic).option("startingOffsets", starting).option("failOnDataLoss", "false"))
    if max_offsets is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.options(**options).load().select(F.col("value").cast("string").alias("value"))


def file_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """One message per line of every file that appears in a folder; `max_files` caps a micro-batch."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def jdbc_table(spark: SparkSession, url: str, table: str, split_by: str | None = None, low: int = 0, high: int = 0,
               parts: int = 1, **options) -> DataFrame:
    """A table of a relational store; `split_by` reads it in parallel ranges of a numeric column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if split_by is not None:
        reader = (reader.option("partitionColumn", split_by).option("lowerBound", low).option("upperBound", high)
                  .option("numPartitions", parts))
    return reader.load()


def event_titles(events: DataFrame) -> DataFrame:
    """The event dimension as needed to resolve titles: one id per title."""
    return events.groupBy(F.col("title").alias("hot_title")).agg(F.min("id").alias("known_id"))


def word_file(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """One word per line, trimmed, blanks dropped; appended to `known` (word) when given."""
    words = spark.read.text(path).select(F.trim("value").alias("word")).filter(F.col("word") != "")
    if known is not None:
        words = known.select("word").unionByName(words)
    return words.distinct()


def extended_lexicon(lexicon: DataFrame, positive=(), negative=()) -> DataFrame:
    """A lexicon table (word, kind) with more words."""
    spark = lexicon.sparkSession
    more = spark.createDataFrame([(w, "pos") for w in positive] + [(w, "neg") for w in negative],
                                 T.StructType([T.StructField("word", T.StringType()), T.StructField("kind", T.StringType())]))
    return lexicon.select("word", "kind").unionByName(more).distinct()
