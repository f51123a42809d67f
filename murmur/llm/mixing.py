"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Sources get words in proportion to their weights. A source stops at `max_epochs` times its own size; what it cannot
take is shared by the others in proportion to their weights, until none is above its limit. Sorted by limit over
weight, the sources at their limit come first, so the level of the water is found by running sums over one row per
source, without a loop.

A source's target is so many whole repetitions of all its documents and a rest. For the rest its documents are put in
the order of a seeded hash and taken from the front until the rest is reached; the document at the edge gives its
first words. The order is never sorted as a whole: documents fall into `BUCKETS` ranges of the hash, sums by source
and range tell in which range the edge lies, and only the documents of that range are sorted.

Defined results: a null text has size 0 and is taken with 0 words; null sources are one source, the last; rows with
equal source, doc_id and size share what the edge gives them evenly, rounded down; an empty table gives no rows;
columns of the input that bear the name of a result column are replaced by it, all others are passed on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.store import written
from murmur.llm.words import n_words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "murmur"
DIGITS = 3  # hexadecimal digits of the hash that name a range
BUCKETS = 16 ** DIGITS
RESULT = ("size", "source_size", "target", "taken")
_HASH, _BUCKET, _EDGE, _WHOLE, _SOURCE = "_mix_hash", "_mix_bucket", "_mix_edge", "_mix_whole", "_mix_source"


def _hash(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _hashed(docs: DataFrame, seed: str) -> DataFrame:
    kept = docs.drop(*RESULT)
    return (kept.withColumn(_HASH, _hash(seed))
            .withColumn(_BUCKET, F.conv(F.substring(_HASH, 1, DIGITS), 16, 10).cast("int")))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
            max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """From one row per source (source, source_size): the same with its target in words, a double. The weights go
    round the sources in the order of their code points, nulls last."""
    if not weights or min(weights) <= 0 or share < 0 or max_epochs < 0:
        raise ValueError("weights must be positive, share and max_epochs not negative")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_level = Window.orderBy("level", "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    rows = (sizes.withColumn("place", F.row_number().over(by_name))
            .withColumn("weight", F.element_at(turn, F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1))
            .withColumn("limit", F.col("source_size") * F.lit(float(max_epochs)))
            .withColumn("level", F.col("limit") / F.col("weight"))
            .withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
            .withColumn("water", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
                        / F.sum("weight").over(onward))
            .withColumn("free", F.col("limit") > F.col("water") * F.col("weight"))
            .withColumn("surface", F.min(F.when(F.col("free"), F.struct("level", "place", "water"))).over(every)))
    target = F.when(F.col("surface").isNull(), F.col("limit")).otherwise(
        F.least("limit", F.col("surface.water") * F.col("weight")))
    return rows.select("source", "source_size", target.alias("target"))


def _plan(hashed: DataFrame, weights, share, max_epochs) -> DataFrame:
    """One row per source: target, whole repetitions, the rest, the range in which the edge lies and what comes
    before it."""
    sums = written(hashed.groupBy("source", _BUCKET).agg(F.sum(n_words(F.col("text"))).alias("words")), "mix-sums")
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    goals = (targets(sizes, weights, share, max_epochs).withColumn(_WHOLE, whole)
             .withColumn("rest", goal - F.col(_WHOLE) * F.col("source_size")))
    running = Window.partitionBy("source").orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = (sums.withColumn("until", F.sum("words").over(running))
             .join(goals.select(F.col("source").alias(_SOURCE), "rest"), F.col("source").eqNullSafe(F.col(_SOURCE)))
             .filter(F.col("until") > F.col("rest"))
             .groupBy("source").agg(F.min(F.struct(_BUCKET, (F.col("until") - F.col("words")).alias("before")))
                                    .alias("edge"))
             .select(F.col("source").alias("_name"), "edge"))
    plan = (goals.join(edges, F.col("source").eqNullSafe(F.col("_name")), "left")
            .select(F.col("source").alias(_SOURCE), "source_size", "target", _WHOLE, "rest",
                    F.coalesce(F.col(f"edge.{_BUCKET}"), F.lit(BUCKETS)).alias(_EDGE),
                    F.coalesce(F.col("edge.before"), F.lit(0).cast("long")).alias("before")))
    return written(plan, "mix-plan")


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS,
          seed: str = SEED) -> DataFrame:
    """Every document (doc_id, source, text, ...) with its size in words, the size and the target of its source, and
    the words the mix takes of it, repetitions counted. Neither texts nor sizes are shuffled: the plan has one row
    per source, and Spark joins it by its size."""
    hashed = _hashed(docs, seed)
    plan = _plan(hashed, weights, share, max_epochs)
    joined = hashed.join(plan, hashed["source"].eqNullSafe(plan[_SOURCE]))
    size = n_words(F.col("text"))
    kept = [c for c in hashed.columns if c not in (_HASH, _BUCKET)]
    common = [*kept, "size", "source_size", "target"]

    clear = (joined.filter(F.col(_BUCKET) != F.col(_EDGE)).withColumn("size", size)
             .withColumn("taken", F.col("size") * (F.col(_WHOLE) + (F.col(_BUCKET) < F.col(_EDGE)).cast("long"))))

    # The documents of the ranges at the edge: running sums over groups of rows that nothing tells apart.
    near = joined.filter(F.col(_BUCKET) == F.col(_EDGE)).withColumn("size", size)
    keys = ["source", _HASH, "size"]
    upto = Window.partitionBy("source").orderBy(_HASH, "size").rowsBetween(Window.unboundedPreceding, -1)
    gives = (near.groupBy(*keys, "rest", "before").agg(F.count(F.lit(1)).alias("copies"))
             .withColumn("start", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(upto),
                                                               F.lit(0)))
             .select(*[F.col(c).alias(f"_g_{c}") for c in keys],
                     F.floor(F.least(F.greatest(F.col("rest") - F.col("start"), F.lit(0)),
                                     F.col("size") * F.col("copies")) / F.col("copies")).alias("extra")))
    same = [near[c].eqNullSafe(gives[f"_g_{c}"]) for c in keys]
    edge = (near.join(gives, same[0] & same[1] & same[2])
            .withColumn("taken", F.col("size") * F.col(_WHOLE) + F.col("extra")))
    return clear.select(*common, "taken").unionByName(edge.select(*common, "taken"))


def repeated(mix: DataFrame) -> DataFrame:
    """The texts of the mix: a row for each whole repetition, and one with the first words for a fractional one. A
    document of which nothing is taken has no row. Takes mixed(), returns its columns without the four results."""
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    # A cut in front of each gap that follows a word: every part but the first is a gap and a word.
    parts = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    first = F.array_join(F.slice(parts, 1, rest), "")
    texts = F.concat(F.array_repeat(F.col("text"), whole), F.when(rest > 0, F.array(first)).otherwise(F.array().cast("array<string>")))
    kept = [c for c in mix.columns if c not in RESULT]
    return (mix.withColumn("_text", F.explode(texts)).drop("text").withColumnRenamed("_text", "text")
            .select(*kept))


def repetitions(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs (doc_id, source, text, ...) as often as the mix takes them, with their columns and no others,
    whatever their names; a fractional repetition holds the first words."""
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"))
    taken = repeated(mixed(packed, **options))
    return taken.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
