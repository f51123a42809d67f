"""Connected components of links, by joins and groupings alone.

Every round lets each node pass its least neighbour to its larger neighbours, then to its smaller ones, so links turn
into stars around the least node of a component; the number of rounds grows with the logarithm of its size. Minima
are combined before the shuffle, and Spark splits the join on a node with very many links. A round is written to
the shared folder, which cuts the lineage, and the round before the last is deleted.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.store import new_folder, remove, written


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _outward(links: DataFrame) -> DataFrame:
    """Links (u > v) to the larger neighbours of every node."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return (both.join(least, F.col("u") == F.col("k")).filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct())


def _inward(links: DataFrame) -> DataFrame:
    """Links (u > v) among the smaller neighbours of every node."""
    least = _least(links)
    moved = (links.join(least.select(F.col("u").alias("k"), "m"), F.col("u") == F.col("k"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """From links (a long, b long) in any order, repeated or not: one row (node, root) for each node that has a link to
    another, root being the least node of its component. The driver sees three numbers a round."""
    spark = links.sparkSession
    folders = [new_folder(spark, "links")]
    state = written(links.filter(F.col("a") != F.col("b"))
                    .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "", folders[0])

    def mark(df):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("u", "v"))).first()

    before = mark(state)
    while before[0]:
        folders.append(new_folder(spark, "links"))
        state = written(_inward(_outward(state)), "", folders[-1])
        for old in folders[:-1]:
            remove(spark, old)
        del folders[:-1]
        after = mark(state)
        if after == before:
            break
        before = after
    stars = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def joined_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels of nodes 0, 1, ... of one block after the links i-j are added: equal for linked nodes, the least place of
    each group. Start with arange."""
    while True:
        a, b = labels[i], labels[j]
        open_ = a != b
        if not open_.any():
            return labels
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        low = np.minimum(a, b)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while True:
            further = labels[labels]
            if np.array_equal(further, labels):
                break
            labels = further
