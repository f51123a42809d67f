"""Isolation forest (Liu, Ting, Zhou 2008) fitted and applied by Spark.

Rows are drawn by hash, so a fit is repeatable and independent of partitioning. Each tree sees a fixed number
of rows and is grown in its own task; the finished forest has at most trees x (2 x sample) nodes whatever the
table holds, and only that goes through the driver. Scoring is one pass over the rows in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmur.operators import scoring
from murmur.streaming.folders import stored

# Size of the forest and share of rows taken as anomalous.
TREES = 100
SAMPLE = 256
CONTAMINATION = 0.05
SEED = 42
FEWEST_ROWS = 10
SCORE_DIGITS = 6

NODE_SCHEMA = "tree int, node int, feature int, split double, left int, right int, path double"


@dataclass(frozen=True)
class Forest:
    columns: tuple[str, ...]
    feature: np.ndarray  # trees x nodes, -1 at a leaf
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray     # path length that ends at a leaf
    scale: float         # mean path length of the sample size
    cutoff: float = 0.0

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Minus 2 to the power of -(mean path / scale); the lower, the more isolated."""
        trees = np.arange(self.feature.shape[0])
        at = np.zeros((len(rows), len(trees)), dtype=np.int64)
        pick = np.arange(len(rows))[:, None]
        while True:
            feature = self.feature[trees, at]
            inner = feature >= 0
            if not inner.any():
                break
            value = rows[pick, np.where(inner, feature, 0)]
            follow = np.where(value < self.split[trees, at], self.left[trees, at], self.right[trees, at])
            at = np.where(inner, follow, at)
        return -np.power(2.0, -self.path[trees, at].mean(axis=1) / self.scale)


def mean_path(n: float) -> float:
    """Average path length of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def grow(rows: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes (node, feature, split, left, right, path) of one tree."""
    nodes: list[tuple] = []
    todo = [(0, np.arange(len(rows)), 0)]
    used = 1
    while todo:
        node, members, depth = todo.pop()
        part = rows[members]
        low, high = part.min(axis=0), part.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= limit or len(members) <= 1 or len(varying) == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + mean_path(len(members))))
            continue
        feature = int(rng.choice(varying))
        split = float(rng.uniform(low[feature], high[feature]))
        if split <= low[feature]:
            split = float(np.nextafter(low[feature], high[feature]))
        goes_left = part[:, feature] < split
        nodes.append((node, feature, split, used, used + 1, 0.0))
        todo.append((used, members[goes_left], depth + 1))
        todo.append((used + 1, members[~goes_left], depth + 1))
        used += 2
    return nodes


def _uniform(*columns: Column) -> Column:
    """A number in 0..1 that depends on the values only."""
    return F.pmod(F.xxhash64(*columns), F.lit(1_000_000_007)).cast("double") / F.lit(1_000_000_007.0)


def _samples(df: DataFrame, key: str, columns: Sequence[str], n_rows: int, trees: int, sample: int,
             seed: int) -> DataFrame:
    """(tree, columns...) with `sample` rows per tree. Rows are thinned by hash before they are copied to trees,
    to a few times what is needed, so the work does not grow with the number of trees times the table."""
    pool = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns])
    share = min(1.0, 4.0 * trees * sample / n_rows)
    if share < 1.0:
        pool = pool.filter(_uniform(F.lit(seed), F.col(key)) < share)
    chance = min(1.0, 4.0 * sample / min(n_rows, 4 * trees * sample))
    numbers = F.sequence(F.lit(0), F.lit(trees - 1))
    mine = F.filter(numbers, lambda t: _uniform(F.lit(seed + 1), t, F.col(key)) < chance)
    rows = pool.withColumn("tree", F.explode(mine))
    order = Window.partitionBy("tree").orderBy(F.xxhash64(F.lit(seed + 2), "tree", key), key)
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= sample).drop("_n", key)


def fit(df: DataFrame, key: str, columns: Sequence[str], trees: int = TREES, sample: int = SAMPLE,
        contamination: float = CONTAMINATION, seed: int = SEED) -> Forest | None:
    """Grows the forest and sets the cutoff; None when there are too few rows."""
    rows = df.select(key, *columns).persist()  # read three times below
    try:
        forest, n_rows = grown(rows, key, columns, trees, sample, seed), rows.count()
        if forest is None:
            return None
        return replace(forest, cutoff=cutoff(score(rows, forest), n_rows, contamination))
    finally:
        rows.unpersist()


def grown(df: DataFrame, key: str, columns: Sequence[str], trees: int = TREES, sample: int = SAMPLE,
          seed: int = SEED, n_rows: int | None = None) -> Forest | None:
    """The forest without a cutoff; None when there are too few rows. n_rows is their number, where that is known."""
    names = list(columns)
    n_rows = df.count() if n_rows is None else n_rows
    if n_rows < FEWEST_ROWS:
        return None
    size = min(sample, n_rows)
    limit = max(1, math.ceil(math.log2(size)))

    def grow_tree(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        ordered = rows[names].sort_values(names).to_numpy(dtype=float)
        nodes = grow(ordered, limit, np.random.default_rng([seed, tree]))
        out = pd.DataFrame(nodes, columns=["node", "feature", "split", "left", "right", "path"])
        out.insert(0, "tree", tree)
        return out

    drawn = _samples(df, key, names, n_rows, trees, sample, seed)
    nodes = drawn.groupBy("tree").applyInPandas(grow_tree, NODE_SCHEMA).toPandas()  # trees x 2 x sample rows at most
    wide = int(nodes["node"].max()) + 1
    made = sorted(nodes["tree"].unique())
    place = nodes["tree"].map({t: i for i, t in enumerate(made)}).to_numpy()
    arrays = {}
    for name, empty, kind in (("feature", -1, np.int64), ("split", 0.0, float), ("left", 0, np.int64),
                              ("right", 0, np.int64), ("path", 0.0, float)):
        arrays[name] = np.full((len(made), wide), empty, dtype=kind)
        arrays[name][place, nodes["node"].to_numpy()] = nodes[name].to_numpy()
    return Forest(tuple(names), scale=mean_path(size) or 1.0, **arrays)


def score(df: DataFrame, forest: Forest) -> DataFrame:
    """Adds raw_score. The forest travels with the function once per Python worker."""
    names = list(forest.columns)

    @F.pandas_udf("double")
    def raw(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for parts in batches:
            rows = np.column_stack([p.to_numpy(dtype=float) for p in parts])
            scores = [forest.score(rows[i:i + 4096]) for i in range(0, len(rows), 4096)]
            yield pd.Series(np.round(np.concatenate(scores) if scores else np.empty(0), SCORE_DIGITS))

    return df.withColumn("raw_score", raw(*[F.col(c).cast("double") for c in names]))


COARSE = 1000  # steps of a score in the first count


def cutoff(scored: DataFrame, n_rows: int, contamination: float) -> float:
    """The score below which the given share of rows lies, interpolated between ranks. Exact: rows are counted by score
    in steps of a thousandth, then the scores of the step that holds a rank are counted as they are, a thousand rounded
    values at most. The driver gets a thousand counts each time, and no task sorts the scores."""
    place = contamination * (n_rows - 1)
    step = F.floor(F.col("raw_score") * COARSE)
    coarse = scored.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()
    fine: dict[int, list] = {}

    def at(rank: int) -> float:
        before = 0
        for s, n in sorted(coarse):
            if before + n > rank:
                break
            before += n
        if s not in fine:
            fine[s] = sorted(scored.filter(step == s).groupBy("raw_score").agg(F.count(F.lit(1)).alias("n")).collect())
        for value, n in fine[s]:
            before += n
            if before > rank:
                break
        return value

    low, high = at(math.floor(place)), at(math.ceil(place))
    return low + (high - low) * (place - math.floor(place))


def detect(events: DataFrame, comments: DataFrame, as_of=None, days: int | None = None, trees: int = TREES,
           contamination: float = CONTAMINATION, seed: int = SEED) -> DataFrame:
    """Anomalous events with score below 0, severity, reasons and signals, most isolated first. The features are
    computed once and stored, a row for each event; so are the scores."""
    features = stored(scoring.features(events, comments, as_of, days), "features")
    z = [f"z_{c}" for c in scoring.FEATURES]
    n_rows, rows = scoring.counted_and_standardised(features)
    forest = grown(rows, "id", z, trees, SAMPLE, seed, n_rows)
    if forest is None:
        flagged = rows.filter(F.lit(False)).withColumn("anomaly_score", F.lit(0.0))
    else:
        scored = stored(score(rows, forest), "scores")
        cut = cutoff(scored, n_rows, contamination)
        value = F.round(F.col("raw_score") - F.lit(cut), SCORE_DIGITS)
        flagged = scored.withColumn("anomaly_score", value).drop("raw_score").filter("anomaly_score < 0")
    found = scoring.signals(scoring.reasons(flagged))
    return (found.withColumn("severity", scoring.severity(F.col("anomaly_score"))).drop(*z)
            .orderBy(F.col("anomaly_score").asc(), F.col("id").asc()))


def severity_counts(anomalies: DataFrame) -> DataFrame:
    s = F.col("severity")
    return anomalies.agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "high").alias("high"),
                         F.count_if(s == "medium").alias("medium"), F.count_if(s == "low").alias("low"))


def type_counts(anomalies: DataFrame) -> DataFrame:
    return (anomalies.select(F.explode("anomaly_types").alias("anomaly_type"))
            .groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("n")))
