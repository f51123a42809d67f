"""Near-duplicate vectors by a pivot-permutation index.

Nearness is measured between unit vectors less the centre of their label, so a common direction, which text encoders
give to all vectors, does not put every vector beside the same pivots. Centres are means of a bounded sample. A centre is
taken off only as far as two vectors at the threshold stay near one another (SPREAD): of a label that is one dense group,
hardly at all.

Pivots are vectors of the same sample, no two of them within a cosine of APART, so a dense group holds few,
whatever its share of the rows. A vector is described by its PREFIX nearest pivots in order. Two vectors with the same
label that share at least SHARED pivots, or the nearest one, are candidates, and every candidate is verified by the
cosine of the raw vectors in double precision. The number of pivots grows with the square root of the vectors of the
largest label, so the lists, and the work for a vector, grow with the root as well, up to MOST_PIVOTS. A group that is
dense for the threshold shares its nearest pivot and is compared whole, as nearly all its pairs are links to count.

Pivots are numbered by how often the sample has them, the rarest first. A vector stands in the inverted lists of its first
PREFIX - SHARED + 1 pivots by number and of its nearest one: two vectors that share SHARED pivots meet in the list of
the least of them, and longer lists hold fewer.

Equal vectors of a label are one entry before, with their number. A list is worked on in blocks of at most BLOCK
entries: an entry goes to every pair of blocks that holds its own, so no task needs a whole list, and no pair of a long
list is left out. A pair that shares several lists is counted in the one of the least shared pivot, or of the nearest one if it shares
fewer than SHARED. A task compares a
pair of blocks as matrices and gives for each entry the number of its links, copies counted, and one link to the first
of its group, so no pairs are emitted.

The index finds candidates by their neighbourhood, so it may miss links; vectors within a cosine of 0.93 share most of
their nearest pivots, and the tests measure the recall against brute force, also for a dense group of a third of the rows. Links below the threshold are never given.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those without a label,
have no links; vectors are compared with those of their length only, each length with pivots of its own;
repeated rows count as vectors of their own; a null vec_id names no component unless all in it are null; an empty table
gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.graph import components, joined_labels
from murmur.llm.store import written

COSINE = 0.93
PREFIX = 10
SHARED = 3
LEAST_PIVOTS, MOST_PIVOTS = 32, 4096
APART = 0.86  # two pivots have a lower cosine, before centring
SPREAD = 0.25  # at least what centring leaves of a unit vector, squared: a pair at a cosine of 0.93 keeps 0.72
LEAST_SAMPLE = 32  # vectors of a label in the sample, for a centre of its own
OVERSAMPLE = 4  # sampled vectors for each pivot
BLOCK = 2000


def _vector(df: DataFrame) -> Column:
    """The embedding as it is stored, with one zero for both signs. Floats stay floats on their way through shuffles;
    the cosine is computed in doubles."""
    kind = df.schema["embedding"].dataType.elementType
    return F.transform("embedding", lambda x: x + F.lit(0).cast(kind))


def _usable(df: DataFrame) -> DataFrame:
    """vec_id, label and vector of the rows that may have links."""
    fit = (F.col("label").isNotNull() & (F.size("vector") > 0)
           & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
           & F.exists("vector", lambda x: x != 0))
    return df.select("vec_id", "label", _vector(df).alias("vector")).filter(fit)


class Reference(NamedTuple):
    pivots: np.ndarray  # unit rows after centring, the rarest of the sample first
    centres: dict[int, np.ndarray]  # by the hash of a label
    centre: np.ndarray  # of the labels that the sample holds too few of


def references(entries: DataFrame, count: int, prefix: int = PREFIX) -> dict[int, Reference]:
    """Pivots and centres for each vector length, from the entries with the least hash: pivots that are APART from the
    ones before, at most `count` of a length, and at most MOST_PIVOTS. The sample, OVERSAMPLE times as many vectors, is all
    that the driver sees of them."""
    count = min(count, MOST_PIVOTS)
    rows = (entries.select("place", "vector").orderBy(F.xxhash64("vector"), "node").limit(OVERSAMPLE * count)
            .collect())
    by_length: dict[int, list] = {}
    for place, vector in rows:
        by_length.setdefault(len(vector), []).append((place, vector))
    out = {}
    for length, some in by_length.items():
        places, unit = np.array([p for p, _ in some]), _unit(np.array([v for _, v in some]))
        known, n = np.unique(places, return_counts=True)
        centres = {int(p): centre_of(unit[places == p]) for p in known[n >= LEAST_SAMPLE]}
        rest = centre_of(unit) if len(unit) >= LEAST_SAMPLE else np.zeros(length)
        moved = centred(unit, places, centres, rest)
        chosen = moved[apart(unit, count)]
        used = np.bincount(nearest(moved, chosen, prefix).ravel(), minlength=len(chosen))
        out[length] = Reference(chosen[np.argsort(used, kind="stable")], centres, rest)
    return out


def centre_of(unit: np.ndarray) -> np.ndarray:
    """The mean of unit rows, shortened so that SPREAD of their squared length is left without it."""
    mean = unit.mean(axis=0)
    common = float(mean @ mean)
    if common > 1 - SPREAD:
        mean = mean * (1 - math.sqrt(1 - (1 - SPREAD) / common))
    return mean


def centred(unit: np.ndarray, places: np.ndarray, centres: dict[int, np.ndarray], rest: np.ndarray) -> np.ndarray:
    """Unit rows less the centre of their label, as unit rows; a row that lies in the centre stays as it is."""
    less = np.stack([centres.get(int(p), rest) for p in places])
    moved = unit - less
    still = np.abs(moved).max(axis=1) < 1e-6
    moved[still] = unit[still]
    return _unit(moved)


def apart(unit: np.ndarray, count: int) -> list[int]:
    """The places of the first rows of which no two have a cosine of APART or more, at most `count`."""
    kept, rows = [], np.empty((min(count, len(unit)), unit.shape[1]))
    for k, row in enumerate(unit):
        if len(kept) == len(rows):
            break
        if not kept or (rows[:len(kept)] @ row).max() < APART:
            rows[len(kept)] = row
            kept.append(k)
    return kept


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # so no square is too large or too small
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def nearest(unit: np.ndarray, reference: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """The places of the nearest pivots of each row, nearest first."""
    like = unit @ reference.T
    k = min(prefix, like.shape[1])
    top = np.argpartition(-like, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(like, top, 1), axis=1, kind="stable"), 1)


def _describer(reference: dict[int, Reference], prefix: int, shared: int):
    def describe(batches):
        for frame in batches:
            for length, part in frame.groupby(frame["vector"].map(len), sort=False):
                if length in reference:
                    ref = reference[length]
                    for start in range(0, len(part), 4096):
                        some = part.iloc[start:start + 4096]
                        unit = centred(_unit(np.stack(some["vector"].to_numpy())), some["place"].to_numpy(),
                                       ref.centres, ref.centre)
                        near = nearest(unit, ref.pivots, prefix).astype(np.int32)
                        yield some.assign(pivots=list(near), lists=[lists_of(row, shared) for row in near])
                else:  # no pivot has this length: one list holds them all
                    none = [np.array([-1], np.int32)] * len(part)
                    yield part.assign(pivots=none, lists=none)
    return describe


def lists_of(near: np.ndarray, shared: int) -> np.ndarray:
    """The pivots in whose lists a vector stands: the nearest, and by number all but the last ones that are too few to be
    all that a candidate shares."""
    some = np.sort(near)[:len(near) - min(shared, len(near)) + 1]
    return some if near[0] in some else np.append(some, near[0])


def compare(left: pd.DataFrame, right: pd.DataFrame, pivot: int, same: bool, cosine: float, shared: int):
    """Two blocks of the list of one pivot: links of each entry, copies counted, and the links as places (i, j). Pairs with
    enough shared pivots count if this is the least of them, other pairs if it is the nearest of both."""
    m = 2 + max(int(p.max()) for f in (left, right) for p in f["pivots"])

    def holds(frame):
        out = np.zeros((len(frame), m), np.float32)
        for row, p in enumerate(frame["pivots"]):
            out[row, np.asarray(p) + 1] = 1
        return out

    a, b = holds(left), holds(right)
    enough = a @ b.T >= np.minimum(shared, np.minimum(a.sum(1)[:, None], b.sum(1)[None, :]))
    lower = a[:, :pivot + 1] @ b[:, :pivot + 1].T
    first, second = (np.array([p[0] for p in f["pivots"]]) == pivot for f in (left, right))
    i, j = np.nonzero(np.where(enough, lower == 0, first[:, None] & second[None, :]))
    if same:
        i, j = i[i < j], j[i < j]
    x, y = np.stack(left["vector"].to_numpy()), np.stack(right["vector"].to_numpy())
    x, y = _unit(x), _unit(y)
    near = np.zeros(len(i), bool)
    for k in range(0, len(i), 100_000):
        s = slice(k, k + 100_000)
        near[s] = np.einsum("ij,ij->i", x[i[s]], y[j[s]]) >= cosine
    return i[near], j[near]


def _linker(cosine: float, shared: int):
    def link(frame: pd.DataFrame) -> pd.DataFrame:
        pivot = int(frame["pivot"].iloc[0])
        ours, theirs = int(frame["low"].iloc[0]), int(frame["high"].iloc[0])
        same = ours == theirs
        left = frame[frame["block"] == ours]
        right = left if same else frame[frame["block"] == theirs]
        if not len(left) or not len(right):
            return pd.DataFrame({"node": np.empty(0, np.int64), "n": np.empty(0, np.int64), "to": np.empty(0, np.int64)})
        i, j = compare(left, right, pivot, same, cosine, shared)
        nodes = left["node"].to_numpy() if same else np.concatenate([left["node"], right["node"]])
        copies = left["copies"].to_numpy() if same else np.concatenate([left["copies"], right["copies"]])
        if not same:
            j = j + len(left)
        n = np.zeros(len(nodes), np.int64)
        np.add.at(n, i, copies[j])
        np.add.at(n, j, copies[i])
        labels = joined_labels(np.arange(len(nodes)), i, j)
        linked = np.flatnonzero(n)
        return pd.DataFrame({"node": nodes[linked], "n": n[linked], "to": nodes[labels[linked]]})
    return link


def pivot_count(vectors: int) -> int:
    """Twice the square root, within the bounds."""
    return min(max(LEAST_PIVOTS, 2 * math.isqrt(vectors)), MOST_PIVOTS)


def linked(entries: DataFrame, cosine: float = COSINE, prefix: int = PREFIX, shared: int = SHARED) -> DataFrame:
    """From entries (node, label, vector, copies): node, n (links to other entries, copies counted) and `to` (one entry
    of its group), a row for every list in which the node has a link."""
    largest = entries.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    entries = entries.withColumn("place", F.xxhash64("label"))
    reference = references(entries, pivot_count(largest), prefix)
    described = written(entries.mapInPandas(
        _describer(reference, prefix, shared),
        f"node long, label {dict(entries.dtypes)['label']}, vector {dict(entries.dtypes)['vector']}, copies long, "
        "place long, pivots array<int>, lists array<int>").drop("place")
        .withColumn("length", F.size("vector")), "vectors-described")
    listed = described.withColumn("pivot", F.explode("lists")).drop("lists")
    lists = written(listed.groupBy("label", "length", "pivot").agg(F.count(F.lit(1)).alias("n")), "vectors-lists")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    placed = (listed.join(lists.withColumn("blocks", blocks).drop("n"), ["label", "length", "pivot"])
              .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    paired = (placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
              .select("label", "length", "pivot", "low", "high", "block", "node", "vector", "copies", "pivots"))
    return (paired.groupBy("label", "length", "pivot", "low", "high")
            .applyInPandas(_linker(cosine, shared), "node long, n long, to long"))


def grouped(vectors: DataFrame, cosine: float = COSINE, prefix: int = PREFIX, shared: int = SHARED) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label)."""
    usable = _usable(vectors)
    counted = usable.groupBy("label", "vector").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"))
    entries = written(counted.withColumn("node", F.monotonically_increasing_id()), "vectors-entries")
    found = written(linked(entries.select("node", "label", "vector", "copies"), cosine, prefix, shared),
                    "vectors-links")
    roots = components(found.select(F.col("node").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "at")
    links = found.groupBy("node").agg(F.sum("n").alias("n")).withColumnRenamed("node", "of")
    of_entries = (entries.join(roots, F.col("node") == F.col("at"), "left")
                  .join(links, F.col("node") == F.col("of"), "left")
                  .select("label", "vector", "first", F.coalesce("root", "node").alias("root"),
                          (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    names = of_entries.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(of_entries.join(names, "root").select(
        F.col("label").alias("l"), F.col("vector").alias("v"), "n_links", "component_id"), "vectors-named")
    rows = vectors.select("vec_id", "label", _vector(vectors).alias("vector"))
    return rows.join(named, (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v")), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
