"""Near-duplicates by SimHash fingerprints, found in a Gray-order hierarchical index.

A fingerprint has 64 bits, each by the majority of the XXH64 hashes of a text's word shingles. Distinct fingerprints are
linked where at most RADIUS bits differ. The index has an upper part that Spark deals out and a lower part in each task.

Upper part: the bits are cut into four blocks, and two fingerprints within two bits agree in at least two of them. So
each of the six masks of two blocks is an upper node for every pattern under it, and a fingerprint goes to the six
nodes whose pattern it shares; no link is lost. A node of more than BLOCK fingerprints is dealt out as three: its other 32
bits are cut into three parts, and two fingerprints within two bits agree in at least one of them. A part node fixes 42 bits
or more, so it has at most 2^22 fingerprints (32 MB), whatever the table holds.

Lower part: within a node the fingerprints are sorted by Gray rank, so neighbours differ in few bits. Runs of FAN of
them form a node that keeps the bits all of them share, as a mask and a pattern; runs of nodes form a node above, which
takes over the bits that its children share. A search goes down from the top and adds up, level by level, the
differing bits under the masks; a whole group is dropped once the sum is beyond RADIUS.

A task emits no pairs: links are joined to groups on the spot, and each fingerprint gives one link to the first of its
group. A task holds whole nodes, up to BLOCK fingerprints and one node together; a fingerprint has at most 2,080 others within two bits, whatever the copies, as equal ones are one row before.

Defined results: a null text is an empty one; a text without words has fingerprint zero and is linked like any other;
a null doc_id never names a component, unless all of it are null; an empty table gives no rows; other columns are not
read, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from murmur.llm.graph import components, joined_labels
from murmur.llm.store import written

SHINGLE = 3
SEED = 42
RADIUS = 2
FAN = 16
BLOCK = 100_000
QUERIES = 20_000  # fingerprints that are searched at a time
MASKS = [sum(0xFFFF << (16 * b) for b in pair) for pair in combinations(range(4), RADIUS)]
PARTS = 3  # of the bits that a mask leaves free; one more than RADIUS

_BYTE = np.arange(8) * 256
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_RUN = 65_536  # shingles hashed at a time


def fingerprint(text: str | None) -> int:
    """The fingerprint of a whole text as an unsigned number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, n, of = b" ".join(words), len(words), xxhash.xxh64_intdigest
    if n <= SHINGLE:
        return of(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n - SHINGLE + 1].tolist()
    ends = ends[SHINGLE - 1:].tolist()
    set_ = np.zeros(2048, np.int64)
    for k in range(0, len(starts), _RUN):
        hashes = np.array([of(joined[a:b], SEED) for a, b in zip(starts[k:k + _RUN], ends[k:k + _RUN])], "<u8")
        set_ += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE).ravel(), minlength=2048)
    ones = (set_.reshape(8, 256) @ _BITS).ravel()
    return sum(1 << int(bit) for bit in np.flatnonzero(2 * ones > len(starts)))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each number in Gray order."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class Level:
    """Nodes of one level: the bits that a node adds to those above it, their pattern, and the runs of its children."""

    def __init__(self, pattern, mask, begin, end):
        self.pattern, self.mask, self.begin, self.end = pattern, mask, begin, end


def hierarchy(values: np.ndarray) -> list[Level]:
    """The index over sorted fingerprints, top level first; the last level is the fingerprints themselves. begin and
    end of a node are places in the level below."""
    n = len(values)
    levels = [Level(values, np.full(n, ~np.uint64(0)), np.arange(n), np.arange(1, n + 1))]
    while len(levels[0].pattern) > FAN:
        below = levels[0]
        begin = np.arange(0, len(below.pattern), FAN)
        end = np.minimum(begin + FAN, len(below.pattern))
        pattern = below.pattern[begin]
        odd = (below.pattern ^ np.repeat(pattern, end - begin)) | ~below.mask
        levels.insert(0, Level(pattern, ~np.bitwise_or.reduceat(odd, begin), begin, end))
    for above, below in zip(levels, levels[1:]):  # what a node shares is counted once, at the top
        below.own = below.mask & ~np.repeat(above.mask, above.end - above.begin)
    levels[0].own = levels[0].mask
    return levels


def search(levels: list[Level], queries: np.ndarray, upto: np.ndarray):
    """Links of the fingerprints at the given places to those at later places before upto. Yields arrays (i, j)."""
    leaves = levels[-1].pattern
    reach = [np.arange(len(leaves) + 1)]  # first leaf of each node
    for above in reversed(levels[:-1]):
        reach.insert(0, np.append(reach[0][above.begin], len(leaves)))
    for k in range(0, len(queries), QUERIES):
        some, ends = queries[k:k + QUERIES], upto[k:k + QUERIES]
        top = len(levels[0].pattern)
        q = np.repeat(np.arange(len(some)), top)
        node = np.tile(np.arange(top), len(some))
        far = np.zeros(len(q), np.uint8)
        for depth, level in enumerate(levels):
            near = (reach[depth][node + 1] > some[q] + 1) & (reach[depth][node] < ends[q])
            q, node, far = q[near], node[near], far[near]
            far = far + np.bitwise_count((leaves[some[q]] ^ level.pattern[node]) & level.own[node])
            near = far <= RADIUS
            q, node, far = q[near], node[near], far[near]
            if depth + 1 < len(levels):
                size = level.end[node] - level.begin[node]
                first = np.repeat(level.begin[node] - (np.cumsum(size) - size), size)
                q, far = np.repeat(q, size), np.repeat(far, size)
                node = first + np.arange(len(first))
        yield some[q], node


def block_links(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within equal keys: each fingerprint that has one, with the first of its group. keys and values as read,
    equal keys side by side."""
    order = np.lexsort((gray_rank(values), keys))
    keys, values = keys[order], values[order]
    last = np.append(np.flatnonzero(keys[1:] != keys[:-1]), len(keys) - 1) + 1
    until = np.repeat(last, np.diff(np.concatenate([[0], last])))
    places = np.arange(len(keys))
    asks = places[until > places + 1]
    labels = places.copy()
    if len(asks):
        for i, j in search(hierarchy(values), asks, until[asks]):
            labels = joined_labels(labels, i, j)
    moved = np.flatnonzero(labels != places)
    return values[moved], values[labels[moved]]


def _linker(batches):
    """Rows (mask, key, fp) sorted by mask and key: the links of each run of whole keys, of one mask."""
    held = []

    def out(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = block_links(frame["key"].to_numpy(np.int64), frame["fp"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    size = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += len(batch)
        if size < BLOCK:
            continue
        frame = pd.concat(held, ignore_index=True)
        mask, key = frame["mask"].to_numpy(), frame["key"].to_numpy()
        end = int(np.flatnonzero((mask != mask[-1]) | (key != key[-1]))[-1] + 1) if (
            (mask[0] != mask[-1]) or (key[0] != key[-1])) else 0
        for _, part in frame.iloc[:end].groupby("mask", sort=False):
            yield out(part)
        held = [frame.iloc[end:]]
        size = len(held[0])
    if held:
        for _, part in pd.concat(held, ignore_index=True).groupby("mask", sort=False):
            yield out(part)


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""
    return docs.select("doc_id", _fingerprints("text").alias("fp"))


def part_masks(mask: int) -> list[int]:
    """The mask with each of the PARTS of the bits it leaves free added."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // PARTS for k in range(PARTS + 1)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:])]


def _node(number: int, mask: int) -> Column:
    key = F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
    return F.struct(F.lit(number).alias("mask"), key.alias("key"))


def nodes(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """(mask, key, fp): distinct fingerprints (fp) with the nodes of the upper part they belong to. The large nodes are
    counted and written, at most one for each `block` rows, so Spark knows their size when it joins them."""
    plain = distinct.select(F.explode(F.array(*[_node(k, m) for k, m in enumerate(MASKS)])).alias("n"), "fp").select(
        "n.mask", "n.key", "fp")
    large = written(plain.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > block),
                    "simhash-large")
    parts = F.array(*[F.array(*[_node(len(MASKS) + PARTS * k + part, m) for part, m in enumerate(part_masks(mask))])
                      for k, mask in enumerate(MASKS)])
    own = F.array(F.struct("mask", "key"))
    dealt = F.when(F.col("_size").isNull(), own).otherwise(F.get(parts, F.col("mask")))
    return (plain.join(large, ["mask", "key"], "left").select(F.explode(dealt).alias("n"), "fp")
            .select("n.mask", "n.key", "fp"))


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """From distinct fingerprints (fp): links (a, b) that join exactly those within RADIUS bits into one component."""
    return (nodes(distinct, block).repartition("mask", "key").sortWithinPartitions("mask", "key")
            .mapInPandas(_linker, "a long, b long"))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (least doc_id that links reach) and root (a fingerprint that names the component) of
    every row of docs (doc_id, text)."""
    of_docs = written(fingerprints(docs), "simhash-fingerprints")
    distinct = written(of_docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(distinct.select("fp")))
    rooted = (distinct.join(roots, F.col("fp") == F.col("node"), "left")
              .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(rooted.join(names, "root").select("fp", "component_id", "root"), "simhash-components")
    return of_docs.join(named, "fp").select("doc_id", "fp", "component_id", "root")


def first_of_groups(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: one for each component, that of the least doc_id. Where an
    id is null or stands in several rows, the rows are told apart by their component, and one of each stays. The ids
    that go are written, so Spark knows how many they are when it chooses the join; they are fewer than the rest."""
    ids = written(grouped(docs), "simhash-groups")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    firsts = ids.filter(first)
    by_id = ids.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_rows"), F.bool_or(first).alias("_first"))
    gone = written(by_id.filter("_id IS NOT NULL AND (_rows > 1 OR NOT _first)").select("_id"), "simhash-gone")
    others = written(by_id.filter("_first AND (_id IS NULL OR _rows > 1)").select("_id"), "simhash-others")
    plain = docs.filter(docs["doc_id"].isNotNull()).join(gone, docs["doc_id"] == gone["_id"], "left_anti")
    roots = firsts.select(F.col("doc_id").alias("_at"), F.col("fp").alias("_fp"), F.col("root").alias("_root")).distinct()
    doubled = written(docs.join(others, docs["doc_id"].eqNullSafe(others["_id"]), "left_semi")
                      .select("doc_id", _fingerprints("text").alias("of"), F.struct("*").alias("row")), "simhash-doubled")
    told = (doubled.join(roots, (F.col("of") == F.col("_fp")) & F.col("doc_id").eqNullSafe(F.col("_at")))
            .dropDuplicates(["_root"]).select("row.*"))
    return plain.unionByName(told)
