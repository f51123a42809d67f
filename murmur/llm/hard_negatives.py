"""Hard negatives by an inverted multi-index.

Vectors have integer components. Each is cut into two halves, and each half goes to the nearest centre of its codebook;
a pair of centres is a cell. For an anchor, a centre c whose members lie within a radius r bounds the half score of all
of them from above by a.c + |a| r, and a cell by the sum of its two halves. A heap visits the cells of an anchor in
the order of these sums (multi-sequence), and stops where no cell left can change a window of the result: the best
positives, then for each of them the best negatives whose scores lie in its window. So the result is exact, and how many
cells an anchor visits follows from the data.

The visits are made in two rounds, each a join of anchors with the cells they ask for. The first visits the best cells
until they hold PROBE rows; what it finds sets a floor under each window. The second visits all cells whose bound
reaches a floor. Both sides of a cell are cut into blocks of at most BLOCK rows and ASKS anchors, so no task holds a whole
cell, however many rows are alike. The codebooks are trained on at most SAMPLE vectors, those of the least hash, and have
at most MOST_CENTRES centres each; every row is indexed, and beyond that number cells grow, but nothing is left out.
Centres are integers and radii are rounded up, so bounds are the same in every task.

Defined results: vectors that are null or hold a null, and rows without a label, take no part; an empty vector has score 0
with another. Vectors of different lengths have no score together. Repeated rows and ids are rows of their own, also as
anchors; a null id comes last among equal scores and is no anchor. Vectors with very large components, or of lengths that
the sample has not, lie in a cell that is always visited; scores beyond a long count as the largest or least long. A
positive of negative score has no negatives. An empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from murmur.llm.store import written

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # a negative's score in percent of the positive's
SAMPLE = 20_000
CELL_ROWS = 1024  # rows of a cell, on average
MOST_CENTRES = 512
PROBE = 4096
BLOCK, ASKS = 4096, 1024
ROUNDS = 8  # of k-means
_NARROW = 1 << 20  # components up to here, in lengths up to _SHORT, have scores that a double holds exactly
_SHORT = 4096
_LONG = 2 ** 63 - 1

_BASE = "node long, vec_id long, label long, anchor boolean, length int, wide boolean, q binary"
_CELLS = _BASE + ", i int, j int, r1 double, r2 double"
_QUERY = "node long, label long, length int, wide boolean, q binary, lows array<long>, highs array<long>"
_ASK = _QUERY + ", i int, j int"
_FOUND = "node long, place int, score long, vec_id long, member long"


def quantised(embedding: Column, scale: int = 256) -> Column:
    """The components as floor(scale * x), x as a double; null for a vector that is null or holds a null or a component
    that is not finite."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.when(good, F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _pack(batches):
    for frame in batches:
        vectors = [np.asarray(v, np.int64) for v in frame["vector"]]
        wide = [len(v) > _SHORT or bool(len(v)) and max(int(v.max()), -int(v.min())) > _NARROW for v in vectors]
        yield frame.drop(columns="vector").assign(
            length=np.array([len(v) for v in vectors], np.int32), wide=np.array(wide, bool),
            q=[v.astype("<i8" if w else "<i4").tobytes() for v, w in zip(vectors, wide)])


def _rows(packed: pd.Series, length: int, wide: bool = False) -> np.ndarray:
    """The vectors of one length; doubles, or for wide ones Python's integers."""
    if not wide:
        return np.frombuffer(b"".join(packed), "<i4").reshape(len(packed), length).astype(np.float64)
    return np.array([[int(x) for x in np.frombuffer(q, "<i8" if len(q) == 8 * length else "<i4")] for q in packed],
                    object).reshape(len(packed), length)


def centres(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most k integer centres of the rows: k-means from rows spread over the order of their first component."""
    different = np.unique(rows, axis=0)
    start = different[np.linspace(0, len(different) - 1, min(k, len(different))).astype(int)]
    for _ in range(rounds):
        own = nearest(rows, start)[0]
        sums = np.zeros_like(start)
        np.add.at(sums, own, rows)
        counts = np.bincount(own, minlength=len(start))[:, None]
        start = np.where(counts > 0, np.rint(sums / np.maximum(counts, 1)), start)
    return start


def nearest(rows: np.ndarray, reference: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and the distance to it."""
    if not rows.shape[1]:
        return np.zeros(len(rows), np.int64), np.zeros(len(rows))
    own = ((reference ** 2).sum(1)[None, :] - 2 * rows @ reference.T).argmin(axis=1)
    return own, np.sqrt(((rows - reference[own]) ** 2).sum(axis=1))


class Index:
    """The codebooks with their radii and the sizes of the cells: at most SAMPLE centres, whatever the table holds."""

    def __init__(self, books: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.books = books
        self.radii: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.sizes: dict[int, np.ndarray] = {}

    def visits(self, q: np.ndarray, length: int):
        """The cells in the order of their upper bounds: (upper, lower, i, j). Cells without rows are passed over."""
        sides = []
        for half, book, radius in zip((q[:length // 2], q[length // 2:]), self.books[length], self.radii[length]):
            reach = np.ceil(math.sqrt(float(half @ half)) * radius * (1 + 1e-9))
            score = book @ half
            order = np.argsort(-(score + reach), kind="stable")
            sides.append((order, (score + reach)[order], (score - reach)[order]))
        (one, up1, low1), (two, up2, low2) = sides
        size = self.sizes[length]
        heap, met = [(-(up1[0] + up2[0]), 0, 0)], {(0, 0)}
        while heap:
            bound, a, b = heapq.heappop(heap)
            if size[one[a], two[b]]:
                yield -bound, low1[a] + low2[b], int(one[a]), int(two[b])
            for step in ((a + 1, b), (a, b + 1)):
                if step[0] < len(one) and step[1] < len(two) and step not in met:
                    met.add(step)
                    heapq.heappush(heap, (-(up1[step[0]] + up2[step[1]]), *step))

    def asked(self, q, length: int, wide: bool, lows, highs, floors: dict[int, int] | None, probe: int):
        """The cells of one round. The first, where floors is None, ends with the cell that brings the rows to probe;
        the second leaves those out and ends with the last cell that a window still needs."""
        if floors is None:
            yield -1, -1  # rows that have no bound
        if length not in self.sizes:
            return
        if wide:  # no bounds: all cells, in the first round
            if floors is None:
                yield from ((int(i), int(j)) for i, j in np.argwhere(self.sizes[length]))
            return
        rows, windows = 0, []
        if floors is not None:
            windows = [(max(low, floors.get(k, low)), high) for k, (low, high) in enumerate(zip(lows, highs))
                       if low <= high]
        for upper, lower, i, j in self.visits(q, length):
            seen = rows >= probe
            rows += int(self.sizes[length][i, j])
            if floors is None:
                if seen:
                    return
                yield i, j
            elif seen:
                if not any(upper >= low for low, _ in windows):
                    return
                if any(upper >= low and lower <= high for low, high in windows):
                    yield i, j


def _describer(books):
    def describe(batches):
        for frame in batches:
            for (length, wide), part in frame.groupby(["length", "wide"], sort=False):
                length = int(length)
                if wide or length not in books:
                    yield part.assign(i=np.int32(-1), j=np.int32(-1), r1=0.0, r2=0.0)
                    continue
                for at in range(0, len(part), 4096):
                    some = part.iloc[at:at + 4096]
                    rows = _rows(some["q"], length)
                    (i, r1), (j, r2) = (nearest(x, book) for x, book in zip(
                        (rows[:, :length // 2], rows[:, length // 2:]), books[length]))
                    yield some.assign(i=i.astype(np.int32), j=j.astype(np.int32), r1=r1, r2=r2)
    return describe


def indexed(items: DataFrame, cell_rows: int = CELL_ROWS, sample: int = SAMPLE) -> tuple[DataFrame, Index]:
    """The rows of items (vec_id, label, vector of longs, anchor), each in its cell, and the index over them."""
    base = items.select(
        F.monotonically_increasing_id().alias("node"), F.col("vec_id").cast("long"), F.col("label").cast("long"),
        F.coalesce("anchor", F.lit(False)).alias("anchor"), "vector").filter(
        F.col("label").isNotNull() & F.forall("vector", lambda x: x.isNotNull()))
    base = written(base.mapInPandas(_pack, _BASE), "negatives-rows")
    k = min(max(math.isqrt(base.count() // cell_rows), 1), MOST_CENTRES)
    drawn: dict[int, list[bytes]] = {}
    for length, q in (base.filter(~F.col("wide")).orderBy(F.xxhash64("q"), "node").limit(sample)
                      .select("length", "q").collect()):
        drawn.setdefault(length, []).append(q)
    books = {}
    for length, packed in drawn.items():
        rows = _rows(pd.Series(packed), length)
        books[length] = tuple(centres(x, k) for x in (rows[:, :length // 2], rows[:, length // 2:]))
    placed = written(base.mapInPandas(_describer(books), _CELLS), "negatives-cells")
    index = Index(books)
    index.radii = {n: tuple(np.zeros(len(b)) for b in books[n]) for n in books}
    index.sizes = {n: np.zeros(tuple(len(b) for b in books[n]), np.int64) for n in books}
    bounded = placed.filter("i >= 0")
    for half, (c, r) in enumerate((("i", "r1"), ("j", "r2"))):
        for length, own, far in bounded.groupBy("length", c).agg(F.max(r)).collect():
            index.radii[length][half][own] = far * (1 + 1e-9)
    for length, i, j, n in bounded.groupBy("length", "i", "j").agg(F.count(F.lit(1))).collect():
        index.sizes[length][i, j] = n
    return placed, index


def _asker(index: Index, probe: int, second: bool):
    def ask(batches):
        for frame in batches:
            floors = frame.pop("floors") if second else [None] * len(frame)
            rows, places = [], []
            for row, of in zip(frame.itertuples(index=False), floors):
                q = None if row.wide else _rows([row.q], row.length)[0]
                known = None if not second else {} if of is None else dict(of)
                if known:  # what lies below a floor is beaten by what the first round has found
                    row = row._replace(lows=[max(low, known.get(k, low)) for k, low in enumerate(row.lows)])
                cells = list(index.asked(q, row.length, row.wide, row.lows, row.highs, known, probe))
                rows.extend([row] * len(cells))
                places.extend(cells)
                if len(rows) >= 20_000:
                    yield _asks(rows, places)
                    rows, places = [], []
            if rows:
                yield _asks(rows, places)
    return ask


def _asks(rows: list, places: list) -> pd.DataFrame:
    out = pd.DataFrame(rows)
    return out.assign(i=np.array([p[0] for p in places], np.int32), j=np.array([p[1] for p in places], np.int32))


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, first the first among equal ones."""
    if len(score) > k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return some[np.argsort(-score[some], kind="stable")[:k]]
    return np.argsort(-score, kind="stable")


def _scorer(k: int, same: bool):
    """One block of anchors against one block of a cell: the k best of each window."""
    def score(asks: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asks) and len(members):
            members = members.sort_values(["vec_id", "member"], na_position="last")
            length = int(asks["length"].iloc[0])
            wide = bool(asks["wide"].any() or members["wide"].any())
            table = _rows(asks["q"], length, wide) @ _rows(members["q"], length, wide).T
            if wide:
                table = np.clip(table, -_LONG - 1, _LONG) if table.size else table
            table = np.asarray(table).astype(np.int64).reshape(len(asks), len(members))
            labels, nodes, ids = (members[c].to_numpy() for c in ("label", "member", "vec_id"))
            for row, ask in zip(table, asks.itertuples(index=False)):
                fit = (labels == ask.label) & (nodes != ask.node) if same else labels != ask.label
                for place, (low, high) in enumerate(zip(ask.lows, ask.highs)):
                    inside = np.flatnonzero(fit & (row >= low) & (row <= high))
                    out += [(ask.node, place, row[m], ids[m], nodes[m]) for m in inside[best(row[inside], k)]]
        frame = pd.DataFrame(out, columns=["node", "place", "score", "vec_id", "member"])
        return frame.astype({"node": "int64", "place": "int32", "score": "int64", "vec_id": "Int64", "member": "int64"})
    return score


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("node", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "member")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _visited(asks: DataFrame, rows: DataFrame, k: int, same: bool, name: str) -> DataFrame:
    """The best of every window in the cells that are asked for."""
    cell = ["length", "i", "j"]
    asks = written(asks, f"{name}-asks")
    sizes = rows.groupBy(cell).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("row_blocks"))
    calls = asks.groupBy(cell).agg(F.ceil(F.count(F.lit(1)) / F.lit(ASKS)).cast("int").alias("ask_blocks"))
    parts = written(sizes.join(calls, cell), f"{name}-parts")

    def blocks(own: str, other: str, key: str, mine: str, theirs: str):
        return (F.pmod(F.xxhash64(key), F.col(own)).cast("int").alias(mine),
                F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs))

    left = asks.join(parts, cell).select("*", *blocks("ask_blocks", "row_blocks", "node", "a", "b"))
    members = (rows.select(*cell, F.col("node").alias("member"), "vec_id", "label", "wide", "q").join(parts, cell)
               .select("*", *blocks("row_blocks", "ask_blocks", "member", "b", "a")))
    group = [*cell, "a", "b"]
    drop = ["row_blocks", "ask_blocks"]
    return written(left.drop(*drop).groupBy(group).cogroup(members.drop(*drop).groupBy(group))
                   .applyInPandas(_scorer(k, same), _FOUND), f"{name}-found")


def search(queries: DataFrame, rows: DataFrame, index: Index, k: int, same: bool, probe: int = PROBE) -> DataFrame:
    """For each query (node, label, length, wide, q, lows, highs) and each of its windows, by `place`, the k rows of the
    same label (itself left out) or of other labels with the highest scores between low and high."""
    name = "negatives-same" if same else "negatives-other"
    first = _visited(queries.mapInPandas(_asker(index, probe, False), _ASK), rows, k, same, f"{name}-1")
    full = _top(first, k).groupBy("node", "place").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    floors = (full.filter(F.col("n") == k).groupBy(F.col("node").alias("of"))
              .agg(F.map_from_entries(F.collect_list(F.struct("place", "least"))).alias("floors")))
    again = queries.join(floors, F.col("node") == F.col("of"), "left").drop("of")
    second = _visited(again.mapInPandas(_asker(index, probe, True), _ASK), rows, k, same, f"{name}-2")
    return _top(first.unionByName(second), k)


def mined(items: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
          cell_rows: int = CELL_ROWS, probe: int = PROBE) -> DataFrame:
    """From items (vec_id, label, vector of longs, anchor): for every anchor its first `positives` rows of the same
    label, and for each of them the first `negatives` of other labels with low <= 100 * score / positive's score <= high:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank."""
    rows, index = indexed(items, cell_rows)
    anchors = rows.filter("anchor").select("node", "label", "length", "wide", "q")
    whole = anchors.select("*", F.array(F.lit(-_LONG - 1)).alias("lows"), F.array(F.lit(_LONG)).alias("highs"))
    liked = written(search(whole, rows, index, positives, True, probe).select(
        F.col("node").alias("of"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.col("rank").alias("positive_rank")), "negatives-positives")
    scores = liked.groupBy("of").agg(F.transform(F.sort_array(F.collect_list(F.struct("positive_rank", "positive_score"))),
                                                 lambda s: s["positive_score"].cast("decimal(38,0)")).alias("scores"))
    limits = [F.transform("scores", bound).alias(name) for name, bound in (
        ("lows", lambda s: F.ceil(s * low / 100).cast("long")), ("highs", lambda s: F.floor(s * high / 100).cast("long")))]
    asked = anchors.join(scores, F.col("node") == F.col("of")).select("node", "label", "length", "wide", "q", *limits)
    found = search(asked, rows, index, negatives, False, probe).withColumnRenamed("vec_id", "negative_id")
    ids = rows.filter("anchor").select(F.col("node").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (found.join(liked, (F.col("node") == F.col("of")) & (F.col("place") + 1 == F.col("positive_rank")))
            .join(ids, F.col("node") == F.col("anchor"))
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                    F.col("score").alias("negative_score"), "positive_rank"))
