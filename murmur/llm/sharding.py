"""Shards by best-fit-decreasing bin packing of indivisible groups.

Groups of equal texts stay together. Sorted by size, the largest first, each goes to the bin in which the least room
stays, found in a balanced tree of bins ordered by room. `pack` opens as few bins of a given capacity as it can;
`level` has a number of bins and looks for the least capacity at which they suffice, so their sizes are near equal.

The packing runs over a bounded list, whatever the table: a group of at least 1/LARGE of all bytes is an item of its
own, so there are at most LARGE of them, and the smaller groups are gathered by a hash of their text into SMALL items.
A group larger than an even share gets a bin to itself, and the others are levelled without it. With a capacity in place
of a number of shards, the list grows with the number of shards: groups of at least 1/FINE of the capacity are items,
and the smaller ones are gathered into bundles of a quarter of that on average, so few shards are left with room.

Sizes and hashes are computed where a text lies; only those are shuffled, summed before the shuffle, so one text with a
third of all rows is a few rows. Slots are numbered within short stretches of the partitions that the rows lie in, and
the stretches of a shard are laid end to end, so no task sorts a whole shard, and rows that are alike are no key.

Defined results: a null text has size 1 and is in one group with no other text than null; null and repeated ids are
rows like any others; rows that nothing tells apart get different slots; an empty table gives no rows; other columns
are not read, whatever their names. A very long text is measured whole, in the JVM; groups of equal size are told apart
by their place in the list, the large ones first, by hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.store import written

SHARDS = 8
SMALL = 4096
LARGE = 1024
PIECE_BITS = 14  # rows numbered together, as a power of two
FINE = 16  # with a capacity, groups from a sixteenth of it on are items of their own


class _Bin:
    __slots__ = ("key", "low", "high", "tall")

    def __init__(self, key):
        self.key, self.low, self.high, self.tall = key, None, None, 1


class Rooms:
    """A balanced search tree of bins by (room, number). Every change and search takes steps in the logarithm of the
    number of bins."""

    def __init__(self):
        self.top = None

    def put(self, room: int, number: int) -> None:
        self.top = self._put(self.top, (room, number))

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Takes out the bin with the least room that holds the size."""
        at, best = self.top, None
        while at:
            if at.key[0] >= size:
                best, at = at.key, at.low
            else:
                at = at.high
        if best:
            self.top = self._out(self.top, best)
        return best

    @staticmethod
    def _tall(at) -> int:
        return at.tall if at else 0

    def _even(self, at):
        at.tall = 1 + max(self._tall(at.low), self._tall(at.high))
        lean = self._tall(at.low) - self._tall(at.high)
        if lean > 1:
            if self._tall(at.low.low) < self._tall(at.low.high):
                at.low = self._turn(at.low, "high", "low")
            return self._turn(at, "low", "high")
        if lean < -1:
            if self._tall(at.high.high) < self._tall(at.high.low):
                at.high = self._turn(at.high, "low", "high")
            return self._turn(at, "high", "low")
        return at

    def _turn(self, at, up, down):
        new = getattr(at, up)
        setattr(at, up, getattr(new, down))
        setattr(new, down, at)
        for node in (at, new):
            node.tall = 1 + max(self._tall(node.low), self._tall(node.high))
        return new

    def _put(self, at, key):
        if at is None:
            return _Bin(key)
        if key < at.key:
            at.low = self._put(at.low, key)
        else:
            at.high = self._put(at.high, key)
        return self._even(at)

    def _out(self, at, key):
        if key < at.key:
            at.low = self._out(at.low, key)
        elif key > at.key:
            at.high = self._out(at.high, key)
        elif at.low is None or at.high is None:
            return at.low or at.high
        else:
            least = at.high
            while least.low:
                least = least.low
            at.key = least.key
            at.high = self._out(at.high, least.key)
        return self._even(at)


def pack(sizes: Sequence[int], capacity: int, bins: int | None = None) -> list[int] | None:
    """The bin of each item, by best fit decreasing. Opens a bin where none has room; with `bins` given, all are open
    from the start, and None says that they do not suffice. An item above the capacity has a bin of its own."""
    rooms, used, out = Rooms(), 0, [0] * len(sizes)
    for number in range(bins or 0):
        rooms.put(capacity, number)
        used += 1
    for item in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = rooms.take_tightest(sizes[item])
        if found is None:
            if bins is not None:
                return None
            found = (max(capacity, sizes[item]), used)
            used += 1
        rooms.put(found[0] - sizes[item], found[1])
        out[item] = found[1]
    return out


def level(sizes: Sequence[int], bins: int) -> list[int]:
    """The bin of each item, with so many bins of a capacity as small as best fit decreasing can do with."""
    out, alone, rest, left = [0] * len(sizes), 0, sum(sizes), list(range(len(sizes)))
    left.sort(key=lambda k: (-sizes[k], k))
    while left and alone < bins - 1 and sizes[left[0]] * (bins - alone) > rest:
        out[left[0]] = alone
        rest -= sizes[left.pop(0)]
        alone += 1
    if not left:
        return out
    n, sub = bins - alone, [sizes[k] for k in left]
    low = max(-(-rest // n), sub[0])
    high = low
    while (best := pack(sub, high, n)) is None:
        high += max(high // 16, 1)
    while low < high:
        middle = (low + high) // 2
        tried = pack(sub, middle, n)
        if tried is None:
            low = middle + 1
        else:
            best, high = tried, middle
    for k, number in zip(left, best):
        out[k] = alone + number
    return out


def _group() -> Column:
    return F.unhex(F.md5(F.coalesce(F.concat(F.lit("t"), F.col("text")), F.lit("n"))))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the group of the text as 16 bytes."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), _group().alias("group"))


def assigned(docs: DataFrame, shards: int = SHARDS, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of docs (doc_id, text); equal texts share a shard. The bytes
    of the shards are near equal; or, with a capacity, none holds more bytes, unless one group alone does, and they are as
    few as best fit decreasing makes them."""
    return slotted(placed(docs, shards, capacity).select("doc_id", "size", "text_crc32", "shard"))


def placed(docs: DataFrame, shards: int = SHARDS, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, group and shard of every row of docs."""
    spark = docs.sparkSession
    rows = written(measured(docs), "shards-rows")
    groups = written(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "shards-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    if capacity is None:
        least, bundles = F.col("bytes") * LARGE >= F.lit(total), SMALL
    else:
        least, bundles = F.col("bytes") * FINE >= F.lit(capacity), max(1, 4 * FINE * total // capacity)
    small = F.pmod(F.xxhash64("group"), F.lit(bundles)).cast("int")
    large = groups.filter(least).orderBy("group").collect()  # at most LARGE, or FINE for each shard
    alone = spark.createDataFrame([(bytes(r["group"]), k) for k, r in enumerate(large)], "group binary, item int")
    rest = (groups.join(alone, "group", "left_anti").groupBy(small.alias("small")).agg(F.sum("bytes").alias("bytes"))
            .orderBy("small").collect())  # at most SMALL, or 4 * FINE for each shard
    sizes = [r["bytes"] for r in large] + [r["bytes"] for r in rest]
    bins = level(sizes, shards) if capacity is None else pack(sizes, capacity)
    own = spark.createDataFrame([(bytes(r["group"]), b) for r, b in zip(large, bins)], "group binary, own int")
    many = spark.createDataFrame([(r["small"], b) for r, b in zip(rest, bins[len(large):])], "small int, many int")
    return (rows.withColumn("small", small).join(own, "group", "left").join(many, "small", "left")
            .select("doc_id", "size", "text_crc32", "group", F.coalesce("own", "many").alias("shard")))


def slotted(placed: DataFrame) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard) with a slot, counted without gaps from 0 in each shard. The rows are
    written in their partitions, and a row's number there says how many of its shard come before it: numbers are dealt
    by a partition and shard at a time, so rows that are all alike are split like any others."""
    numbered = written(placed.withColumn("_row", F.monotonically_increasing_id()), "shards-placed")
    piece = F.shiftright("_row", PIECE_BITS)  # neighbours of one partition, 2^PIECE_BITS at most
    counts = numbered.groupBy("shard", piece.alias("piece")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("part", F.shiftright("piece", 33 - PIECE_BITS))
    parts = counts.groupBy("shard", "part").agg(F.sum("n").alias("all"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.withColumn("begin", F.coalesce(F.sum("all").over(before), F.lit(0))).drop("all")
    inside = Window.partitionBy("shard", "part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (counts.withColumn("step", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(begins, ["shard", "part"])
              .select("shard", "piece", (F.col("begin") + F.col("step")).alias("start")))
    within = Window.partitionBy("shard", "piece").orderBy("_row")
    return (numbered.withColumn("piece", piece).withColumn("at", F.row_number().over(within))
            .join(starts, ["shard", "piece"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at") - 1).cast("long").alias("slot")))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, capacity: int | None = None) -> None:
    """The documents as Parquet files below path, a folder for each shard; every row once, whatever its id. Equal texts
    share a shard, so the 16 bytes of a text tell it."""
    own, at = _free(docs, "group"), _free(docs, "shard")
    keys = placed(docs, shards, capacity).groupBy(F.col("group").alias(own)).agg(F.first("shard").alias(at))
    joined = docs.join(keys, _group() == F.col(own)).drop(own)
    joined.drop("shard").withColumnRenamed(at, "shard").write.partitionBy("shard").parquet(path)


def _free(docs: DataFrame, name: str) -> str:
    """The name, or a longer one that docs has no column of."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name
