"""A mark of many values: some bits for each by its hash, so that nearly all others are left out before a join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Numbers of 64 bits, as powers of two: one for each value, within these bounds.
LEAST, MOST = 16, 20
BITS = 6  # bits of a value, all in one number


def _place(h: Column, k: int) -> Column:
    """The place of one bit, by the upper part of the hash; the number it stands in goes by the lower part."""
    return F.shiftrightunsigned(h, 28 + 6 * k).bitwiseAND(F.lit(63)).cast("int")


def _power(exponent: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), exponent)


def _bits(h: Column) -> Column:
    return reduce(Column.bitwiseOR, [_power(_place(h, k)) for k in range(BITS)])


def of(values: DataFrame, column: str) -> Column:
    """The bits of all values as one array of whole numbers: as many as there are values, 2^16 at least and 2^20 (8 MB) at
    most, so that the share of others that pass does not grow with the values up to there."""
    n = values.agg(F.count(column).alias("n")).scalar()
    wide = F.ceil(F.log2(F.greatest(n, F.lit(1)))).cast("int")
    size = _power(F.least(F.greatest(wide, F.lit(LEAST)), F.lit(MOST)))
    hashed = values.filter(F.col(column).isNotNull()).select(F.xxhash64(column).alias("h"))
    bits = hashed.groupBy(F.col("h").bitwiseAND(size - 1).alias("id")).agg(F.bit_or(_bits(F.col("h"))).alias("bits"))
    every = values.sparkSession.range(0, 1 << MOST, 1, 1).filter(F.col("id") < size).join(bits, "id", "left")
    rows = F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))))
    return every.agg(F.transform(rows, lambda r: r["bits"]).alias("marks")).scalar()


def is_marked(value: Column, marks: Column) -> Column:
    """True for every value that was marked, and seldom for another: for about one of 10,000 up to 2^20 values."""
    h = F.xxhash64(value)
    wanted, found = _bits(h), F.get(marks, h.bitwiseAND(F.size(marks) - 1).cast("int"))
    first = F.getbit(found, _place(h, 0)) == 1  # most others end here, before the six places are worked out
    return first & (found.bitwiseAND(wanted) == wanted)
