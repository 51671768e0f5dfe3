"""Seeded ranks within groups of any size, without one task holding a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_OF_RANGE = 500_000  # rows of a group that one task numbers, about


def seeded(seed: int, *keys: Column) -> Column:
    """A hash in [0, 2**62) that orders the rows of a group."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 2)


def range_bits(rows: int) -> int:
    """Bits of the hash that cut a group of so many rows into ranges of about ROWS_OF_RANGE."""
    return min(24, max(0, rows // ROWS_OF_RANGE).bit_length())


def ranked(df: DataFrame, group: list[str], order: str, ties: list[str], largest: int, out: str = "rank") -> DataFrame:
    """Adds the 0-based rank by (order, ties) within the group.

    ``order`` is a seeded hash and ``largest`` the rows of the largest group.  A group is
    cut into ranges of the hash, as many as ``largest`` needs; the rows of a range are
    numbered by a window, the ranges before it by their counts.  One range needs no counts.
    """
    bits = range_bits(largest)
    if not bits:
        return df.withColumn(out, (F.row_number().over(Window.partitionBy(*group).orderBy(order, *ties)) - 1).cast("bigint"))
    cut = df.withColumn("_b", F.shiftrightunsigned(order, 62 - bits))
    counts = cut.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(*group, "_b").orderBy(order, *ties)
    placed = cut.withColumn("_own", F.row_number().over(own) - 1)
    return placed.join(offsets, [*group, "_b"]).withColumn(out, F.col("_before") + F.col("_own")).drop("_b", "_own", "_before")
