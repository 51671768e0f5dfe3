"""Measures of vectors held as arrays, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def centres(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """``(group, centre)``: the mean vector of each group, summed place by place before the shuffle."""
    each = rows.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return each.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("centre"))  # one entry a dimension


def cosine_to_centre(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """``(group, mean_cosine, n)``: how close the vectors of a group lie to its mean vector; null for vectors without a direction."""
    both = rows.select(group, vector).join(centres(rows, group, vector), group)
    sizes = F.sqrt(squares(F.col(vector))) * F.sqrt(squares(F.col("centre")))
    cosine = F.when(sizes > 0, dot(F.col(vector), F.col("centre")) / sizes)
    return both.groupBy(group).agg(F.avg(cosine).alias("mean_cosine"), F.count("*").alias("n"))
