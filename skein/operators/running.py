"""Running sums, minima and maxima in a total order, without one task holding a whole group.

A window over a whole table, or over a group that may hold a third of it, runs in one
task.  A table that the optimizer takes for larger than SMALL bytes is therefore cut
into ranges of the order by Spark's range partitioning (its sample makes them even, and
a group of any size is spread over several), written once with the number of the range,
and every fold is a window within a range plus what the ranges before it give, of which
there is one row a group and range.  Both ways give the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.workspace import shared_folder

SMALL = 64 << 20  # estimated bytes that one window may order, and of a range
MOST_RANGES = 50_000


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of a table; it reads nothing."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def written(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read back, so that what follows does not compute it again."""
    path = f"{shared_folder(df.sparkSession)}/ranges-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Ordered:
    """A table in an order within groups, to which folds of what comes before a row are added."""

    def __init__(self, df: DataFrame, order: list[str], group: list[str] = ()):
        self.order, self.group = list(order), list(group)
        size = estimated_bytes(df)
        self.ranged = size > SMALL
        if self.ranged:
            ranges = int(min(MOST_RANGES, max(2, size // SMALL)))
            df = written(df.repartitionByRange(ranges, *self.group, *self.order).withColumn("_r", F.spark_partition_id()))
        self.df = df

    def add(self, inclusive: bool = False, **folds: tuple) -> "Ordered":
        """Adds columns ``name=(fold, value)``; the fold is F.sum, F.min or F.max over the rows before, and the row itself if inclusive."""
        last = 0 if inclusive else -1
        if not self.ranged:
            w = Window.partitionBy(*(self.group or [F.lit(0)])).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, last)
            self.df = self.df.select("*", *[_or_zero(fold, fold(value).over(w)).alias(name) for name, (fold, value) in folds.items()])
            return self
        own = Window.partitionBy(*self.group, "_r").orderBy(*self.order).rowsBetween(Window.unboundedPreceding, last)
        before = Window.partitionBy(*(self.group or [F.lit(0)])).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
        whole = self.df.groupBy(*self.group, "_r").agg(*[fold(value).alias(f"_{name}") for name, (fold, value) in folds.items()])
        carry = whole.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(self.group)], F.col("_r").alias("_of"), *[fold(f"_{name}").over(before).alias(f"_{name}") for name, (fold, _) in folds.items()])
        local = self.df.select("*", *[fold(value).over(own).alias(name) for name, (fold, value) in folds.items()])
        same = F.col("_r") == F.col("_of")
        for k, g in enumerate(self.group):
            same = same & local[g].eqNullSafe(F.col(f"_g{k}"))
        joined = local.join(carry, same)
        kept = [local[c] for c in self.df.columns]
        self.df = written(joined.select(*kept, *[_joined(fold, F.col(f"_{name}"), local[name]).alias(name) for name, (fold, _) in folds.items()]))
        return self

    def with_columns(self, **columns: Column) -> "Ordered":
        self.df = self.df.withColumns(columns)
        return self


def _or_zero(fold, value: Column) -> Column:
    return F.coalesce(value, F.lit(0)) if fold is F.sum else value


def _joined(fold, carry: Column, own: Column) -> Column:
    if fold is F.sum:
        return F.coalesce(carry, F.lit(0)) + F.coalesce(own, F.lit(0))
    return F.least(carry, own) if fold is F.min else F.greatest(carry, own)


def running(df: DataFrame, order: list[str], value: Column | None = None, group: list[str] = (), out: str = "before") -> DataFrame:
    """Adds the sum of ``value`` (1 if none) over the rows that come before, in their group.

    The order is made total by its last columns; null keys come first.
    """
    o = Ordered(df.withColumn("_v", F.lit(1) if value is None else value), order, group).add(**{out: (F.sum, F.col("_v"))})
    return o.df.select(*df.columns, out)
