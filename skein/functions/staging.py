"""A barrier between expressions that the optimizer would write out once for every use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a one-row generator; later uses read their values instead of repeating their expressions."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
