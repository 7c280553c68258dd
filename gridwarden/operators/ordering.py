"""Taking a prefix of a hash order without sorting everything in one task.

A 64-bit hash is cut into a fixed number of bins. The running total over the bins is a window on a table
of at most ``BINS`` rows per class; only bins on the edge of the prefix are ordered row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096


def hash_bin(h: Column) -> Column:
    """Bin 0..BINS-1 of a signed 64-bit hash, in hash order."""
    return (F.shiftright(h, 52) + F.lit(BINS // 2)).cast("int")


def running_bins(df: DataFrame, bins: Sequence[str], weight: Column) -> DataFrame:
    """Weight per bin and the weight before it. ``bins`` must take a bounded number of values."""
    table = df.groupBy(*bins).agg(F.sum(weight).alias("_weight"))
    before = Window.orderBy(*bins).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    return table.withColumns({"_before": F.coalesce(F.sum("_weight").over(before), F.lit(0)), "_sum": F.sum("_weight").over(everything)})
