"""Running sums over groups of any size, in two levels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit(h: Column) -> Column:
    """A hash as a number in [0, 1)."""
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def running(rows: DataFrame, keys: list[str], place: Column, ties: list[Column], amount: Column, total: int, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``amount`` over the rows of the same keys that come before.

    The order is that of ``place``, a number in [0, 1), then ``ties``. Groups are cut into
    about sqrt(total) stretches of ``place``; stretches are summed on the map side and their
    running sums joined back, so no task holds more than a stretch of a group or the
    stretches of one. Keys must not be null.
    """
    n = max(1, math.isqrt(max(total, 1)))
    cut = rows.withColumn("__place", place).withColumn("__cut", F.floor(F.col("__place") * n)).withColumn("__amount", amount)
    sums = cut.groupBy(*keys, "__cut").agg(F.sum("__amount").alias("__sum"))
    over = Window.orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1) if keys else over
    before = sums.select(*keys, "__cut", F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, "__cut").orderBy("__place", *ties).rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumn("__in", F.coalesce(F.sum("__amount").over(inside), F.lit(0)))
    return summed.join(before, [*keys, "__cut"]).withColumn(out, F.col("__before") + F.col("__in")).drop("__place", "__cut", "__amount", "__before", "__in")
