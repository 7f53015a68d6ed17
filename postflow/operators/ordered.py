"""Ordered work without one task per key.

A plain window sorts a whole key in one task.  Here the order is cut into ranges of its
first column, at approximate quantiles over all rows, so even a key that holds a third of
all rows is spread over many slices.  The quantiles are a scalar subquery of the plan:
nothing runs while a plan is built, nothing is written, and a lost task finds the same
borders again.  The rows are shuffled once, by key and slice; only one small row per
(key, slice) meets in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SLICE = "_slice"


def _place(df: DataFrame, column: str) -> Column:
    """The column, or for text a number that follows its order by the first bytes."""
    c = F.col(column)
    if dict(df.dtypes)[column] != "string":
        return c
    return F.conv(F.rpad(F.hex(F.encode(F.substring(c, 1, 7), "utf-8")), 56, "0").substr(1, 14), 16, 10).cast("long")


def slices(df: DataFrame, order: str, n: int | None = None) -> DataFrame:
    """Adds ``_slice``: balanced ranges of the column ``order``; rows of one value stay together."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = _place(df, order)
    if n < 2:
        return df.withColumn(SLICE, F.lit(0))
    borders = df.select(place.alias("_p")).agg(F.percentile_approx("_p", [k / n for k in range(1, n)], 10_000)).scalar()
    # The place of a value among the borders: how many of them are smaller.
    smaller = F.array_position(F.sort_array(F.array_append(borders, F.col("_p"))), F.col("_p")) - 1
    return df.withColumn("_p", place).withColumn(SLICE, F.coalesce(smaller, F.lit(0)).cast("int")).drop("_p")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` up to and including each row, in ``order`` within ``keys``."""
    cut = slices(df.withColumn("_v", value), order[0])
    totals = cut.groupBy(*keys, SLICE).agg(F.sum("_v").alias("_total"))
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), zero)).drop("_total")
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(offsets, keys + [SLICE])
    return joined.withColumn(out, F.col("_before") + F.sum("_v").over(inside)) \
        .drop("_v", "_before", SLICE)


def previous(df: DataFrame, keys: list[str], order: list[str], column: str, out: str) -> DataFrame:
    """The value of ``column`` in the row before, null for the first row of a key."""
    cut = slices(df, order[0])
    last = cut.groupBy(*keys, SLICE).agg(
        F.max_by(F.struct(column), F.struct(*order)).alias("_last"))
    across = Window.partitionBy(*keys).orderBy(SLICE)
    carried = last.withColumn("_carried", F.lag("_last").over(across)).drop("_last")
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    joined = cut.join(carried, keys + [SLICE])
    return joined.withColumn("_prev", F.lag(F.struct(column)).over(inside)) \
        .withColumn(out, F.coalesce("_prev", "_carried")[column]) \
        .drop("_prev", "_carried", SLICE)
