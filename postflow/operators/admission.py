"""Greedy admission of calls under a budget.

In order, a call is admitted when its cost still fits into what is left of its budget, so a later, cheaper
call may be admitted after one that did not fit.  That is a sequential rule; it is computed in phases, for all
budgets side by side and without walking through any of them.

A phase starts with ``left`` of a budget.  Calls of at most half of that are *small*, the others *big*.
While no more than half has been spent, every small call fits.  So the phase ends, at the latest, with the first
small call whose running sum passes the half, or earlier with the first big call that fits beside the small
calls before it.  Either way less than half of ``left`` remains.  Small calls up to the end and the big
call at the end are admitted, all others up to there are not, and nothing else of the phase matters.  After it
the calls dearer than what is left go.  A budget is halved at least once a phase, so the number of phases is the
binary logarithm of the budget over the smallest cost, whatever the number of calls.

Running sums use balanced ranges (``ordered.running_sum``), so a budget that holds a third of all calls is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .ordered import running_sum

MONEY = "decimal(18,6)"
SUM = "decimal(28,6)"


def greedy(calls: DataFrame, budgets: DataFrame, period: list[str], order: list[str], cost: Column) -> DataFrame:
    """Adds ``admitted`` to the calls; ``budgets`` holds (period…, ``budget``), one row for each period.

    ``order`` is total within a period and has no nulls.  Costs are money of six decimals.  A call without a
    cost, with a negative one, or of a period without a budget (null periods among them) is not admitted.  A free
    call always is, even when nothing is left, unless the budget is negative.
    """
    keys = [*period, *order]
    left = budgets.select(*period, F.col("budget").cast(SUM).alias("_left")).where("_left >= 0")
    rest = calls.select(*keys, cost.cast(MONEY).alias("_cost")).where("_cost >= 0")
    open_calls = rest.join(left, period).where("_cost <= _left")
    # Free calls fit at any time and change nothing.
    won = open_calls.where("_cost = 0").select(*keys)
    open_calls = cut_lineage(open_calls.where("_cost > 0"))
    while not open_calls.isEmpty():
        admitted, open_calls = _phase(open_calls, period, order)
        won = won.unionByName(admitted)
    return calls.join(won.withColumn("admitted", F.lit(True)), keys, "left") \
        .withColumn("admitted", F.coalesce("admitted", F.lit(False)))


def _phase(calls: DataFrame, period: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The calls admitted up to the phase's end, and those behind it that may still fit.

    ``calls`` holds period, order, ``_cost`` and ``_left``, the same for all calls of a period; every cost is
    positive and at most ``_left``.
    """
    small = F.col("_cost") * 2 <= F.col("_left")
    summed = running_sum(calls, period, order, F.when(small, F.col("_cost")).otherwise(F.lit(0).cast(MONEY)), "_sum")
    place = F.struct(*order)
    # At a big call the sum is that of the small calls before it.
    passes = small & (F.col("_sum") * 2 > F.col("_left"))
    fits = ~small & (F.col("_sum") + F.col("_cost") <= F.col("_left"))
    spent = F.col("_sum") + F.when(small, F.lit(0).cast(MONEY)).otherwise(F.col("_cost"))
    ends = summed.where(passes | fits).groupBy(*period).agg(
        F.min(place).alias("_end"), F.min_by(spent.cast(SUM), place).alias("_spent"))
    summed = cut_lineage(summed.join(ends, period, "left").withColumn("_place", place))
    before = F.col("_end").isNull() | (F.col("_place") <= F.col("_end"))
    admitted = summed.where(before & (small | (F.col("_place") == F.col("_end")))).select(*period, *order)
    behind = summed.where(~before).withColumn("_left", (F.col("_left") - F.col("_spent")).cast(SUM))
    return admitted, behind.where("_cost <= _left").select(*period, *order, "_cost", "_left")
