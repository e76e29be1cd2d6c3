"""Running sums, maxima and minima along an order, by slices: a key with most of the rows is many tasks, not one.

Each slice of a key's order is a window of its own; what comes before a slice follows from one
row a slice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of the order in one slice. Where each row has a step of its own, so many rows at most.
SLICE = 100_000


def running(rows: DataFrame, key: list[str], order: str, value: Column, how: Callable, name: str, steps: float = SLICE) -> DataFrame:
    """``rows`` with ``name``: ``how`` (F.sum, F.max or F.min) of ``value`` over all rows of the key up to and with the row's order.

    Rows of equal order are taken in together. Nulls count as nothing. A null key is a key.
    """
    mine, own, before = f"{name}_slice_", f"{name}_own_", f"{name}_before_"
    cut = rows.withColumn(mine, F.floor(F.col(order) / F.lit(steps))).withColumn(own, value)
    each = cut.groupBy(*key, mine).agg(how(own).alias(before))
    earlier = Window.partitionBy(*key).orderBy(mine).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn(before, how(before).over(earlier))
    within = Window.partitionBy(*key, mine).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut = cut.withColumn(own, how(own).over(within))
    same = [cut[c].eqNullSafe(each[c]) for c in (*key, mine)]
    joined = cut.join(each, same, "left").select(*[cut[c] for c in rows.columns], cut[own], each[before])
    both = {F.sum: lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), F.max: F.greatest, F.min: F.least}[how]
    return joined.select(*rows.columns, both(F.col(own), F.col(before)).alias(name))


#: Rows of one slice where a window looks back over rows, and windows of one slice where it looks back in time.
SLICE_ROWS, SLICE_WINDOWS = 20_000, 48


def by_rows(rows: DataFrame, key: list[str], order: str, back: int, slice_rows: int = SLICE_ROWS) -> tuple[DataFrame, Column, list[str]]:
    """(rows, own, partition): ``rows`` dealt into slices of equal length along ``order``, each with the ``back`` rows before it.

    A window over ``partition`` by ``order`` that looks back at most so many rows sees the same
    as one over the whole key; then keep the rows that are the slice's ``own``.
    """
    placed = running(rows, key, order, F.lit(1), F.sum, "place_", SLICE)
    mine = F.floor((F.col("place_") - 1) / slice_rows)
    last = (F.col("place_") - 1) % slice_rows >= slice_rows - back
    dealt = placed.withColumn("of_", F.explode(F.when(last, F.array(mine, mine + 1)).otherwise(F.array(mine)))).withColumn("mine_", mine == F.col("of_"))
    return dealt, F.col("mine_"), [*key, "of_"]


def by_time(rows: DataFrame, key: list[str], time: str, back: float, windows: int = SLICE_WINDOWS) -> tuple[DataFrame, Column, list[str]]:
    """As ``by_rows``, in stretches of time, each with the rows of the time ``back`` before it. No shuffle of its own."""
    width = back * windows
    mine = F.floor(F.col(time) / width)
    last = F.col(time) >= (mine + 1) * width - back
    dealt = rows.withColumn("of_", F.explode(F.when(last, F.array(mine, mine + 1)).otherwise(F.array(mine)))).withColumn("mine_", mine == F.col("of_"))
    return dealt, F.col("mine_"), [*key, "of_"]
