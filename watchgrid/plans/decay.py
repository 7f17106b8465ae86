"""Exponentially decayed running sums as ordinary window aggregates.

``state_i = ratio * state_(i-1) + x_i`` equals
``ratio^i * sum_(j<=i) x_j * ratio^-j``, a running sum.  The factors grow with
the history, so the index is cut into blocks short enough for doubles and each
block starts from the last state of the previous one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SAFE_EXPONENT = 460.0          # e^460 is about 1e200
LONGEST_CALENDAR = 40 * 366     # days


def block_length(ratio: float) -> int:
    return max(1, int(_SAFE_EXPONENT / -math.log(ratio)))


def decayed_sum(x: Column, ratio: float, index: Column, window) -> Column:
    """Decayed running sum for an index that stays inside one block.

    Checked for 40 years of daily rows; use ``with_decayed_sums`` beyond that.
    """
    if block_length(ratio) < LONGEST_CALENDAR:
        raise ValueError("ratio decays too fast for one block, use with_decayed_sums")
    total = F.sum(x.cast("double") * F.pow(F.lit(ratio), -index)).over(window)
    return F.pow(F.lit(ratio), index) * total


def with_decayed_sums(
    df: DataFrame,
    key: str,
    order: str,
    index: str,
    specs: dict[str, tuple[Column, float]],
) -> DataFrame:
    """Add decayed running sums ``name -> (x, ratio)`` for any history length.

    ``index`` counts 0, 1, 2, ... per key (it may stay constant between
    events).  All specs share one block length, set by the fastest decay; the
    slowest must still forget a whole block (checked).
    """
    ratios = [r for _, r in specs.values()]
    size = min(block_length(r) for r in ratios)
    if max(ratios) ** size > 1e-30:
        raise ValueError("decay rates are too different for one block length")
    position = F.col(index) % size
    in_block = (Window.partitionBy(key, "_block").orderBy(order)
                .rowsBetween(Window.unboundedPreceding, 0))
    before = (Window.partitionBy(key).orderBy(order)
              .rowsBetween(Window.unboundedPreceding, -1))
    columns = df.columns
    df = df.withColumn("_block", F.floor(F.col(index) / size))
    df = df.select("*", *[
        (F.pow(F.lit(r), position)
         * F.sum(x.cast("double") * F.pow(F.lit(r), -position)).over(in_block)).alias(f"_local_{name}")
        for name, (x, r) in specs.items()])
    closed = position == size - 1
    df = df.select("*", *[
        F.last(F.when(closed, F.struct("_block", F.col(f"_local_{name}").alias("v"))), ignorenulls=True)
        .over(before).alias(f"_carry_{name}")
        for name in specs])

    def state(name: str, r: float) -> Column:
        carry = F.col(f"_carry_{name}")
        carried = F.when(carry["_block"] == F.col("_block") - 1, carry["v"])
        return (F.col(f"_local_{name}")
                + F.coalesce(carried * F.pow(F.lit(r), position + 1), F.lit(0.0))).alias(name)

    return df.select(*columns, *[state(name, r) for name, (_, r) in specs.items()])
