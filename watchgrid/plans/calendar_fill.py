"""Complete daily calendars without a grid join.

The usual way is to build every (key, day) pair and left-join the facts.  Here
each fact row itself produces the empty days up to its successor, so the only
exchange is the one by key that every later per-key window reuses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_calendar(
    facts: DataFrame,
    seeds: DataFrame | None,
    key: str,
    start: Column,
    end: Column,
    zero: list[str],
    constant: list[str] = (),
) -> DataFrame:
    """One row per key and day from ``start`` to ``end``.

    ``facts`` holds (key, date, ...) with unique keys, ``seeds`` the keys that
    must appear even without facts.  Columns in ``zero`` become 0 on empty days,
    all others NULL: silence is not a measurement.  Columns in ``constant`` are the same for all facts of a
    key and stay so on its empty days; with ``seeds`` there are none.  ``start`` and ``end`` are
    literals or scalar subqueries.  Facts outside of them, such as those of a
    dirty date, neither appear nor stretch the calendar.
    """
    facts = facts.where((F.col("date") >= start) & (F.col("date") <= end))
    values = [c for c in facts.columns if c not in (key, "date")]
    rows = facts.select(key, "date", F.lit(True).alias("_fact"), *values)
    if seeds is not None:
        empty = [F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in values]
        rows = rows.unionByName(
            seeds.select(key, start.alias("date"), F.lit(False).alias("_fact"), *empty))
    order = Window.partitionBy(key).orderBy("date", "_fact")
    rows = rows.select(
        "*",
        F.row_number().over(order).alias("_n"),
        F.lead("date", 1).over(order).alias("_next"),
    )
    first = F.when(F.col("_n") == 1, start).otherwise(F.col("date"))
    last = F.coalesce(F.date_sub("_next", 1), end)
    days = F.when(first <= last, F.sequence(first, last))
    # A seed shares its day with a real fact of the same key: keep the fact.
    filled = rows.select(key, F.col("date").alias("_own"), "_fact", *values,
                         F.explode(days).alias("date"))
    own = "_fact AND date = _own"
    types = dict(facts.dtypes)

    def on_own_day(c: str) -> Column:
        if c in constant:
            return F.col(c)
        value = f"CASE WHEN {own} THEN {c} END"
        return F.expr(f"coalesce({value}, cast(0 AS {types[c]})) AS {c}" if c in zero else f"{value} AS {c}")

    return filled.select(key, "date", *[on_own_day(c) for c in values])
