"""Set operations on tables and keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def union_years(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def channel_universe(daily: DataFrame, catalog: DataFrame) -> DataFrame:
    # Distinct before the union: the log side shrinks to its channels first.
    return (daily.select("channel_id").distinct()
            .union(catalog.select("channel_id").distinct()).distinct())


def key_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


def key_intersection(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_semi")


def calendar_days(spark: SparkSession, start: Column, end: Column) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(start, end)).alias("day"))


def missing_days(delivered: DataFrame, start: Column, end: Column) -> DataFrame:
    """Calendar days without a delivered batch."""
    return calendar_days(delivered.sparkSession, start, end).join(
        delivered.select("day").distinct(), "day", "left_anti")


def decision_journal(logs: dict[str, DataFrame], newest: int = 200, mode: str | None = None) -> DataFrame:
    """Newest entries of several logs with a kind tag, newest first overall.

    Each log: (id, created_at, mode, text).  Every branch is cut to its newest
    rows before the union, so only a bounded set is sorted together.
    """
    parts = []
    for kind, df in logs.items():
        rows = df if mode is None else df.where(F.col("mode") == mode)
        parts.append(rows.select(F.lit(kind).alias("kind"), "id", "created_at", "mode", "text")
                     .orderBy(F.desc("created_at"), F.desc("id")).limit(newest))
    return union_years(*parts).orderBy(F.desc("created_at"), F.desc("id"), "kind").limit(newest)
