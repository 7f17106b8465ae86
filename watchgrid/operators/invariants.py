"""Causality checks: later records must not change earlier rows.

Each builds a table twice and compares the results cell by cell; every counter
of the comparison must be zero.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchgrid.operators.joins import reconcile

Build = Callable[[DataFrame], DataFrame]


def _compare(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str], cut: Column) -> DataFrame:
    known = F.col("date") <= cut
    return reconcile(before.where(known), after.where(known), keys, columns)


def check_prefix(build: Build, raw: DataFrame, keys: list[str], columns: list[str], cut: Column) -> DataFrame:
    """Features from the history up to ``cut`` against those from all of it."""
    return _compare(build(raw), build(raw.where(F.col("date") <= cut)), keys, columns, cut)


def check_mutation(build: Build, raw: DataFrame, keys: list[str], columns: list[str], counters: list[str], cut: Column) -> DataFrame:
    """Features from a history whose later counters were all changed."""
    changed = raw.withColumns({c: F.when(F.col("date") > cut, F.col(c) * 2 + 3).otherwise(F.col(c)) for c in counters})
    return _compare(build(raw), build(changed), keys, columns, cut)


def check_label_free(score: Build, frame: DataFrame, keys: list[str], column: str, outcomes: list[str]) -> DataFrame:
    """Scores with and without the outcome columns in the input."""
    return reconcile(score(frame), score(frame.drop(*outcomes)), keys, [column])


def check_nesting(labels: DataFrame) -> DataFrame:
    """Starts after longer gaps that are not starts after shorter ones."""
    wide = labels.groupBy("object_id", "date").agg(*[
        F.max(F.when(F.col("gap") == g, F.col("episode_start"))).alias(f"s{g}") for g in (1, 3, 7)])
    return wide.agg(
        F.count_if(F.col("s1") == 1).alias("starts_1"), F.count_if(F.col("s3") == 1).alias("starts_3"),
        F.count_if(F.col("s7") == 1).alias("starts_7"),
        F.count_if((F.col("s7") == 1) & ~F.coalesce(F.col("s3") == 1, F.lit(False))).alias("broken_7_in_3"),
        F.count_if((F.col("s3") == 1) & ~F.coalesce(F.col("s1") == 1, F.lit(False))).alias("broken_3_in_1"))
