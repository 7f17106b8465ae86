"""Data-quality assertions.

Each returns counters or violating rows; an empty result (or zero counters)
means the rule holds.  ``expect_empty`` turns a violation into an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: list[str], what: str = "table") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")
    return df


def expect_empty(violations: DataFrame, what: str) -> None:
    """Raise with a few examples when a rule is broken."""
    examples = violations.take(5)
    if examples:
        raise ValueError(f"{what}: {examples}")


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def check_daily(daily: DataFrame, year: int, counters: list[str]) -> DataFrame:
    """Rule counters of a channel-day table, all from one pass over the rows.

    Repeated keys are found from per-key counts that are combined before the
    shuffle, so every rule shares one aggregation.
    """
    parts = ["numeric_count", "text_count", "missing_count"]
    bounded = ["alarm_count", "numeric_count", "fault_count", "no_power_count"]
    anything = [F.col(c).isNull() | (F.col(c) < 0) for c in counters]
    bad_counter = anything[0]
    for rule in anything[1:]:
        bad_counter = bad_counter | rule
    above = F.lit(False)
    for c in bounded:
        above = above | (F.col(c) > F.col("events_count"))
    per_key = daily.groupBy("channel_id", "date").agg(
        F.count("*").alias("n"),
        F.count_if(bad_counter).alias("bad_counter"),
        F.count_if(above).alias("above"),
        F.count_if(F.col(parts[0]) + F.col(parts[1]) + F.col(parts[2]) != F.col("events_count")).alias("mismatch"))
    return per_key.agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("channel_id").isNull() | F.col("date").isNull(), F.col("n")).otherwise(0))
        .alias("missing_keys"),
        F.sum(F.when(F.year("date") != year, F.col("n")).otherwise(0)).alias("outside_year"),
        F.sum(F.col("n") - 1).alias("repeated_keys"),
        F.sum("bad_counter").alias("bad_counters"),
        F.sum("above").alias("component_above_events"),
        F.sum("mismatch").alias("kinds_do_not_add_up"))


def check_calendar(df: DataFrame, key: str, start: Column, end: Column) -> DataFrame:
    """Keys whose days are not exactly the complete calendar."""
    per_key = df.groupBy(key).agg(
        F.count("*").alias("rows"), F.count_distinct("date").alias("days"),
        F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    whole = F.datediff(end, start) + 1
    fits = ((F.col("rows") == whole) & (F.col("days") == whole)
            & (F.col("first_day") == start) & (F.col("last_day") == end))
    return per_key.where(~fits)


def check_gaps(df: DataFrame, key: str) -> DataFrame:
    """Rows whose previous day is missing, repeated or more than a day away."""
    order = Window.partitionBy(key).orderBy("date")
    step = F.datediff("date", F.lag("date", 1).over(order))
    return df.select(key, "date", step.alias("step")).where("step <> 1")


def check_population(daily: DataFrame, channel_objects: DataFrame, wanted: DataFrame,
                     start: Column, end: Column) -> DataFrame:
    """Counters over a requested object population and its channel-days."""
    asked = wanted.agg(F.count("*").alias("wanted_objects"),
                       (F.count("*") - F.count_distinct("object_id")).alias("repeated_objects"))
    unknown = (wanted.join(channel_objects, "object_id", "left_anti")
               .agg(F.count_distinct("object_id")).scalar())
    dates = daily.agg(F.count_if(~F.col("date").between(start, end))).scalar()
    nulls = daily.agg(F.count_if(F.col("date").isNull() | F.col("channel_id").isNull())).scalar()
    return asked.select("wanted_objects", "repeated_objects",
                        unknown.alias("objects_without_channels"),
                        dates.alias("days_outside_calendar"), nulls.alias("missing_keys"))


def check_labels(frame: DataFrame, score: str, k: int) -> DataFrame:
    """Counters of broken evaluation rules, including days with under k candidates."""
    onset, alarm, value = F.col("onset_target"), F.col("alarm_target"), F.col(score)
    per_day = frame.groupBy("date").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("object_id").isNull() | (F.trim("object_id") == "")).alias("blank"),
        F.count_if(onset.isNull() | ~onset.isin(0, 1) | alarm.isNull() | ~alarm.isin(0, 1)).alias("bad_label"),
        F.count_if(onset > alarm).alias("onset_without_alarm"),
        F.count_if(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))).alias("bad_score"))
    repeated = check_unique(frame, ["object_id", "date"]).agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))).scalar()
    return per_day.agg(
        F.sum("n").alias("rows"), F.count("*").alias("days"), F.sum("blank").alias("blank_objects"),
        F.sum("bad_label").alias("bad_labels"), F.sum("onset_without_alarm").alias("onset_without_alarm"),
        F.sum("bad_score").alias("bad_scores"), F.count_if(F.col("n") < k).alias("days_below_k"),
    ).withColumn("repeated_keys", repeated)


def ambiguous_keys(df: DataFrame, keys: list[str], attribute: str) -> DataFrame:
    """Keys that carry more than one label, with the number and the extremes."""
    labels = df.select(*keys, attribute).distinct().groupBy(*keys).agg(
        F.count(attribute).alias("labels"),
        F.min(attribute).alias("first_label"), F.max(attribute).alias("last_label"))
    return labels.where("labels > 1")
