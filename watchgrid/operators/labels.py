"""Splits, cohorts and labels by exact calendar lead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_entity(key: str):
    return Window.partitionBy(key).orderBy("date")


def chrono_split(date: Column, train_end: Column, valid_end: Column, embargo: int = 0) -> Column:
    """'train', 'valid' or 'test'; NULL where the label would cross a bound."""
    return (F.when(date <= F.date_sub(train_end, embargo), "train")
            .when((date > train_end) & (date <= F.date_sub(valid_end, embargo)), "valid")
            .when(date > valid_end, "test"))


def cohorts(frame: DataFrame) -> DataFrame:
    """Each row once per cohort it belongs to."""
    member = F.array_compact(F.array(
        F.lit("all"), F.when(F.col("alarm_today") == 0, F.lit("no_alarm_today")),
        F.when(F.col("observed_today") == 1, F.lit("observed_today"))))
    return frame.withColumn("cohort", F.explode(member))


def exact_lead(value: Column, days: int, key: str) -> Column:
    """Value of the exact date ``days`` later, NULL when that day is absent."""
    order = per_entity(key)
    ahead = F.lead("date", days).over(order)
    return F.when(ahead == F.date_add("date", days), F.lead(value, days).over(order))


def label_next_day(grid: DataFrame, last_day: Column) -> DataFrame:
    """Channel alarm on the next day; the last day has no outcome and is dropped."""
    alarmed = (F.col("alarm_count") > 0).cast("int")
    labelled = grid.withColumn("target", F.coalesce(exact_lead(alarmed, 1, "channel_id"), F.lit(0)))
    return labelled.where(F.col("date") < last_day)


def label_lead(df: DataFrame, key: str, alarm: Column, days: int = 2) -> DataFrame:
    """Alarm on the exact day D+2; NULL for the last days."""
    return df.withColumn("target", exact_lead(alarm, days, key))


def label_observed(grid: DataFrame) -> DataFrame:
    """Any record on the next day."""
    seen = (F.col("events_count") > 0).cast("int")
    return grid.withColumn("observed_tomorrow", exact_lead(seen, 1, "channel_id"))


def label_onset(mart: DataFrame) -> DataFrame:
    """Quiet D+1 followed by an alarm on D+2, with the joint class of both days."""
    one = exact_lead(F.col("alarm_today"), 1, "object_id")
    two = exact_lead(F.col("alarm_today"), 2, "object_id")
    records1 = exact_lead(F.col("observed_today"), 1, "object_id")
    records2 = exact_lead(F.col("observed_today"), 2, "object_id")
    known = two.isNotNull() & one.isNotNull()
    return mart.select(
        "*",
        F.when(known, (one == 0).cast("int")).alias("quiet_intermediate"),
        F.when(known, two).alias("alarm_target"),
        F.when(known, ((one == 0) & (two == 1)).cast("int")).alias("onset_target"),
        F.when(known, 2 * one + two).alias("joint_target"),
        F.when(known, records1).alias("records_intermediate"),
        F.when(known, records2).alias("records_target"))
