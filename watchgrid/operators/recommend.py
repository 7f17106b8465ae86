"""Deterministic review suggestions from card facts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchgrid import vocab

COUNTS = ["observed_channels", "catalog_channels", "events_today", "alarm_channels", "alarm_days_7d", "observed_days_7d"]
FLAGS = ["current_alarm", "warning"]


def _error(condition: Column, field: str, code: str) -> Column:
    return F.when(condition, F.struct(F.lit(field).alias("field"), F.lit(code).alias("code")))


def fact_errors() -> Column:
    """Errors of one card as an array of (field, code); empty when consistent.

    Presence and range come first; relations between facts are only checked
    when every fact is usable on its own.
    """
    c = F.col
    single = []
    for f in sorted(COUNTS + FLAGS):
        single.append(_error(c(f).isNull(), f, "missing"))
        if f in COUNTS:
            single.append(_error(c(f) < 0, f, "expected_nonnegative_integer"))
        if f.endswith("_7d"):
            single.append(_error(c(f) > 7, f, "outside_seven_day_window"))
    single.append(_error(c("rank") < 1, "rank", "expected_positive_integer"))
    alarm, observed = c("current_alarm"), c("observed_channels")
    relations = [
        _error(observed > c("catalog_channels"), "observed_channels", "exceeds_catalog_channels"),
        _error(c("alarm_channels") > observed, "alarm_channels", "exceeds_observed_channels"),
        _error(c("events_today") < observed, "events_today", "fewer_events_than_observed_channels"),
        _error((c("events_today") > 0) != (observed > 0), "events_today", "inconsistent_with_observed_channels"),
        _error(alarm != (c("alarm_channels") > 0), "current_alarm", "inconsistent_with_alarm_channels"),
        _error(c("alarm_days_7d") > c("observed_days_7d"), "alarm_days_7d", "exceeds_observed_days"),
        _error(alarm & (c("alarm_days_7d") == 0), "alarm_days_7d", "omits_current_alarm_day"),
        _error((observed > 0) & (c("observed_days_7d") == 0), "observed_days_7d", "omits_current_observed_day"),
        _error((observed == 0) & (c("observed_days_7d") == 7), "observed_days_7d", "includes_unobserved_current_day"),
        _error(~alarm & (c("alarm_days_7d") == 7), "alarm_days_7d", "includes_unalarmed_current_day"),
    ]
    own, related = (F.array_compact(F.array(*e)) for e in (single, relations))
    return F.when(F.size(own) > 0, own).otherwise(related)


def check_facts(cards: DataFrame) -> DataFrame:
    """Add ``validation_errors`` and ``status``; flags must be boolean."""
    checked = cards.withColumn("validation_errors", fact_errors())
    return checked.withColumn(
        "status", F.when(F.size("validation_errors") > 0, "insufficient_data").otherwise("ok"))


def _step(rule: str) -> Column:
    fields, text = vocab.REVIEW_RULES[rule]
    parts = []
    for piece in re.split(r"(\{\w+\})", text):
        parts.append(F.col(piece[1:-1]).cast("string") if piece.startswith("{") else F.lit(piece))
    return F.struct(F.lit(rule).alias("rule_id"), F.concat(*parts).alias("text"),
                    F.array(*[F.lit(f) for f in fields]).alias("evidence_fields"))


def recommend(cards: DataFrame) -> DataFrame:
    """Up to three review steps per card; none when the facts are unusable."""
    c = F.col
    specific = F.array_compact(F.array(
        F.when(c("observed_channels") < c("catalog_channels"), _step("PARTIAL_CATALOG_RECORDS")),
        F.when(c("current_alarm"), _step("ALARM_RECORDED_TODAY")),
        F.when(c("alarm_days_7d") >= 2, _step("MULTIPLE_ALARM_DAYS"))))
    general = F.array(F.when(c("warning"), _step("SELECTED_FOR_REVIEW")).otherwise(_step("OUTSIDE_WARNING_POLICY")))
    checked = check_facts(cards).withColumn("_specific", specific)
    steps = (F.when(c("observed_channels") == 0, F.array(_step("NO_RECORDS_TODAY")))
             .when(F.size("_specific") > 0, F.slice("_specific", 1, 3)).otherwise(general))
    return checked.withColumn(
        "steps", F.when(c("status") == "ok", steps)).drop("_specific").withColumn(
        "rule_ids", F.transform("steps", lambda s: s["rule_id"]))
