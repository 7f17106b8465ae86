"""Arithmetic and calendar column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column, fill: float | None = None) -> Column:
    """a / b with NULL (or ``fill``) where b is 0 or NULL."""
    value = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return value if fill is None else F.coalesce(value, F.lit(float(fill)))


def population_std(total: Column, squares: Column, n: Column) -> Column:
    """Standard deviation from additive moments, never below 0; NULL when n = 0."""
    mean = ratio(total, n)
    return F.when(n > 0, F.sqrt(F.greatest(ratio(squares, n) - mean * mean, F.lit(0.0))))


def daily_rates() -> dict[str, Column]:
    """Shares and value moments of one channel-day."""
    events, numeric = F.col("events_count"), F.col("numeric_count")
    return {
        "alarm_rate_1d": ratio(F.col("alarm_count"), events, 0),
        "numeric_share_1d": ratio(numeric, events, 0),
        "text_share_1d": ratio(F.col("text_count"), events, 0),
        "missing_share_1d": ratio(F.col("missing_count"), events, 0),
        "value_mean_1d": ratio(F.col("value_sum"), numeric),
        "value_std_1d": population_std(F.col("value_sum"), F.col("value_sumsq"), numeric),
        "value_range_1d": F.col("value_max") - F.col("value_min"),
    }


def calendar(date: Column, lead: int = 2) -> dict[str, Column]:
    """Calendar parts of a day and of the target day ``lead`` days later."""
    target = F.date_add(date, lead)
    year_angle = F.lit(2 * math.pi) * F.dayofyear(date) / F.lit(365.25)
    target_angle = F.lit(2 * math.pi) * (F.dayofyear(target) - 1) / F.lit(365.25)
    week_angle = F.lit(2 * math.pi) * F.weekday(target) / F.lit(7)
    return {
        "year": F.year(date),
        "month": F.month(date),
        "dayofweek": F.weekday(date),
        "is_weekend": (F.weekday(date) >= 5).cast("int"),
        "annual_sin": F.sin(year_angle),
        "annual_cos": F.cos(year_angle),
        "target_dayofweek": F.weekday(target),
        "target_week_sin": F.sin(week_angle),
        "target_week_cos": F.cos(week_angle),
        "target_year_sin": F.sin(target_angle),
        "target_year_cos": F.cos(target_angle),
    }


def log_count(value: Column) -> Column:
    """log1p of a count, with negative values taken as 0."""
    return F.log1p(F.greatest(value.cast("double"), F.lit(0.0)))


def signed_log(value: Column) -> Column:
    value = value.cast("double")
    return F.signum(value) * F.log1p(F.abs(value))


def or_default(value: Column, default: str) -> Column:
    """Text attribute with a default for NULL and blank."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(default))


def finite(value: Column, fill: float) -> Column:
    """Replace NULL, NaN and infinities by one number."""
    value = value.cast("double")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.lit(float(fill))).otherwise(value)
