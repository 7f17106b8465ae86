"""Scalar parsing, projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid import vocab
from watchgrid.catalogue.prelude import SENTINELS
from watchgrid.catalogue.registry import query, rounded
from watchgrid.functions import parsing as P
from watchgrid.functions import scalars as S
from watchgrid.operators import features, labels, objects, versions
from watchgrid.sources import journal
from watchgrid.sources import testtables as T


@query("parse_alarm", """
SELECT event_id, alarm_status, CAST(is_alarm AS BIGINT) AS is_alarm FROM clean""")
def parse_alarm(spark, sf):
    words = T.journal(spark, sf).select("event_id", P.word_of("alarm_raw").alias("word"))
    return rounded(words.select(
        "event_id", P.alarm_status("word").alias("alarm_status"), P.alarm_flag("word").alias("is_alarm")))


def values(spark, sf):
    texts = T.journal(spark, sf).select("event_id", P.stripped("sensor_value").alias("value_text"))
    return texts.withColumn("value", P.parse_value("value_text"))


@query("parse_value", "SELECT event_id, value FROM clean")
def parse_value(spark, sf):
    return values(spark, sf).select("event_id", "value")


@query("value_kind", "SELECT kind, count(*) AS \"rows\" FROM clean GROUP BY kind")
def value_kind(spark, sf):
    return values(spark, sf).groupBy(P.value_kind("value_text", "value").alias("kind")).agg(F.count("*").alias("rows"))


@query("value_flags", f"""
SELECT event_id, CAST(coalesce(value < 0, false) AS BIGINT) AS is_negative,
 CAST(coalesce(value IN ({SENTINELS}), false) AS BIGINT) AS is_sentinel FROM clean""")
def value_flags(spark, sf):
    return rounded(values(spark, sf).select(
        "event_id", P.is_negative("value").alias("is_negative"), P.is_sentinel("value").alias("is_sentinel")))


@query("text_states", "SELECT event_id, " + ", ".join(
    f"CAST(lower(value_text) = '{t}' AS BIGINT) AS {c}" for c, t in vocab.TEXT_STATES.items()) + " FROM clean")
def text_states(spark, sf):
    words = T.journal(spark, sf).select("event_id", P.word_of("sensor_value").alias("word"))
    return rounded(words.select("event_id", *[c.alias(n) for n, c in P.text_state_flags("word").items()]))


@query("parse_datetime", """
SELECT count(*) AS input_rows, CAST(0 AS BIGINT) AS invalid_date, CAST(0 AS BIGINT) AS invalid_time,
 CAST(0 AS BIGINT) AS invalid_datetime_or_channel, CAST(0 AS BIGINT) AS invalid_event_id,
 CAST(sum(CASE WHEN alarm_status = 'invalid' THEN 1 ELSE 0 END) AS BIGINT) AS invalid_alarm,
 CAST(sum(CASE WHEN alarm_status = 'missing' THEN 1 ELSE 0 END) AS BIGINT) AS missing_alarm FROM clean""")
def parse_datetime(spark, sf):
    return journal.invalid_counters(T.journal(spark, sf))


@query("clean_journal", """
SELECT event_id, channel_id, "date", "second", CAST(is_alarm AS BIGINT) AS is_alarm, alarm_status,
 value_text, value, kind FROM clean""")
def clean_journal(spark, sf):
    return rounded(T.clean(spark, sf), 9)


@query("default_unknown", """
SELECT j.event_id, CASE WHEN c.channel_id IS NULL THEN 'Нет в справочнике' ELSE c.engineering_system END AS engineering_system,
 CASE WHEN c.channel_id IS NULL THEN 'Нет в справочнике' WHEN c.object_kind IS NULL THEN 'Не указан' ELSE c.object_kind END AS object_kind,
 CASE WHEN c.channel_id IS NULL THEN 'unknown' WHEN c.parent_id IS NULL THEN 'root' ELSE c.parent_id END AS parent
FROM journal j LEFT JOIN chan_cat c USING (channel_id)""")
def default_unknown(spark, sf):
    known = T.catalog(spark, sf).withColumn("_known", F.lit(True))
    joined = T.journal(spark, sf).select("event_id", "channel_id").join(known, "channel_id", "left")

    def named(c, blank, absent):
        return F.when(F.col("_known"), S.or_default(F.col(c), blank)).otherwise(absent)

    return joined.select(
        "event_id", named("engineering_system", vocab.UNSPECIFIED, vocab.NOT_IN_DICTIONARY).alias("engineering_system"),
        named("object_kind", vocab.UNSPECIFIED, vocab.NOT_IN_DICTIONARY).alias("object_kind"),
        named("parent_id", "root", "unknown").alias("parent"))


@query("safe_ratio", """
SELECT channel_id, "date", round(CASE WHEN events_count = 0 THEN 0 ELSE numeric_count / events_count END, 6) AS numeric_share,
 round(CASE WHEN numeric_count > 0 THEN value_sum / numeric_count END, 6) AS value_mean,
 round(CASE WHEN alarm_count > 0 THEN fault_count / alarm_count END, 6) AS faults_per_alarm FROM cd""")
def safe_ratio(spark, sf):
    return rounded(T.channel_days(spark, sf).select(
        "channel_id", "date", S.ratio(F.col("numeric_count"), F.col("events_count"), 0).alias("numeric_share"),
        S.ratio(F.col("value_sum"), F.col("numeric_count")).alias("value_mean"),
        S.ratio(F.col("fault_count"), F.col("alarm_count")).alias("faults_per_alarm")))


@query("daily_moments", """
SELECT channel_id, "date", round(CASE WHEN numeric_count > 0 THEN value_sum / numeric_count END, 6) AS value_mean_1d,
 round(CASE WHEN numeric_count > 0 THEN sqrt(greatest(value_sumsq / numeric_count
  - (value_sum / numeric_count) * (value_sum / numeric_count), 0)) END, 4) AS value_std_1d,
 round(value_max - value_min, 6) AS value_range_1d FROM cd""")
def daily_moments(spark, sf):
    rates = S.daily_rates()
    return rounded(T.channel_days(spark, sf).select(
        "channel_id", "date", rates["value_mean_1d"].alias("value_mean_1d"),
        F.round(rates["value_std_1d"], 4).alias("value_std_1d"), rates["value_range_1d"].alias("value_range_1d")))


@query("calendar_features", """
SELECT channel_id, "date", year("date") AS "year", month("date") AS "month", isodow("date") - 1 AS dayofweek,
 CAST(isodow("date") >= 6 AS BIGINT) AS is_weekend,
 round(sin(2 * pi() * dayofyear("date") / 365.25), 6) AS annual_sin,
 round(cos(2 * pi() * dayofyear("date") / 365.25), 6) AS annual_cos,
 isodow("date" + 2) - 1 AS target_dayofweek,
 round(sin(2 * pi() * (isodow("date" + 2) - 1) / 7), 6) + 0.0 AS target_week_sin,
 round(cos(2 * pi() * (isodow("date" + 2) - 1) / 7), 6) + 0.0 AS target_week_cos,
 round(sin(2 * pi() * (dayofyear("date" + 2) - 1) / 365.25), 6) AS target_year_sin,
 round(cos(2 * pi() * (dayofyear("date" + 2) - 1) / 365.25), 6) AS target_year_cos
FROM lh""")
def calendar_features(spark, sf):
    parts = S.calendar(F.col("date"))
    return rounded(T.long_history(spark, sf).select("channel_id", "date", *[c.alias(n) for n, c in parts.items()]))


@query("chrono_split", """
SELECT channel_id, "date", CASE WHEN "date" <= DATE '2024-01-13' THEN 'train'
 WHEN "date" > DATE '2024-01-15' AND "date" <= DATE '2024-01-20' THEN 'valid'
 WHEN "date" > DATE '2024-01-22' THEN 'test' END AS split FROM cd""")
def chrono_split(spark, sf):
    split = labels.chrono_split(F.col("date"), T.day("2024-01-15"), T.day("2024-01-22"), embargo=2)
    return T.channel_days(spark, sf).select("channel_id", "date", split.alias("split"))


@query("log_compress", """
SELECT channel_id, "date", round(ln(1 + events_count), 6) AS log_events,
 round(sign(value_sum) * ln(1 + abs(value_sum)), 6) AS signed_log_value_sum FROM cd""")
def log_compress(spark, sf):
    return rounded(T.channel_days(spark, sf).select(
        "channel_id", "date", S.log_count(F.col("events_count")).alias("log_events"),
        S.signed_log(F.col("value_sum")).alias("signed_log_value_sum")))


_ALLOWED = [
    *vocab.MODEL_COUNTERS, "observed_channels", "alarm_channels", "fault_channels", "no_power_channels", "catalog_channels",
    "alarm_today", "observed_today", "observed_fraction", "historical_alarm_frequency", "alarm_streak", "days_since_alarm",
    "target_dayofweek", "annual_sin", "annual_cos", *[f"{c}_mean{k}" for c in vocab.OBJECT_SIGNALS for k in (3, 7, 28)]]


# Only lags and the share among observed channels can be unknown.
@query("feature_allowlist", " UNION ALL ".join(
    [f"SELECT '{c}' AS feature, count(*) AS known_rows FROM od" for c in _ALLOWED]
    + ["SELECT 'alarm_channel_fraction', count(*) FROM od WHERE observed_channels > 0"]
    + [f"SELECT '{c}_lag{n}', count(*) FROM od WHERE i >= {n}" for c in vocab.OBJECT_SIGNALS for n in (1, 2, 7, 14)]))
def feature_allowlist(spark, sf):
    mart = objects.with_signals(T.object_mart(spark, sf))
    names = features.feature_columns(
        labels.label_onset(mart).schema, keys=["object_id", "date"],
        categorical=["object_kind", "parent_id"],
        labels=["quiet_intermediate", "alarm_target", "onset_target", "joint_target",
                "records_intermediate", "records_target"])
    numeric = [n for n in names if n not in ("object_kind", "parent_id")]
    # Coverage of each allowed feature over the whole mart, one aggregation.
    return mart.agg(*[F.count(c).alias(c) for c in numeric]).unpivot([], numeric, "feature", "known_rows")


@query("sanitize_numeric", """
SELECT channel_id, "date", coalesce(round(value_min, 6), -999999) AS value_min,
 coalesce(round(CASE WHEN alarm_count > 0 THEN events_count / alarm_count END, 6), -999999) AS events_per_alarm,
 coalesce(CAST(CASE WHEN fault_count > 0 THEN fault_count END AS VARCHAR), 'None') AS fault_text FROM cd""")
def sanitize_numeric(spark, sf):
    rows = T.channel_days(spark, sf)
    infinite = F.when(F.col("alarm_count") > 0, F.col("events_count") / F.col("alarm_count")).otherwise(float("inf"))
    shown = rows.select("channel_id", "date", "value_min", infinite.alias("events_per_alarm"),
                        F.when(F.col("fault_count") > 0, F.col("fault_count")).alias("fault_text"))
    return rounded(features.sanitize(shown, numeric=["value_min", "events_per_alarm"], categorical=["fault_text"]))


@query("cohort_masks", """
SELECT cohort, count(*) AS "rows", CAST(sum(alarm_today) AS BIGINT) AS alarms FROM (
 SELECT 'all' AS cohort, alarm_today FROM od
 UNION ALL SELECT 'no_alarm_today', alarm_today FROM od WHERE alarm_today = 0
 UNION ALL SELECT 'observed_today', alarm_today FROM od WHERE observed_today = 1) GROUP BY cohort""")
def cohort_masks(spark, sf):
    return labels.cohorts(T.object_mart(spark, sf)).groupBy("cohort").agg(
        F.count("*").alias("rows"), F.sum("alarm_today").alias("alarms"))


@query("forecast_window", """
SELECT DISTINCT "date", strftime("date" + INTERVAL 1 DAY - INTERVAL 1 SECOND - INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS feature_cutoff,
 strftime("date" + INTERVAL 1 DAY - INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS issue_time,
 strftime("date" + INTERVAL 2 DAY - INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS forecast_start,
 strftime("date" + INTERVAL 3 DAY - INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS forecast_end,
 24.0 AS minimum_lead_hours, 24.0 AS window_hours FROM cd""")
def forecast_window(spark, sf):
    parts = versions.forecast_window(F.col("date"))
    days = T.channel_days(spark, sf).select("date").distinct()
    shown = {n: c if n.endswith("hours") else F.date_format(c, "yyyy-MM-dd HH:mm:ss") for n, c in parts.items()}
    return days.select("date", *[c.alias(n) for n, c in shown.items()])


@query("causal_design", """
SELECT object_id, "date", round(ln(1 + events_count), 6) AS events_count,
 CAST(alarm_today AS DOUBLE) AS alarm_today, round(ln(1 + catalog_channels), 6) AS catalog_channels,
 CAST(max(alarm_today) OVER (PARTITION BY object_id ORDER BY "date") = 0 AS BIGINT) AS never_registered_alarm,
 round(ln(1 + coalesce(lag(alarm_channels, 7) OVER (PARTITION BY object_id ORDER BY "date"), NULL)), 6) AS alarm_channels_lag7,
 round(sin(2 * pi() * (isodow("date" + 2) - 1) / 7), 6) + 0.0 AS target_week_sin
FROM od""")
def causal_design(spark, sf):
    design = objects.causal_design(objects.with_signals(T.object_mart(spark, sf)))
    return rounded(design.select("object_id", "date", "events_count", "alarm_today", "catalog_channels",
                                 "never_registered_alarm", "alarm_channels_lag7", "target_week_sin"))
