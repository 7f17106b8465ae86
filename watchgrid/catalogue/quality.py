"""Data-quality constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid import vocab
from watchgrid.catalogue.registry import query, rounded
from watchgrid.catalogue.scan import CONTEXT_SQL, context_documents
from watchgrid.operators import quality as Q
from watchgrid.sources import testtables as T
from watchgrid.sources import weather


@query("check_unique", """
SELECT user_id AS channel_id, CAST(ts AS DATE) AS "date", count(*) AS copies FROM events GROUP BY ALL HAVING count(*) > 1""")
def check_unique(spark, sf):
    rows = T.table(spark, sf, "events").select(F.col("user_id").alias("channel_id"), F.to_date("ts").alias("date"))
    return Q.check_unique(rows, ["channel_id", "date"])


@query("check_daily_rules", """
SELECT count(*) AS "rows", CAST(0 AS BIGINT) AS missing_keys, CAST(0 AS BIGINT) AS outside_year,
 CAST(0 AS BIGINT) AS repeated_keys, CAST(0 AS BIGINT) AS bad_counters,
 CAST(sum(CASE WHEN alarm_count * 2 > events_count THEN 1 ELSE 0 END) AS BIGINT) AS component_above_events,
 CAST(0 AS BIGINT) AS kinds_do_not_add_up FROM cd""")
def check_daily_rules(spark, sf):
    # Alarm counters delivered twice as high break one rule on some rows.
    daily = T.channel_days(spark, sf).withColumn("alarm_count", F.col("alarm_count") * 2)
    return Q.check_daily(daily, 2024, vocab.DAILY_COUNTERS)


@query("check_calendar", """
SELECT channel_id, count(*) AS "rows", count(*) AS days, min("date") AS first_day, max("date") AS last_day
FROM cd GROUP BY channel_id
HAVING count(*) <> 30 OR min("date") <> DATE '2024-01-01' OR max("date") <> DATE '2024-01-30'""")
def check_calendar(spark, sf):
    return Q.check_calendar(T.channel_days(spark, sf), "channel_id", *[T.day(d) for d in T.CALENDAR])


@query("check_calendar_gaps", """
SELECT * FROM (SELECT channel_id, "date",
 CAST("date" - lag("date") OVER (PARTITION BY channel_id ORDER BY "date") AS BIGINT) AS step FROM cd) WHERE step <> 1""")
def check_calendar_gaps(spark, sf):
    return rounded(Q.check_gaps(T.channel_days(spark, sf), "channel_id"))


@query("check_window_inputs", """
SELECT (SELECT count(*) FROM objects) AS wanted_objects, CAST(0 AS BIGINT) AS repeated_objects,
 (SELECT count(*) FROM objects WHERE object_id NOT IN (SELECT object_id FROM channels)) AS objects_without_channels,
 (SELECT count(*) FROM cd WHERE "date" > DATE '2024-01-25') AS days_outside_calendar, CAST(0 AS BIGINT) AS missing_keys""")
def check_window_inputs(spark, sf):
    return Q.check_population(T.channel_days(spark, sf), T.channels(spark, sf), T.objects(spark, sf),
                              T.day("2024-01-01"), T.day("2024-01-25"))


@query("check_labels", """
SELECT CAST(sum(n) AS BIGINT) AS "rows", count(*) AS days, CAST(0 AS BIGINT) AS blank_objects,
 CAST(sum(bad) AS BIGINT) AS bad_labels, CAST(0 AS BIGINT) AS onset_without_alarm, CAST(0 AS BIGINT) AS bad_scores,
 CAST(sum(CASE WHEN n < 10 THEN 1 ELSE 0 END) AS BIGINT) AS days_below_k, CAST(0 AS BIGINT) AS repeated_keys
FROM (SELECT "date", count(*) AS n, sum(CASE WHEN onset_target IS NULL THEN 1 ELSE 0 END) AS bad FROM ol GROUP BY 1)""")
def check_labels(spark, sf):
    # The last two days have no labels yet and must be reported.
    frame = T.labelled(spark, sf).withColumn("score", F.col("alarm_today").cast("double"))
    return Q.check_labels(frame, "score", 10)


@query("validate_weather", f"""
SELECT event_type, count(*) AS days, CAST(0 AS BIGINT) AS temperature_order, CAST(0 AS BIGINT) AS negative_precipitation,
 CAST(sum(CASE WHEN humidity > 100 OR humidity < 0 THEN 1 ELSE 0 END) AS BIGINT) AS humidity_range,
 CAST(sum(CASE WHEN pressure <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS pressure_range, CAST(0 AS BIGINT) AS missing_values,
 CAST(max(source_date) - min(source_date) + 1 - count(*) AS BIGINT) AS missing_days
FROM ({CONTEXT_SQL}) GROUP BY event_type""")
def validate_weather(spark, sf):
    days = weather.unzip_daily_json(context_documents(spark, sf), keys=["event_type"])
    return rounded(weather.weather_violations(days, ["event_type"]))


@query("metadata_ambiguity", """
SELECT object_id, sensor_type, count(DISTINCT engineering_system) AS labels,
 min(engineering_system) AS first_label, max(engineering_system) AS last_label
FROM channels GROUP BY ALL HAVING count(DISTINCT engineering_system) > 1""")
def metadata_ambiguity(spark, sf):
    return Q.ambiguous_keys(T.channels(spark, sf), ["object_id", "sensor_type"], "engineering_system")
