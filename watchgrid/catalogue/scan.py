"""Sources, scans and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid import vocab
from watchgrid.catalogue.registry import query, rounded
from watchgrid.operators import aggregate as A
from watchgrid.operators.sets import union_years
from watchgrid.session import shared_folder
from watchgrid.sources import catalogs, daily, journal, weather
from watchgrid.sources import testtables as T


@query("scan_journal", """
SELECT event_id, channel_id, "date", "time", nullif(alarm_raw, '') AS alarm_raw, nullif(sensor_value, '') AS sensor_value
FROM journal""")
def scan_journal(spark, sf):
    path = shared_folder(spark, "journal-csv")
    (T.journal(spark, sf).write.option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return journal.read_journal(spark, path).select(*vocab.JOURNAL_COLUMNS)


@query("malformed_rows", """
SELECT count(*) AS "rows", CAST(sum(CASE WHEN sensor_value = '' THEN 1 ELSE 0 END) AS BIGINT) AS malformed_rows
FROM journal""")
def malformed_rows(spark, sf):
    # Records without a value are exported without their last field.
    path = shared_folder(spark, "journal-text")
    fields = F.concat_ws(",", "event_id", "channel_id", "date", "time", "alarm_raw")
    quoted = F.concat(F.lit(',"'), "sensor_value", F.lit('"'))
    line = F.concat(fields, F.when(F.col("sensor_value") != "", quoted).otherwise(""))
    T.journal(spark, sf).select(line.alias("value")).write.text(path)
    per_file = journal.malformed_rows(spark, path, header=False)
    return per_file.agg(F.sum("rows").alias("rows"), F.sum("malformed_rows").alias("malformed_rows"))


@query("scan_catalogs", """
SELECT c.channel_id, min(c.engineering_system) AS engineering_system, min(sensor_type) AS sensor_type,
 min(object_id) AS object_id, min(object_kind) AS object_kind, min(parent_id) AS parent_id
FROM chan_cat c GROUP BY c.channel_id""")
def scan_catalogs(spark, sf):
    files = {}
    repeated = T.channels(spark, sf).unionByName(T.channels(spark, sf).withColumn("engineering_system", F.lit("ZZZ")))
    for name, df, headers in (("channels", repeated, vocab.CHANNEL_HEADERS),
                              ("objects", T.objects(spark, sf), vocab.OBJECT_HEADERS)):
        files[name] = shared_folder(spark, name)
        back = {v: k for k, v in headers.items()}
        (df.select(*[F.col(v).alias(k) for k, v in headers.items()]).withColumnsRenamed(back)
         .write.option("header", True).csv(files[name]))
    return catalogs.load_catalog(
        catalogs.read_dictionary(spark, files["channels"], vocab.CHANNEL_HEADERS),
        catalogs.read_dictionary(spark, files["objects"], vocab.OBJECT_HEADERS))


@query("scan_daily_range", """
SELECT channel_id, "date", events_count, alarm_count FROM cd
WHERE "date" BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")
def scan_daily_range(spark, sf):
    path = shared_folder(spark, "daily")
    daily.write_daily(T.channel_days(spark, sf), path)
    found = daily.read_daily(spark, path, "2024-01-05", "2024-01-20", ["events_count", "alarm_count"])
    return daily.require_rows(found, "2024-01-05 to 2024-01-20")


@query("rows_by_position", """
SELECT e.event_id AS pos, CAST(e.user_id AS VARCHAR) AS channel_id, CAST(CAST(e.ts AS DATE) + 1 AS DATE) AS "date",
 CAST(cd.channel_id IS NOT NULL AS BIGINT) AS found, cd.events_count
FROM events e LEFT JOIN cd ON cd.channel_id = CAST(e.user_id AS VARCHAR) AND cd."date" = CAST(e.ts AS DATE) + 1
WHERE e.event_type = 'error'""")
def rows_by_position(spark, sf):
    # The day after each error record, in record order; some days do not exist.
    wanted = T.table(spark, sf, "events").where("event_type = 'error'").select(
        F.col("event_id").alias("pos"), F.col("user_id").cast("string").alias("channel_id"),
        F.date_add(F.to_date("ts"), 1).alias("date"))
    facts = T.channel_days(spark, sf).select("channel_id", "date", "events_count")
    return rounded(daily.rows_by_key(facts, wanted, ["channel_id", "date"]).select(
        "pos", "channel_id", "date", "found", "events_count"))


def context_documents(spark, sf):
    """One JSON document per event type with arrays by day, as a weather service sends them."""
    v = F.col("value")
    days = T.table(spark, sf, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("time")).agg(
        F.round(F.avg(v), 3).alias("temperature_mean"), F.min(v).alias("temperature_min"),
        F.max(v).alias("temperature_max"), F.count("*").cast("double").alias("precipitation"),
        F.round(F.avg(F.hour("ts")) * 4, 3).alias("humidity"),
        F.max(F.col("user_id")).cast("double").alias("pressure"),
        F.min(F.minute("ts")).cast("double").alias("wind"))
    rows = F.sort_array(F.collect_list(F.struct("time", *weather.WEATHER_FIELDS)))
    packed = days.groupBy("event_type").agg(rows.alias("r"))
    return packed.select("event_type", F.to_json(F.struct(
        F.col("r.time").alias("time"), *[F.col(f"r.{f}").alias(f) for f in weather.WEATHER_FIELDS])).alias("body"))


CONTEXT_SQL = """
SELECT event_type, CAST(ts AS DATE) AS source_date, round(avg(value), 3) AS temperature_mean,
 min(value) AS temperature_min, max(value) AS temperature_max, CAST(count(*) AS DOUBLE) AS precipitation,
 round(avg(hour(ts)) * 4, 3) AS humidity, CAST(max(user_id) AS DOUBLE) AS pressure,
 CAST(min(minute(ts)) AS DOUBLE) AS wind
FROM events GROUP BY ALL"""


@query("weather_unzip", CONTEXT_SQL)
def weather_unzip(spark, sf):
    return rounded(weather.unzip_daily_json(context_documents(spark, sf), keys=["event_type"]))


@query("sink_parquet_atomic", """
SELECT channel_id, "date", events_count, alarm_count, value_min, CAST(year("date") AS BIGINT) AS "year" FROM cd""")
def sink_parquet_atomic(spark, sf):
    # The second write replaces the year, it does not add to it.
    path = shared_folder(spark, "daily")
    for _ in range(2):
        daily.write_daily(T.channel_days(spark, sf), path)
    return rounded(spark.read.parquet(path).select(
        "channel_id", "date", "events_count", "alarm_count", "value_min", "year"))


@query("sink_summary", """
SELECT 'csv' AS fmt, year("date") AS "year", count(*) AS "rows", CAST(sum(events_count) AS BIGINT) AS records FROM cd GROUP BY 2
UNION ALL
SELECT 'json', year("date"), count(*), CAST(sum(events_count) AS BIGINT) FROM cd GROUP BY 2""")
def sink_summary(spark, sf):
    report = A.history_summary(T.channel_days(spark, sf)).select("year", "rows", "records")
    schema = "year long, rows long, records long"
    parts = []
    for fmt in ("csv", "json"):
        path = shared_folder(spark, f"report-{fmt}")
        daily.write_summary(report, path, fmt)
        back = spark.read.schema(schema).format(fmt).option("header", True).load(path)
        parts.append(back.select(F.lit(fmt).alias("fmt"), "*"))
    return union_years(*parts)


@query("file_inventory", """
SELECT 'events.parquet' AS file_name, 1 AS has_bytes, count(*) AS "rows" FROM events
UNION ALL SELECT 'orders.parquet', 1, count(*) FROM orders
UNION ALL SELECT 'customer.parquet', 1, count(*) FROM customer""")
def file_inventory(spark, sf):
    parts = [daily.file_inventory(spark, f"{sf}/{t}.parquet") for t in ("events", "orders", "customer")]
    return rounded(union_years(*parts).select(
        "file_name", (F.col("file_bytes") > 0).alias("has_bytes"), "rows"))


@query("incremental_cache", """
SELECT channel_id, "date", events_count, alarm_count, fault_count, CASE WHEN day("date") % 7 IN (2, 4) THEN 1 ELSE 0 END AS rebuilt FROM cd""")
def incremental_cache(spark, sf):
    """A cache that misses some days and holds an older state of others becomes the full build."""
    clean = T.clean(spark, sf)
    prints = daily.day_fingerprints(clean)
    turn = F.dayofmonth("date") % 7
    cached = A.channel_daily(clean).where(turn != 2).withColumn(
        "alarm_count", F.when(turn == 4, F.lit(-1)).otherwise(F.col("alarm_count")))
    manifest = prints.where(turn != 2).withColumn("fingerprint", F.when(turn == 4, F.lit("older")).otherwise(F.col("fingerprint")))
    out = daily.refresh_days(clean, cached, manifest, A.channel_daily)
    return rounded(out.select("channel_id", "date", "events_count", "alarm_count", "fault_count", "rebuilt"))
