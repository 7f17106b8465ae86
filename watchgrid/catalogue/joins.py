"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid.catalogue.registry import query, rounded
from watchgrid.catalogue.scan import CONTEXT_SQL, context_documents
from watchgrid.operators import aggregate as A
from watchgrid.operators import joins as J
from watchgrid.operators import sets, versions
from watchgrid.sources import catalogs, weather
from watchgrid.sources import testtables as T


@query("join_catalog", """
SELECT cd.channel_id, cd."date", cd.events_count, coalesce(c.engineering_system, 'Нет в справочнике') AS engineering_system,
 coalesce(c.sensor_type, 'Нет в справочнике') AS sensor_type, coalesce(c.object_id, 'Нет в справочнике') AS object_id,
 coalesce(c.object_kind, 'Нет в справочнике') AS object_kind,
 CASE WHEN c.channel_id IS NULL THEN 'unknown' ELSE coalesce(c.parent_id, 'root') END AS parent
FROM cd LEFT JOIN chan_cat c USING (channel_id)""")
def join_catalog(spark, sf):
    return J.enrich(T.channel_days(spark, sf).select("channel_id", "date", "events_count"), T.catalog(spark, sf))


@query("calendar_grid", """
SELECT channel_id, "date", events_count, alarm_count, round(value_sum, 6) AS value_sum, value_min, value_max FROM grid""")
def calendar_grid(spark, sf):
    dense = J.densify(T.channel_days(spark, sf), T.channels(spark, sf))
    return rounded(dense.select("channel_id", "date", "events_count", "alarm_count", "value_sum", "value_min", "value_max"))


@query("population_filter", """
SELECT CASE WHEN c.object_id IS NULL THEN 'unknown' WHEN o.object_kind IS NULL THEN 'outside' ELSE 'included' END AS population,
 count(*) AS channel_days, count(*) FILTER (alarm_count > 0) AS alarm_channel_days
FROM cd LEFT JOIN channels c USING (channel_id) LEFT JOIN objects o ON o.object_id = c.object_id GROUP BY 1""")
def population_filter(spark, sf):
    wanted = T.objects(spark, sf).where("object_kind is not null")
    return J.population_counts(J.split_population(T.channel_days(spark, sf), T.channels(spark, sf), wanted))


@query("eligible_objects", "SELECT object_id FROM eligible")
def eligible_objects(spark, sf):
    return T.eligible(spark, sf)


PRIOR_SQL = """
SELECT channel_id, count(*) AS old_observed_days, count(*) FILTER (alarm_count > 0) AS old_alarm_days,
 count(*) FILTER (fault_count > 0) AS old_fault_days, count(*) FILTER (no_power_count > 0) AS old_no_power_days,
 CAST(sum(events_count) AS BIGINT) AS old_events, CAST(sum(alarm_count) AS BIGINT) AS old_alarm_events,
 count(DISTINCT year("date")) AS old_years_observed,
 CAST(DATE '2000-01-01' - max("date") AS BIGINT) AS old_last_observed_days,
 coalesce(CAST(DATE '2000-01-01' - max(CASE WHEN alarm_count > 0 THEN "date" END) AS BIGINT), -1) AS old_last_alarm_days,
 round((count(*) FILTER (alarm_count > 0) + 1) / (count(*) + 2), 6) AS old_alarm_days_per_observed_day,
 round(sum(alarm_count) / sum(events_count), 6) AS alarm_event_rate,
 round(count(*) FILTER (alarm_count > 0) / count(*), 6) AS alarm_observed_day_rate,
 round(count(*) FILTER (fault_count > 0) / count(*), 6) AS fault_observed_day_rate,
 round(count(*) FILTER (no_power_count > 0) / count(*), 6) AS no_power_observed_day_rate,
 round(sum(events_count) / count(*), 6) AS events_per_observed_day,
 round(sum(value_sum) / sum(numeric_count), 4) AS numeric_mean,
 round(sqrt(greatest(sum(value_sumsq) / sum(numeric_count) - pow(sum(value_sum) / sum(numeric_count), 2), 0)), 4) AS numeric_std
FROM lh WHERE "date" < DATE '2000-01-01' GROUP BY channel_id"""

LONG_COUNTERS = ["events_count", "alarm_count", "fault_count", "no_power_count", "numeric_count", "value_sum", "value_sumsq"]


def prior(spark, sf):
    cutoff = T.day("2000-01-01")
    old = T.long_history(spark, sf).where(F.col("date") < cutoff)
    p = A.channel_prior(A.year_profile(old, LONG_COUNTERS), cutoff)
    return p.withColumns({c: F.round(c, 4) for c in ("numeric_mean", "numeric_std")})


@query("channel_prior", PRIOR_SQL)
def channel_prior(spark, sf):
    return rounded(prior(spark, sf))


@query("join_prior", f"""
SELECT lg.channel_id, lg."date", p.old_observed_days, p.old_alarm_days_per_observed_day
FROM lg LEFT JOIN ({PRIOR_SQL}) p USING (channel_id) WHERE lg."date" >= DATE '2000-01-01'""")
def join_prior(spark, sf):
    later = T.long_grid(spark, sf).where(F.col("date") >= T.day("2000-01-01"))
    return rounded(J.join_prior(later, prior(spark, sf)).select(
        "channel_id", "date", "old_observed_days", "old_alarm_days_per_observed_day"))


@query("join_intraday", """
SELECT grid.channel_id, grid."date", coalesce(intra_events_last6h, 0) AS intra_events_last6h,
 coalesce(intra_alarm_count_last12h, 0) AS intra_alarm_count_last12h,
 round(coalesce(intra_last_event_minute, -1), 6) AS intra_last_event_minute,
 CAST(coalesce(intra_last_event_is_alarm, -1) AS BIGINT) AS intra_last_event_is_alarm,
 coalesce(intra_last_timestamp_ties, -1) AS intra_last_timestamp_ties
FROM grid LEFT JOIN intra USING (channel_id, "date")""")
def join_intraday(spark, sf):
    days = J.join_intraday(T.channel_days(spark, sf).select("channel_id", "date", "events_count"),
                           A.intraday_daily(T.clean(spark, sf)))
    dense = J.fill_intraday(J.densify(days, T.channels(spark, sf), *[T.day(d) for d in T.CALENDAR]))
    return rounded(dense.select(
        "channel_id", "date", "intra_events_last6h", "intra_alarm_count_last12h", "intra_last_event_minute",
        "intra_last_event_is_alarm", "intra_last_timestamp_ties"))


@query("parent_lookup", """
SELECT o.object_id, o.object_name, o.object_kind, o.parent_id,
 coalesce(p.object_name, 'Группа ' || o.parent_id) AS parent_name
FROM objects o LEFT JOIN objects p ON p.object_id = o.parent_id""")
def parent_lookup(spark, sf):
    return catalogs.with_parent(T.objects(spark, sf))


@query("target_date_join", """
SELECT s.object_id, s."date" AS feature_date, CAST(s."date" + 2 AS DATE) AS target_date, s.blend AS score,
 od.alarm_today AS target_alarm, od.observed_today AS target_has_records, CAST(od.object_id IS NOT NULL AS BIGINT) AS matched,
 CAST(od.alarm_today = s.alarm_target AS BIGINT) AS agrees
FROM wide_scores s LEFT JOIN od ON od.object_id = s.object_id AND od."date" = s."date" + 2""")
def target_date_join(spark, sf):
    forecasts = T.wide_scores(spark, sf).select("object_id", "date", "alarm_target", F.col("blend").alias("score"))
    return rounded(J.join_forecasts(forecasts, T.object_mart(spark, sf)).select(
        "object_id", "feature_date", "target_date", "score", "target_alarm", "target_has_records", "matched", "agrees"))


@query("lagged_context_join", f"""
SELECT e.event_type, e."date", e.n, c.source_date, c.temperature_mean, c.humidity FROM (
 SELECT event_type, CAST(ts AS DATE) AS "date", count(*) AS n FROM events GROUP BY ALL) e
LEFT JOIN ({CONTEXT_SQL}) c ON c.event_type = e.event_type AND c.source_date = e."date" - 7""")
def lagged_context_join(spark, sf):
    facts = T.table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))
    days = weather.unzip_daily_json(context_documents(spark, sf), keys=["event_type"])
    return rounded(J.join_lagged(facts, days, 7, ["event_type"]).select(
        "event_type", "date", "n", "source_date", "temperature_mean", "humidity"))


BATCH_COLUMNS = ["channel_id", "date", "events_count", "alarm_count"]
SEED_END = "2024-01-03"


def batches(spark, sf, columns=BATCH_COLUMNS, days=None):
    """Daily deliveries after the bootstrap: original, exact repeat, late correction of every fifth day."""
    rows = (T.channel_days(spark, sf) if days is None else days).select(*columns, F.col("date").alias("day"))
    others = [c for c in columns if c != "alarm_count"]
    published = versions.issue_time(F.col("day"))
    kinds = F.explode(F.filter(
        F.array(F.struct(F.lit("a").alias("batch_id"), F.lit(0).alias("hours"), F.lit(0).alias("extra")),
                F.struct(F.lit("b").alias("batch_id"), F.lit(0).alias("hours"), F.lit(0).alias("extra")),
                F.struct(F.lit("c").alias("batch_id"), F.lit(12).alias("hours"), F.lit(3).alias("extra"))),
        lambda k: (k["hours"] == 0) | (F.dayofmonth("day") % 5 == 0)))
    return rows.where(F.col("day") > T.day(SEED_END)).select("*", kinds.alias("k")).select(
        *others, (F.col("alarm_count") + F.col("k.extra")).alias("alarm_count"), "day",
        (published + F.make_dt_interval(hours=F.col("k.hours"))).alias("available_at"),
        F.col("k.batch_id").alias("batch_id"))


@query("asof_versions", """
SELECT channel_id, "date", events_count, alarm_count + CASE WHEN "date" > DATE '2024-01-03' AND day("date") % 5 = 0
  AND "date" < DATE '2024-01-20' THEN 3 ELSE 0 END AS alarm_count
FROM cd WHERE "date" <= DATE '2024-01-20'""")
def asof_versions(spark, sf):
    seed = T.channel_days(spark, sf).where(F.col("date") <= T.day(SEED_END))
    return versions.assemble_history(seed, batches(spark, sf), T.day("2024-01-20")).select(*BATCH_COLUMNS)


@query("asof_problems", """
SELECT 'missing day' AS problem, CAST(d AS DATE) AS "day"
FROM (SELECT unnest(generate_series(DATE '2024-01-04', DATE '2024-01-20', INTERVAL 1 DAY)) AS d)
WHERE CAST(d AS DATE) NOT IN (SELECT "date" FROM cd WHERE alarm_count > 0 OR "date" <= DATE '2024-01-18')
UNION ALL SELECT DISTINCT 'conflicting versions', "date" FROM cd WHERE "date" > DATE '2024-01-03' AND "date" <= DATE '2024-01-20' AND alarm_count > 0
UNION ALL SELECT DISTINCT 'available before the day ended', "date" FROM cd WHERE "date" > DATE '2024-01-25'""")
def asof_problems(spark, sf):
    # Break the deliveries: repeats that differ, days that arrive early, days without alarms lost at the end.
    good = batches(spark, sf)
    broken = good.withColumn(
        "events_count", F.when((F.col("batch_id") == "b") & (F.col("alarm_count") > 0), F.col("events_count") + 1)
        .otherwise(F.col("events_count")))
    broken = broken.withColumn("available_at", F.when(
        F.col("day") > T.day("2024-01-25"), F.col("available_at") - F.make_dt_interval(days=F.lit(1)))
        .otherwise(F.col("available_at")))
    kept = broken.where((F.col("day") <= T.day("2024-01-18")) | (F.col("alarm_count") > 0) | (F.col("day") > T.day("2024-01-20")))
    seed = T.channel_days(spark, sf).where(F.col("date") <= T.day(SEED_END))
    return versions.history_problems(seed, kept, BATCH_COLUMNS, T.day(SEED_END), T.day("2024-01-20"))


@query("coverage_anti", """
SELECT 'channels_in_log_only' AS direction, count(*) AS ids FROM (SELECT channel_id FROM cd EXCEPT SELECT channel_id FROM channels)
UNION ALL SELECT 'channels_in_dictionary_only', count(*) FROM (SELECT channel_id FROM channels EXCEPT SELECT channel_id FROM cd)
UNION ALL SELECT 'objects_in_log_only', 0
UNION ALL SELECT 'objects_in_dictionary_only', count(*) FROM (SELECT object_id FROM objects
 EXCEPT SELECT object_id FROM channels WHERE channel_id IN (SELECT channel_id FROM cd))""")
def coverage_anti(spark, sf):
    logged = T.journal(spark, sf).select("channel_id").distinct()
    return J.dictionary_coverage(logged, T.channels(spark, sf), T.objects(spark, sf))


_CELLS = " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, count(*) FILTER (a.channel_id IS NOT NULL AND b.channel_id IS NOT NULL AND a.{c} <> b.{c}) AS mismatches,
 CAST(max(abs(a.{c} - b.{c})) AS DOUBLE) AS max_abs_difference, CAST(sum(a.{c}) AS DOUBLE) AS left_total, CAST(sum(b.{c}) AS DOUBLE) AS right_total,
 count(*) FILTER (b.channel_id IS NULL) AS left_only, count(*) FILTER (a.channel_id IS NULL) AS right_only,
 count(*) FILTER (a.channel_id IS NOT NULL AND b.channel_id IS NOT NULL) AS common
FROM cd a FULL JOIN changed b ON a.channel_id = b.channel_id AND a."date" = b."date" """
    for c in ("events_count", "alarm_count", "fault_count"))


@query("reconcile_tables", f"""
WITH changed AS (SELECT channel_id, "date", events_count, alarm_count + CASE WHEN fault_count > 1 THEN 1 ELSE 0 END AS alarm_count, fault_count
 FROM cd WHERE negative_count < 2) {_CELLS}""")
def reconcile_tables(spark, sf):
    # The second version misses some rows and has raised alarms on others.
    daily = T.channel_days(spark, sf)
    changed = daily.where("negative_count < 2").withColumn(
        "alarm_count", F.col("alarm_count") + (F.col("fault_count") > 1).cast("int"))
    return J.reconcile(daily, changed, ["channel_id", "date"], ["events_count", "alarm_count", "fault_count"])


@query("score_reproduction", """
SELECT count(*) AS "rows", CAST(0 AS BIGINT) AS unmatched, round(max(abs(round(smoothed, 4) - smoothed)), 6) AS max_difference,
 count(*) FILTER (abs(round(smoothed, 4) - smoothed) > 0.00002) AS beyond_tolerance FROM wide_scores""")
def score_reproduction(spark, sf):
    wide = T.wide_scores(spark, sf)
    new = wide.select("object_id", "date", F.round("smoothed", 4).alias("score"))
    old = wide.select("object_id", "date", F.col("smoothed").alias("score"))
    return rounded(J.reproduce(new, old, ["object_id", "date"], 0.00002))


@query("align_scores", """
SELECT object_id, "date", alarm_target, persistence, smoothed, blend FROM wide_scores""")
def align_scores(spark, sf):
    long = T.scores(spark, sf)
    keys = ["object_id", "date", "alarm_target"]
    return J.align_scores({m: long.where(F.col("model") == m) for m in ("persistence", "smoothed", "blend")}, keys)


# --- set operations ---------------------------------------------------------------

@query("union_years", """
SELECT year("date") AS "year", count(*) AS "rows", CAST(sum(events_count) AS BIGINT) AS records FROM lh GROUP BY 1""")
def union_years(spark, sf):
    facts = T.long_history(spark, sf)
    parts = [facts.where(F.year("date") == y) for y in range(1995, 2002)]
    return rounded(sets.union_years(*parts).groupBy(F.year("date").alias("year")).agg(
        F.count("*").alias("rows"), F.sum("events_count").alias("records")))


@query("channel_universe", "SELECT channel_id FROM cd UNION SELECT channel_id FROM channels")
def channel_universe(spark, sf):
    return sets.channel_universe(T.journal(spark, sf), T.channels(spark, sf))


@query("key_difference", """
SELECT channel_id, "date" FROM cd EXCEPT SELECT channel_id, "date" FROM cd WHERE numeric_count > 0""")
def key_difference(spark, sf):
    daily = T.channel_days(spark, sf)
    return sets.key_difference(daily, daily.where("numeric_count > 0"), ["channel_id", "date"])


@query("key_intersection", """
SELECT channel_id, "date" FROM cd WHERE alarm_count > 0 INTERSECT SELECT channel_id, "date" FROM cd WHERE numeric_count > 0""")
def key_intersection(spark, sf):
    daily = T.channel_days(spark, sf)
    return sets.key_intersection(daily.where("alarm_count > 0"), daily.where("numeric_count > 0"), ["channel_id", "date"])


@query("missing_days", """
SELECT CAST(d AS DATE) AS "day" FROM (SELECT unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY)) AS d)
WHERE CAST(d AS DATE) NOT IN (SELECT "date" FROM cd)""")
def missing_days(spark, sf):
    delivered = T.journal(spark, sf).select(F.to_date("date").alias("day"))
    return sets.missing_days(delivered, T.day("2023-12-25"), T.day("2024-02-05"))


@query("tagged_log_union", """
WITH t AS (SELECT 'ticket' AS kind, event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, event_type AS "mode", CAST(user_id AS VARCHAR) AS "text"
  FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 200),
 f AS (SELECT 'feedback', o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), 'error', o_orderpriority
  FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200)
SELECT * FROM (SELECT * FROM t UNION ALL SELECT * FROM f) ORDER BY created_at DESC, id DESC, kind LIMIT 200""")
def tagged_log_union(spark, sf):
    stamp = "yyyy-MM-dd HH:mm:ss"
    tickets = T.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.date_format("ts", stamp).alias("created_at"),
        F.col("event_type").alias("mode"), F.col("user_id").cast("string").alias("text"))
    feedback = T.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", stamp).alias("created_at"),
        F.lit("error").alias("mode"), F.col("o_orderpriority").alias("text"))
    return sets.decision_journal({"ticket": tickets, "feedback": feedback}, 200, mode="error")
