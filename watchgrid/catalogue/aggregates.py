"""Daily reductions, profiling and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid import vocab
from watchgrid.catalogue.joins import LONG_COUNTERS
from watchgrid.catalogue.registry import query, rounded
from watchgrid.operators import aggregate as A
from watchgrid.operators import drift as D
from watchgrid.operators import labels as L
from watchgrid.operators import objects as O
from watchgrid.session import shared_folder
from watchgrid.sources import testtables as T


@query("channel_daily", f"""
SELECT channel_id, "date", {', '.join(vocab.DAILY_COUNTERS)}, round(value_sum, 6) AS value_sum,
 round(value_sumsq, 4) AS value_sumsq, value_min, value_max FROM cd""")
def channel_daily(spark, sf):
    return rounded(T.channel_days(spark, sf).withColumn("value_sumsq", F.round("value_sumsq", 4)))


@query("combine_daily", f"""
SELECT channel_id, "date", {', '.join(vocab.DAILY_COUNTERS)}, round(value_sum, 6) AS value_sum, value_min, value_max FROM cd""")
def combine_daily(spark, sf):
    # Partial channel-days of morning records and of all others, those without a time too, give the same totals.
    clean = T.clean(spark, sf)
    morning = F.coalesce(F.col("second") < 43200, F.lit(False))
    parts = [A.channel_daily(clean.where(c)) for c in (morning, ~morning)]
    return rounded(A.combine_daily(parts[0].unionByName(parts[1])).drop("value_sumsq"))


@query("intraday_daily", """
SELECT channel_id, "date", intra_alarm_count_last6h, intra_alarm_count_last12h, intra_events_last6h, intra_last_timestamp_ties,
 round(intra_first_event_minute, 6) AS intra_first_event_minute, CAST(intra_first_event_is_alarm AS BIGINT) AS intra_first_event_is_alarm,
 round(intra_last_event_minute, 6) AS intra_last_event_minute, CAST(intra_last_event_is_alarm AS BIGINT) AS intra_last_event_is_alarm,
 round(intra_last_alarm_minute, 6) AS intra_last_alarm_minute FROM intra""")
def intraday_daily(spark, sf):
    return rounded(A.intraday_daily(T.clean(spark, sf)))


@query("object_daily", f"""
SELECT object_id, "date", {', '.join(vocab.MODEL_COUNTERS)}, observed_channels, alarm_channels, fault_channels, no_power_channels FROM od_base""")
def object_daily(spark, sf):
    return A.object_daily(T.channel_days(spark, sf), T.channels(spark, sf))


@query("catalog_channels", "SELECT object_id, count(DISTINCT channel_id) AS catalog_channels FROM channels GROUP BY 1")
def catalog_channels(spark, sf):
    return A.catalog_channels(T.channels(spark, sf))


@query("year_summary", f"""
SELECT year("date") AS "year", count(*) AS "rows", CAST(sum(is_alarm) AS BIGINT) AS alarms,
 count(*) FILTER (kind = 'numeric') AS numeric_rows, count(*) FILTER (kind = 'text') AS text_rows,
 count(*) FILTER (kind = 'missing') AS missing_rows, count(*) FILTER (value < 0) AS negative_rows,
 count(*) FILTER (value IN (-100, 100, 255, 999, 9999, -999)) AS sentinel_rows,
 count(*) FILTER (alarm_status = 'invalid') AS invalid_alarm, CAST(0 AS BIGINT) AS invalid_time,
 count(DISTINCT channel_id) AS channels, min("date") AS first_date, max("date") AS last_date,
 min(value) AS value_min, max(value) AS value_max, round(100 * sum(is_alarm) / count(*), 6) AS alarm_percent,
 round(avg(value), 4) AS value_mean, round(stddev_pop(value), 4) AS value_std FROM clean GROUP BY 1""")
def year_summary(spark, sf):
    out = A.year_summary(T.clean(spark, sf))
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("value_mean", "value_std")}))


@query("month_hour_weekday", """
SELECT 'month' AS profile, strftime("date", '%Y-%m') AS unit, count(*) AS "rows", CAST(sum(is_alarm) AS BIGINT) AS alarms,
 round(100 * sum(is_alarm) / count(*), 6) AS alarm_percent FROM clean GROUP BY 2
UNION ALL SELECT 'hour', CAST(h AS VARCHAR), count("second"), coalesce(CAST(sum(is_alarm) AS BIGINT), 0),
 round(100 * sum(is_alarm) / nullif(count("second"), 0), 6) FROM range(24) r(h) LEFT JOIN clean ON "second" // 3600 = h GROUP BY 2
UNION ALL SELECT 'weekday', CAST(w AS VARCHAR), count("date"), coalesce(CAST(sum(is_alarm) AS BIGINT), 0),
 round(100 * sum(is_alarm) / nullif(count("date"), 0), 6) FROM range(7) r(w) LEFT JOIN clean ON isodow("date") - 1 = w GROUP BY 2""")
def month_hour_weekday(spark, sf):
    return rounded(A.time_profiles(T.clean(spark, sf)))


def _dimension_sql(dimension: str) -> str:
    return f"""
SELECT '{dimension}' AS dimension, CASE WHEN c.channel_id IS NULL THEN 'Нет в справочнике' ELSE coalesce(c.{dimension}, 'Не указан') END AS unit,
 count(*) AS "rows", CAST(sum(is_alarm) AS BIGINT) AS alarms, round(100 * count(*) / (SELECT count(*) FROM clean), 6) AS share_percent,
 round(100 * sum(is_alarm) / count(*), 6) AS alarm_percent FROM clean LEFT JOIN chan_cat c USING (channel_id) GROUP BY 2"""


@query("dimension_summary", " UNION ALL ".join(_dimension_sql(d) for d in ("engineering_system", "sensor_type", "object_id")))
def dimension_summary(spark, sf):
    parts = [A.dimension_summary(T.clean(spark, sf), T.catalog(spark, sf), d).select(
        F.lit(d).alias("dimension"), F.col(d).alias("unit"), "rows", "alarms", "share_percent", "alarm_percent")
        for d in ("engineering_system", "sensor_type", "object_id")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


PROFILE_SQL = """
SELECT channel_id, count(*) AS "rows", CAST(sum(is_alarm) AS BIGINT) AS alarms,
 count(*) FILTER (kind = 'numeric') AS numeric_rows, count(*) FILTER (kind = 'text') AS text_rows,
 count(*) FILTER (kind = 'missing') AS missing_rows, count(*) FILTER (value < 0) AS negative_rows,
 count(*) FILTER (value IN (-100, 100, 255, 999, 9999, -999)) AS sentinel_rows,
 min("date") AS first_date, max("date") AS last_date, min(value) AS value_min, max(value) AS value_max,
 CAST(max("date") - min("date") + 1 AS BIGINT) AS active_days,
 100 * sum(is_alarm) / count(*) AS alarm_percent, 100 * count(*) FILTER (kind = 'numeric') / count(*) AS numeric_percent,
 count(*) / (max("date") - min("date") + 1) AS events_per_day, avg(value) AS value_mean,
 CASE WHEN count(value) > 1 THEN stddev_pop(value) END AS value_std FROM clean GROUP BY channel_id"""


@query("channel_profile", f"""
SELECT * REPLACE (round(alarm_percent, 6) AS alarm_percent, round(numeric_percent, 6) AS numeric_percent,
 round(events_per_day, 6) AS events_per_day, round(value_mean, 4) AS value_mean, round(value_std, 4) AS value_std)
FROM ({PROFILE_SQL})""")
def channel_profile(spark, sf):
    out = A.channel_profile(T.clean(spark, sf))
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("value_mean", "value_std")}))


@query("value_kind_by_year", """
SELECT year("date") AS "year", count(*) AS "rows", count(*) FILTER (kind = 'numeric') AS numeric,
 count(*) FILTER (kind = 'text') AS "text", count(*) FILTER (kind = 'missing') AS missing,
 round(100 * count(*) FILTER (kind = 'numeric') / count(*), 6) AS numeric_percent,
 round(100 * count(*) FILTER (kind = 'text') / count(*), 6) AS text_percent,
 round(100 * count(*) FILTER (kind = 'missing') / count(*), 6) AS missing_percent FROM clean GROUP BY 1""")
def value_kind_by_year(spark, sf):
    return rounded(A.value_kinds(T.clean(spark, sf)))


@query("missing_by_column", " UNION ALL ".join(f"""
SELECT substr("date", 1, 7) AS part, count(*) AS "rows", '{c}' AS column_name, count(*) FILTER (trim({q}) = '') AS blank_cells,
 round(100 * count(*) FILTER (trim({q}) = '') / count(*), 6) AS blank_percent FROM journal GROUP BY 1"""
    for c, q in ((c, f'"{c}"') for c in vocab.JOURNAL_COLUMNS)))
def missing_by_column(spark, sf):
    return rounded(A.missing_by_column(T.journal(spark, sf), F.substring("date", 1, 7)))


@query("approx_distinct_ids", """
SELECT year("date") AS "year", CAST(6 AS BIGINT) AS files, count(*) AS "rows", count(DISTINCT event_id) AS exact_ids, CAST(1 AS BIGINT) AS within_error,
 CAST(1 AS BIGINT) AS merged_as_rebuilt FROM clean GROUP BY 1""")
def approx_distinct_ids(spark, sf):
    # Four files, then two more, one of them twice: only the new files are sketched.
    rows = T.clean(spark, sf).withColumn("file", F.concat(F.lit("part-"), F.pmod(F.xxhash64("channel_id"), F.lit(6)).cast("string")))
    path, late = shared_folder(spark, "sketches"), F.col("file").isin("part-4", "part-5")
    for part in (rows.where(~late), rows.where(late), rows.where("file = 'part-5'")):
        A.store_sketches(A.sketch_files(part, F.col("file")), path)
    merged = A.merged_duplicates(spark.read.parquet(path))
    rebuilt = A.merged_duplicates(A.sketch_files(rows, F.col("file"))).select("year", F.col("distinct_ids").alias("rebuilt"))
    exact = A.exact_duplicates(rows).select("year", F.col("distinct_ids").alias("exact_ids"))
    close = F.abs(F.col("distinct_ids") - F.col("exact_ids")) <= 3 * A.SKETCH_ERROR * F.col("exact_ids")
    same = F.col("distinct_ids") == F.col("rebuilt")
    return rounded(merged.join(rebuilt, "year").join(exact, "year").select(
        "year", "files", "rows", "exact_ids", close.alias("within_error"), same.alias("merged_as_rebuilt")))


@query("exact_dup_sample", """
SELECT 2024 AS "year", count(*) AS "rows", count(DISTINCT user_id * 100 + hour(ts)) AS distinct_ids,
 count(*) - count(DISTINCT user_id * 100 + hour(ts)) AS duplicate_rows FROM events""")
def exact_dup_sample(spark, sf):
    # Identities that do repeat: channel and hour.
    rows = T.clean(spark, sf).withColumn("event_id", F.concat_ws("-", "channel_id", F.floor(F.col("second") / 3600)))
    return rounded(A.exact_duplicates(rows))


_FEATURES = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0) AS {c}" for c in [*A.PROFILE_FEATURES, "alarm_percent"]).replace(
    "CAST(rows ", 'CAST("rows" ').replace("AS rows", 'AS "rows"')
_CORR_ROWS = f'SELECT {_FEATURES} FROM ({PROFILE_SQL}) WHERE "rows" >= 50'


def _corr_sql(a: str, b: str) -> str:
    return (f'CASE WHEN stddev_pop("{a}") > 0 AND stddev_pop("{b}") > 0 AND count(*) >= 3 '
            f'THEN round(covar_pop("{a}", "{b}") / (stddev_pop("{a}") * stddev_pop("{b}")), 5) END')


@query("channel_correlations", " UNION ALL ".join(
    f"SELECT '{a}' AS feature, {_corr_sql(a, 'alarm_percent')} AS pearson FROM ({_CORR_ROWS})" for a in A.PROFILE_FEATURES))
def channel_correlations(spark, sf):
    out = A.target_correlations(A.channel_profile(T.clean(spark, sf)), min_rows=50)
    return rounded(out, 5)


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS feature, " + ", ".join(f'{_corr_sql(a, b)} AS "{b}"' for b in A.PROFILE_FEATURES) + f" FROM ({_CORR_ROWS})"
    for a in A.PROFILE_FEATURES))
def correlation_matrix(spark, sf):
    return rounded(A.correlation_matrix(A.channel_profile(T.clean(spark, sf)), min_rows=50), 5)


@query("quality_kpis", """
SELECT 'total_rows' AS kpi, CAST(count(*) AS DOUBLE) AS value FROM clean
UNION ALL SELECT 'total_alarms', CAST(sum(is_alarm) AS DOUBLE) FROM clean
UNION ALL SELECT 'alarm_percent', round(100 * sum(is_alarm) / count(*), 6) FROM clean
UNION ALL SELECT 'channels_without_dictionary', CAST(count(DISTINCT channel_id) AS DOUBLE) FROM clean
 WHERE channel_id NOT IN (SELECT channel_id FROM channels)
UNION ALL SELECT 'objects_without_dictionary', 0.0""")
def quality_kpis(spark, sf):
    return rounded(A.quality_kpis(T.clean(spark, sf), T.channels(spark, sf), T.objects(spark, sf)))


@query("state_days", " UNION ALL ".join(f"""
SELECT '{s}' AS state, count(*) AS days, count(DISTINCT channel_id) AS channels, count(*) FILTER (alarm_count = 0) AS days_without_alarm
FROM cd WHERE {s}_count > 0 HAVING count(*) > 0""" for s in ("alarm", "fault", "no_power", "undefined")))
def state_days(spark, sf):
    return A.state_days(T.channel_days(spark, sf))


@query("year_profile", """
SELECT channel_id, year("date") AS "year", CAST(sum(events_count) AS BIGINT) AS events_count, CAST(sum(alarm_count) AS BIGINT) AS alarm_count,
 count(*) FILTER (alarm_count > 0) AS alarm_days, count(*) FILTER (fault_count > 0) AS fault_days,
 count(*) FILTER (no_power_count > 0) AS no_power_days, count(*) AS observed_days, min("date") AS first_observed,
 max("date") AS last_observed, max(CASE WHEN alarm_count > 0 THEN "date" END) AS last_alarm FROM lh GROUP BY ALL""")
def year_profile(spark, sf):
    out = A.year_profile(T.long_history(spark, sf), LONG_COUNTERS)
    return rounded(out.drop("fault_count", "no_power_count", "numeric_count", "value_sum", "value_sumsq"))


@query("history_summary", """
SELECT year("date") AS "year", count(*) AS "rows", count(DISTINCT channel_id) AS channels, CAST(sum(events_count) AS BIGINT) AS records,
 CAST(sum(alarm_count) AS BIGINT) AS alarms, CAST(sum(fault_count) AS BIGINT) AS faults, min("date") AS first_date, max("date") AS last_date
FROM lh GROUP BY 1""")
def history_summary(spark, sf):
    return rounded(A.history_summary(T.long_history(spark, sf)))


def split_labels(spark, sf):
    split = L.chrono_split(F.col("date"), T.day(T.TRAIN_END), T.day("2024-01-22"), 2)
    return T.labelled(spark, sf).withColumn("split", split).where("split is not null")


@query("target_distribution", """
SELECT split, count(*) FILTER (alarm_target = 0) AS negatives, count(*) FILTER (alarm_target = 1) AS positives,
 count(*) FILTER (alarm_target IS NULL) AS unlabelled FROM (SELECT *, CASE WHEN "date" <= DATE '2024-01-13' THEN 'train'
 WHEN "date" > DATE '2024-01-15' AND "date" <= DATE '2024-01-20' THEN 'valid' WHEN "date" > DATE '2024-01-22' THEN 'test' END AS split FROM ol)
WHERE split IS NOT NULL GROUP BY split""")
def target_distribution(spark, sf):
    return A.target_distribution(split_labels(spark, sf), "alarm_target")


# --- drift ------------------------------------------------------------------------

DRIFT_FEATURES = ["events_count", "numeric_count", "value_mean_1d", "value_max"]


def drift_rows(spark, sf):
    from watchgrid.functions.scalars import daily_rates

    rows = T.channel_days(spark, sf)
    split = L.chrono_split(F.col("date"), T.day(T.TRAIN_END), T.day("2024-01-22"))
    shown = rows.withColumn("value_mean_1d", daily_rates()["value_mean_1d"])
    return shown.select(split.alias("split"), *[F.round(F.col(c).cast("double"), 4).alias(c) for c in DRIFT_FEATURES])


_DRIFT = """drift_rows AS (SELECT CASE WHEN "date" <= DATE '2024-01-15' THEN 'train' WHEN "date" <= DATE '2024-01-22' THEN 'valid' ELSE 'test' END AS split,
 round(CAST(events_count AS DOUBLE), 4) AS events_count, round(CAST(numeric_count AS DOUBLE), 4) AS numeric_count,
 round(CASE WHEN numeric_count > 0 THEN value_sum / numeric_count END, 4) AS value_mean_1d, round(value_max, 4) AS value_max FROM cd)"""


@query("feature_coverage", f"WITH {_DRIFT} " + " UNION ALL ".join(f"""
SELECT split, '{c}' AS feature, count(*) AS "rows", count({c}) AS non_null, round(count({c}) / count(*), 6) AS coverage,
 round(count(*) FILTER (coalesce({c}, 0) = 0) / count(*), 6) AS zero_share, count(DISTINCT {c}) AS unique_values FROM drift_rows GROUP BY split"""
    for c in DRIFT_FEATURES))
def feature_coverage(spark, sf):
    return rounded(D.feature_coverage(drift_rows(spark, sf), DRIFT_FEATURES))


@query("drift_moments", f"WITH {_DRIFT} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, " + ", ".join(
        f"round(avg({c}) FILTER (split = '{s}'), 4) AS {s}_mean, round(stddev_samp({c}) FILTER (split = '{s}'), 4) AS {s}_std"
        for s in ("train", "valid", "test")) + " FROM drift_rows" for c in DRIFT_FEATURES))
def drift_moments(spark, sf):
    return rounded(D.drift_moments(drift_rows(spark, sf), DRIFT_FEATURES), 4)


def _psi_sql(c: str, split: str) -> str:
    edges = f"(SELECT list_distinct(quantile_cont({c}, [0,.1,.2,.3,.4,.5,.6,.7,.8,.9,1])) FROM drift_rows WHERE split = 'train')"
    return f"""
SELECT '{c}' AS feature, '{split}' AS split, CASE WHEN (SELECT count(DISTINCT {c}) FROM drift_rows WHERE split = 'train') >= 2
  AND len({edges}) >= 3 THEN round((SELECT sum((a - e) * ln(a / e)) FROM (
  SELECT b, count(*) FILTER (split = 'train') / (SELECT count({c}) FROM drift_rows WHERE split = 'train') + 0.000001 AS e,
   count(*) FILTER (split = '{split}') / (SELECT count({c}) FROM drift_rows WHERE split = '{split}') + 0.000001 AS a
  FROM (SELECT split, len(list_filter(list_sort({edges})[2:-2], lambda x: x < {c})) AS b FROM drift_rows WHERE {c} IS NOT NULL) GROUP BY b)), 6) END AS psi"""


@query("psi", f"WITH {_DRIFT} " + " UNION ALL ".join(_psi_sql(c, s) for c in DRIFT_FEATURES for s in ("valid", "test")))
def psi(spark, sf):
    return rounded(D.psi(drift_rows(spark, sf), DRIFT_FEATURES))


def _ks_sql(c: str, split: str) -> str:
    return f"""
SELECT '{c}' AS feature, '{split}' AS split, round(max(abs(f1 - f2)), 6) AS ks FROM (SELECT
 sum(a) OVER (ORDER BY v) / sum(a) OVER () AS f1, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS f2 FROM (
 SELECT {c} AS v, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = '{split}') AS b
 FROM drift_rows WHERE {c} IS NOT NULL GROUP BY 1))"""


@query("ks_statistic", f"WITH {_DRIFT} " + " UNION ALL ".join(_ks_sql(c, s) for c in DRIFT_FEATURES for s in ("valid", "test")))
def ks_statistic(spark, sf):
    return rounded(D.ks(drift_rows(spark, sf), DRIFT_FEATURES))


# --- simple priors ------------------------------------------------------------------

@query("frozen_frequency", """
SELECT ol.object_id, ol."date", round(pos / n, 6) AS frequency FROM ol JOIN rates USING (object_id)""")
def frozen_frequency(spark, sf):
    out = O.frozen_frequency(T.labelled(spark, sf), T.day(T.TRAIN_END))
    return rounded(out.select("object_id", "date", "frequency"))


@query("smoothed_frequency", """
SELECT ol.object_id, ol."date", round((p + 30 * g) / (n + 30), 6) AS smoothed FROM ol JOIN (
 SELECT object_id, sum(onset_target) AS p, count(onset_target) AS n FROM ol WHERE "date" <= DATE '2024-01-15' GROUP BY 1) USING (object_id)
CROSS JOIN (SELECT avg(onset_target) AS g FROM ol WHERE "date" <= DATE '2024-01-15')""")
def smoothed_frequency(spark, sf):
    out = O.smoothed_frequency(T.labelled(spark, sf), T.day(T.TRAIN_END), "onset_target")
    return rounded(out.select("object_id", "date", "smoothed"))


@query("markov_prior", """
SELECT a AS from_state, b AS to_state, coalesce(n, 0) + 1 AS n,
 round((coalesce(n, 0) + 1) / sum(coalesce(n, 0) + 1) OVER (PARTITION BY a), 6) AS probability
FROM range(3) x(a) CROSS JOIN range(3) y(b) LEFT JOIN (SELECT f, t, count(*) AS n FROM (
 SELECT lag(s) OVER (PARTITION BY object_id ORDER BY "date") AS f, s AS t FROM (
  SELECT *, CASE WHEN alarm_today = 1 THEN 2 WHEN observed_today = 1 THEN 1 ELSE 0 END AS s FROM od WHERE "date" <= DATE '2024-01-15'))
 WHERE f IS NOT NULL GROUP BY ALL) ON f = a AND t = b""")
def markov_prior(spark, sf):
    return rounded(O.markov_prior(T.object_mart(spark, sf), T.day(T.TRAIN_END)))


@query("weekday_prior", """
SELECT w AS weekday, coalesce(CAST(sum(alarm_today) AS BIGINT), 0) AS pos, count(od.object_id) AS n,
 round((coalesce(sum(alarm_today), 0) + 1) / (count(od.object_id) + 2), 6) AS rate
FROM range(7) r(w) LEFT JOIN od ON isodow("date") - 1 = w AND "date" <= DATE '2024-01-15' GROUP BY w""")
def weekday_prior(spark, sf):
    return rounded(O.weekday_prior(T.object_mart(spark, sf), T.day(T.TRAIN_END)))


def _persistence_sql(state: str, lead: int) -> str:
    return f"""
SELECT '{state}' AS state, {lead} AS lead_days, count(*) AS "rows", CAST(sum({state}) AS BIGINT) AS predicted,
 CAST(sum(target) AS BIGINT) AS positives, CAST(sum({state} * target) AS BIGINT) AS hits,
 round(sum({state} * target) / nullif(sum({state}), 0), 6) AS precision, round(sum({state} * target) / nullif(sum(target), 0), 6) AS recall
FROM (SELECT *, lead(alarm, {lead}) OVER (PARTITION BY channel_id ORDER BY "date") AS target FROM g) WHERE target IS NOT NULL"""


@query("persistence_rule", " UNION ALL ".join(_persistence_sql(s, n) for s in ("alarm", "fault", "no_power") for n in (1, 2)))
def persistence_rule(spark, sf):
    from watchgrid.operators.evaluation import persistence

    return rounded(persistence(T.grid(spark, sf), ["alarm", "fault", "no_power"], (1, 2)))
