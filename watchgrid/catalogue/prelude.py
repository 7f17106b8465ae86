"""Shared tables of the DuckDB oracle, written independently of the Spark code."""

from __future__ import annotations

from watchgrid import vocab


def _words(values) -> str:
    return ", ".join("'" + str(v) + "'" for v in values)


TRUE = _words(vocab.ALARM_TRUE)
FALSE = _words(vocab.ALARM_FALSE)
SENTINELS = ", ".join(str(v) for v in vocab.SENTINELS)
STATES = ",\n ".join(
    f"CAST(sum(CASE WHEN lower(value_text) = '{t}' THEN 1 ELSE 0 END) AS BIGINT) AS {c}"
    for c, t in vocab.TEXT_STATES.items())


def big(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


PRELUDE: dict[str, str] = {}

PRELUDE["journal"] = """
SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS channel_id,
 strftime(ts, '%Y-%m-%d') AS "date", strftime(ts, '%H:%M:%S') AS "time",
 CASE WHEN event_type = 'error' AND value > 100
  THEN CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN ' True ' WHEN 2 THEN 'да' ELSE '1' END
  ELSE CASE event_id % 5 WHEN 0 THEN 'false' WHEN 1 THEN '0' WHEN 2 THEN 'Нет' WHEN 3 THEN '' ELSE 'unk' END
 END AS alarm_raw,
 CASE event_id % 12 WHEN 0 THEN '' WHEN 1 THEN 'Неисправен' WHEN 2 THEN ' обесточен ' WHEN 3 THEN 'Норма'
  WHEN 4 THEN '-999' WHEN 5 THEN '1d' WHEN 6 THEN concat('-', CAST(value AS VARCHAR))
  ELSE replace(CAST(value AS VARCHAR), '.', ',') END AS sensor_value
FROM events"""

PRELUDE["clean"] = f"""
SELECT event_id, channel_id, CAST("date" AS DATE) AS "date",
 CAST(substr("time", 1, 2) AS INT) * 3600 + CAST(substr("time", 4, 2) AS INT) * 60
  + CAST(substr("time", 7, 2) AS INT) AS "second",
 CASE WHEN lower(trim(alarm_raw)) IN ({TRUE}) THEN 1 ELSE 0 END AS is_alarm,
 CASE WHEN trim(alarm_raw) = '' THEN 'missing' WHEN lower(trim(alarm_raw)) IN ({TRUE}) THEN 'true'
  WHEN lower(trim(alarm_raw)) IN ({FALSE}) THEN 'false' ELSE 'invalid' END AS alarm_status,
 trim(sensor_value) AS value_text,
 CASE WHEN regexp_matches(trim(sensor_value), '{vocab.NUMBER_PATTERN}')
  THEN CAST(replace(trim(sensor_value), ',', '.') AS DOUBLE) END AS value,
 CASE WHEN regexp_matches(trim(sensor_value), '{vocab.NUMBER_PATTERN}') THEN 'numeric'
  WHEN trim(sensor_value) = '' THEN 'missing' ELSE 'text' END AS kind
FROM journal"""

PRELUDE["channels"] = """
SELECT CAST(c_custkey AS VARCHAR) AS channel_id, c_mktsegment AS engineering_system,
 concat('s', c_custkey % 4) AS sensor_type, CAST(c_custkey // 6 AS VARCHAR) AS object_id
FROM customer WHERE c_acctbal >= 0"""

PRELUDE["objects"] = """
SELECT CAST(n AS VARCHAR) AS object_id, concat('object ', n) AS object_name,
 CASE WHEN n % 7 <> 3 THEN concat('k', n % 3) END AS object_kind,
 CASE WHEN n % 11 <> 5 THEN CAST(n // 5 AS VARCHAR) END AS parent_id
FROM (SELECT DISTINCT c_custkey // 6 AS n FROM customer)"""

PRELUDE["chan_cat"] = """
SELECT c.channel_id, c.engineering_system, c.sensor_type, c.object_id, o.object_kind, o.parent_id
FROM channels c LEFT JOIN objects o USING (object_id)"""

PRELUDE["cd"] = f"""
SELECT channel_id, "date", count(*) AS events_count, {big('sum(is_alarm)', 'alarm_count')},
 {big("sum(CASE WHEN kind = 'numeric' THEN 1 ELSE 0 END)", 'numeric_count')},
 {big("sum(CASE WHEN kind = 'text' THEN 1 ELSE 0 END)", 'text_count')},
 {big("sum(CASE WHEN kind = 'missing' THEN 1 ELSE 0 END)", 'missing_count')},
 {big("sum(CASE WHEN value < 0 THEN 1 ELSE 0 END)", 'negative_count')},
 {big(f"sum(CASE WHEN value IN ({SENTINELS}) THEN 1 ELSE 0 END)", 'sentinel_count')},
 {STATES},
 coalesce(sum(value), 0.0) AS value_sum, coalesce(sum(value * value), 0.0) AS value_sumsq,
 min(value) AS value_min, max(value) AS value_max
FROM clean GROUP BY ALL"""

PRELUDE["grid"] = f"""
SELECT k.channel_id, CAST(d.d AS DATE) AS "date",
 {', '.join(f'coalesce(cd.{c}, 0) AS {c}' for c in vocab.DAILY_SUMS)}, cd.value_min, cd.value_max
FROM (SELECT channel_id FROM cd UNION SELECT channel_id FROM channels) k
CROSS JOIN (SELECT unnest(generate_series(min("date"), max("date"), INTERVAL 1 DAY)) AS d FROM cd) d
LEFT JOIN cd ON cd.channel_id = k.channel_id AND cd."date" = CAST(d.d AS DATE)"""

PRELUDE["g"] = """
SELECT grid.*, CAST("date" - (SELECT min("date") FROM cd) AS BIGINT) AS i,
 CAST(alarm_count > 0 AS INT) AS alarm, CAST(events_count > 0 AS INT) AS observed,
 CAST(fault_count > 0 AS INT) AS fault, CAST(no_power_count > 0 AS INT) AS no_power,
 CASE WHEN events_count > 0 THEN alarm_count / events_count ELSE 0 END AS alarm_rate_1d,
 CASE WHEN numeric_count > 0 THEN value_sum / numeric_count END AS value_mean_1d,
 CASE WHEN numeric_count > 0 THEN sqrt(greatest(value_sumsq / numeric_count
   - (value_sum / numeric_count) * (value_sum / numeric_count), 0)) END AS value_std_1d
FROM grid"""

PRELUDE["gc"] = """
SELECT g.*, coalesce(c.object_id, 'Нет в справочнике') AS object_id,
 coalesce(c.sensor_type, 'Нет в справочнике') AS sensor_type,
 coalesce(c.engineering_system, 'Нет в справочнике') AS engineering_system,
 CASE WHEN c.object_id IS NULL THEN 'unknown' ELSE coalesce(c.parent_id, 'root') END AS parent
FROM g LEFT JOIN chan_cat c USING (channel_id)"""

PRELUDE["intra"] = """
SELECT channel_id, "date",
 CAST(sum(CASE WHEN "second" >= 64800 THEN is_alarm ELSE 0 END) AS BIGINT) AS intra_alarm_count_last6h,
 CAST(sum(CASE WHEN "second" >= 43200 THEN is_alarm ELSE 0 END) AS BIGINT) AS intra_alarm_count_last12h,
 CAST(sum(CASE WHEN "second" >= 64800 THEN 1 ELSE 0 END) AS BIGINT) AS intra_events_last6h,
 CAST(sum(CASE WHEN "second" = top THEN 1 ELSE 0 END) - 1 AS BIGINT) AS intra_last_timestamp_ties,
 min("second") / 60.0 AS intra_first_event_minute,
 arg_min(is_alarm, CAST("second" AS HUGEINT) * 1000000000000 + CAST(event_id AS BIGINT)) AS intra_first_event_is_alarm,
 max("second") / 60.0 AS intra_last_event_minute,
 arg_max(is_alarm, CAST("second" AS HUGEINT) * 1000000000000 + CAST(event_id AS BIGINT)) AS intra_last_event_is_alarm,
 coalesce(max(CASE WHEN is_alarm = 1 THEN "second" END) / 60.0, -1) AS intra_last_alarm_minute
FROM (SELECT *, max("second") OVER (PARTITION BY channel_id, "date") AS top FROM clean)
GROUP BY channel_id, "date" """

PRELUDE["od_base"] = f"""
SELECT c.object_id, cd."date",
 {', '.join(big(f'sum({c})', c) for c in vocab.MODEL_COUNTERS)},
 CAST(count(*) FILTER (events_count > 0) AS BIGINT) AS observed_channels,
 CAST(count(*) FILTER (alarm_count > 0) AS BIGINT) AS alarm_channels,
 CAST(count(*) FILTER (fault_count > 0) AS BIGINT) AS fault_channels,
 CAST(count(*) FILTER (no_power_count > 0) AS BIGINT) AS no_power_channels
FROM cd JOIN channels c USING (channel_id)
GROUP BY ALL"""

PRELUDE["eligible"] = """
SELECT DISTINCT object_id FROM od_base WHERE "date" <= DATE '2024-01-15'"""

_OD = [*vocab.MODEL_COUNTERS, "observed_channels", "alarm_channels", "fault_channels", "no_power_channels"]
PRELUDE["od"] = f"""
SELECT e.object_id, CAST(d.d AS DATE) AS "date", CAST(CAST(d.d AS DATE) - DATE '2024-01-01' AS BIGINT) AS i,
 {', '.join(f'coalesce(b.{c}, 0) AS {c}' for c in _OD)},
 CAST(coalesce(b.alarm_channels, 0) > 0 AS INT) AS alarm_today,
 CAST(coalesce(b.observed_channels, 0) > 0 AS INT) AS observed_today,
 n.catalog_channels
FROM eligible e
CROSS JOIN (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS d) d
LEFT JOIN od_base b ON b.object_id = e.object_id AND b."date" = CAST(d.d AS DATE)
LEFT JOIN (SELECT object_id, count(DISTINCT channel_id) AS catalog_channels FROM channels GROUP BY 1) n
 ON n.object_id = e.object_id"""

PRELUDE["ol"] = """
SELECT od.*,
 lead(alarm_today, 1) OVER w AS a1, lead(alarm_today, 2) OVER w AS a2,
 lag(alarm_today, 1) OVER w AS b1, lag(alarm_today, 2) OVER w AS b2,
 lead(alarm_today, 2) OVER w AS alarm_target,
 CASE WHEN lead(alarm_today, 2) OVER w IS NOT NULL
  THEN CAST(lead(alarm_today, 1) OVER w = 0 AND lead(alarm_today, 2) OVER w = 1 AS INT) END AS onset_target
FROM od WINDOW w AS (PARTITION BY object_id ORDER BY "date")"""

# Frozen scores on the evaluation days; the same rounding as in the Spark frame.
PRELUDE["rates"] = """
SELECT object_id, sum(alarm_target) AS pos, count(alarm_target) AS n
FROM ol WHERE "date" <= DATE '2024-01-15' GROUP BY object_id"""
PRELUDE["global_rate"] = """
SELECT sum(pos) / sum(n) AS g FROM rates"""
PRELUDE["wide_scores"] = """
SELECT ol.object_id, ol."date", alarm_target, onset_target, ol.alarm_today, ol.observed_today,
 round(CAST(ol.alarm_today AS DOUBLE), 6) AS persistence,
 round(coalesce(pos / n, g), 6) AS frequency,
 round((pos + 30 * g) / (n + 30), 6) AS smoothed,
 round(0.4 * round((pos + 30 * g) / (n + 30), 6) + 0.6 * CAST(ol.alarm_today AS DOUBLE), 6) AS blend
FROM ol JOIN rates USING (object_id) CROSS JOIN global_rate
WHERE ol."date" BETWEEN DATE '2024-01-18' AND DATE '2024-01-28'"""
PRELUDE["scores"] = """
UNPIVOT wide_scores ON persistence, frequency, smoothed, blend INTO NAME model VALUE score"""

# Distinct scores with counts and everything at or above them.
PRELUDE["curve"] = """
SELECT *, tp / pred AS precision, tp / p AS recall, 2 * tp / (pred + p) AS f1 FROM (
 SELECT model, score, pos, n, sum(pos) OVER (PARTITION BY model ORDER BY score DESC) AS tp,
  sum(n) OVER (PARTITION BY model ORDER BY score DESC) AS pred,
  sum(pos) OVER (PARTITION BY model) AS p, sum(n) OVER (PARTITION BY model) AS total
 FROM (SELECT model, score, sum(alarm_target) AS pos, count(*) AS n FROM scores GROUP BY ALL))"""

PRELUDE["lh"] = """
SELECT CAST(c_nationkey AS VARCHAR) AS channel_id, CAST(o_orderdate AS DATE) AS "date",
 count(*) AS events_count,
 CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS alarm_count,
 CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS fault_count,
 CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) AS BIGINT) AS no_power_count,
 count(*) AS numeric_count,
 round(sum(o_totalprice / 1000), 6) AS value_sum,
 round(sum(pow(o_totalprice / 1000, 2)), 6) AS value_sumsq
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""

PRELUDE["lg"] = """
SELECT k.channel_id, CAST(d.d AS DATE) AS "date",
 CAST(CAST(d.d AS DATE) - (SELECT min("date") FROM lh) AS BIGINT) AS i,
 coalesce(events_count, 0) AS events_count, coalesce(alarm_count, 0) AS alarm_count,
 coalesce(fault_count, 0) AS fault_count, coalesce(no_power_count, 0) AS no_power_count,
 coalesce(numeric_count, 0) AS numeric_count,
 coalesce(value_sum, 0) AS value_sum, coalesce(value_sumsq, 0) AS value_sumsq,
 CAST(coalesce(alarm_count, 0) > 0 AS INT) AS alarm, CAST(coalesce(events_count, 0) > 0 AS INT) AS observed,
 CAST(coalesce(fault_count, 0) > 0 AS INT) AS fault, CAST(coalesce(no_power_count, 0) > 0 AS INT) AS no_power
FROM (SELECT DISTINCT channel_id FROM lh) k
CROSS JOIN (SELECT unnest(generate_series(min("date"), max("date"), INTERVAL 1 DAY)) AS d FROM lh) d
LEFT JOIN lh ON lh.channel_id = k.channel_id AND lh."date" = CAST(d.d AS DATE)"""
