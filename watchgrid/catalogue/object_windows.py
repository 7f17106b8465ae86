"""Object-day mart, onset and episode features, forecasts without a fitted model."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid import vocab
from watchgrid.catalogue.registry import query, rounded
from watchgrid.operators import objects as O
from watchgrid.session import materialize
from watchgrid.sources import testtables as T

W = 'OVER (PARTITION BY object_id ORDER BY "date"'


def run(expr: str) -> str:
    return f"{expr} {W})"


def frame(expr: str, days: int) -> str:
    return f"{expr} {W} ROWS BETWEEN {days - 1} PRECEDING AND CURRENT ROW)"


def shown(df, *columns, digits: int = 6):
    return rounded(df.select("object_id", "date", *columns), digits)


@query("lag_null", 'SELECT object_id, "date", ' + ", ".join(
    f"{run(f'lag({c}, {n})')} AS {c}_lag{n}" for c in vocab.OBJECT_SIGNALS for n in (1, 2, 7, 14)) + " FROM od")
def lag_null(spark, sf):
    return shown(O.object_lags(T.object_mart(spark, sf)), *[f"{c}_lag{n}" for c in vocab.OBJECT_SIGNALS for n in (1, 2, 7, 14)])


_MEANS = [f"{c}_mean{k}" for c in vocab.OBJECT_SIGNALS for k in (3, 7, 28)]


@query("object_features", 'SELECT object_id, "date", object_kind, parent_id, '
       + ", ".join([*vocab.MODEL_COUNTERS, "observed_channels", "alarm_channels", "fault_channels", "no_power_channels", "catalog_channels", "alarm_today", "observed_today"])
       + ", round(observed_channels / catalog_channels, 6) AS observed_fraction, round(alarm_channels / nullif(observed_channels, 0), 6) AS alarm_channel_fraction, "
       + ", ".join(f"{run(f'lag({c}, {n})')} AS {c}_lag{n}" for c in vocab.OBJECT_SIGNALS for n in (1, 2, 7, 14)) + ", "
       + ", ".join(f"round({frame(f'avg({c})', k)}, 6) AS {c}_mean{k}" for c in vocab.OBJECT_SIGNALS for k in (3, 7, 28))
       + f""", round({run('sum(alarm_today)')} / (i + 1), 6) AS historical_alarm_frequency,
 CASE WHEN alarm_today = 1 THEN i - coalesce({run('max(CASE WHEN alarm_today = 0 THEN i END)')}, -1) ELSE 0 END AS alarm_streak,
 coalesce(i - {run('max(CASE WHEN alarm_today = 1 THEN i END)')}, -1) AS days_since_alarm, isodow("date" + 2) - 1 AS target_dayofweek,
 round(sin(2 * pi() * dayofyear("date") / 365.25), 6) AS annual_sin, round(cos(2 * pi() * dayofyear("date") / 365.25), 6) AS annual_cos
FROM (SELECT od.*, coalesce(o.object_kind, 'unknown') AS object_kind, coalesce(o.parent_id, 'unknown') AS parent_id
 FROM od LEFT JOIN objects o ON o.object_id = od.object_id)""")
def object_features(spark, sf):
    return rounded(O.with_signals(T.object_mart(spark, sf)))


@query("onset_features", f"""
SELECT object_id, "date", onset_today, clear_today, alarm_today + 2 * b1 + 4 * b2 AS alarm_pattern3,
 round({frame('avg(onset_today)', 7)}, 6) AS onset_mean7, round({frame('avg(onset_today)', 28)}, 6) AS onset_mean28,
 round({frame('avg(clear_today)', 7)}, 6) AS clear_mean7, round({frame('avg(clear_today)', 28)}, 6) AS clear_mean28,
 round({run('avg(onset_today)')}, 6) AS past_onset_frequency,
 coalesce(i - {run('max(CASE WHEN onset_today = 1 THEN i END)')}, -1) AS days_since_onset
FROM (SELECT *, CAST(alarm_today = 1 AND b1 = 0 AS BIGINT) AS onset_raw, CASE WHEN b1 IS NOT NULL THEN CAST(alarm_today = 1 AND b1 = 0 AS BIGINT) END AS onset_today,
 CASE WHEN b1 IS NOT NULL THEN CAST(alarm_today = 0 AND b1 = 1 AS BIGINT) END AS clear_today FROM ol)""")
def onset_features(spark, sf):
    return shown(O.onset_features(T.object_mart(spark, sf)), "onset_today", "clear_today", "alarm_pattern3", "onset_mean7",
                 "onset_mean28", "clear_mean7", "clear_mean28", "past_onset_frequency", "days_since_onset")


@query("recap_7d", f"""
SELECT object_id, "date", CAST({frame('sum(alarm_today)', 7)} AS BIGINT) AS alarm_days_7d,
 CAST({frame('sum(observed_today)', 7)} AS BIGINT) AS observed_days_7d FROM od""")
def recap_7d(spark, sf):
    return shown(O.recap_7d(T.object_mart(spark, sf)), "alarm_days_7d", "observed_days_7d")


@query("label_onset", """
SELECT object_id, "date", CASE WHEN a2 IS NOT NULL THEN CAST(a1 = 0 AS BIGINT) END AS quiet_intermediate, alarm_target, onset_target,
 CASE WHEN a2 IS NOT NULL THEN 2 * a1 + a2 END AS joint_target FROM ol""")
def label_onset(spark, sf):
    return shown(T.labelled(spark, sf), "quiet_intermediate", "alarm_target", "onset_target", "joint_target")


# Only days with records: silent days are missing from this history.
_HISTORY = """(SELECT object_id, "date", CAST("date" - DATE '2024-01-01' AS BIGINT) AS d, CAST(alarm_channels > 0 AS INT) AS alarm_today,
 CAST(observed_channels > 0 AS INT) AS observed_today FROM od_base)"""


def _episode_sql(source: str, gap: int) -> str:
    w = f"(PARTITION BY object_id ORDER BY d RANGE BETWEEN {gap} PRECEDING AND 1 PRECEDING)"
    return f"""
SELECT object_id, "date", {gap} AS gap, n AS context_days, CAST(n = {gap} AS BIGINT) AS context_known,
 CASE WHEN n = {gap} THEN CAST(alarms AS BIGINT) END AS gap_alarm_days, CASE WHEN n = {gap} THEN CAST(records AS BIGINT) END AS gap_record_days,
 CASE WHEN n = {gap} THEN CAST(alarm_today = 1 AND alarms = 0 AS BIGINT) END AS episode_start,
 CASE WHEN n = {gap} THEN CAST(alarm_today = 1 AND alarms > 0 AS BIGINT) END AS repeat_alarm,
 CASE WHEN n <> {gap} THEN 'unknown_context' WHEN records = {gap} THEN 'records_every_gap_day' WHEN records = 0 THEN 'no_records_in_gap'
  ELSE 'records_some_gap_days' END AS gap_record_coverage
FROM (SELECT *, count(*) OVER {w} AS n, sum(alarm_today) OVER {w} AS alarms, sum(observed_today) OVER {w} AS records FROM {source})"""


@query("episode_labels", " UNION ALL ".join(_episode_sql(_HISTORY, g) for g in (1, 3, 7)))
def episode_labels(spark, sf):
    from watchgrid.operators import aggregate as A

    daily = A.object_daily(T.channel_days(spark, sf), T.channels(spark, sf))
    history = daily.select("object_id", "date", (F.col("alarm_channels") > 0).cast("int").alias("alarm_today"),
                           (F.col("observed_channels") > 0).cast("int").alias("observed_today"))
    history = O.checked_history(materialize(history, "history"))
    parts = [O.episode_labels(history, g).drop("alarm_today", "observed_today") for g in (1, 3, 7)]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


_STATES = """states AS (SELECT *, lag(s) OVER (PARTITION BY object_id ORDER BY "date") AS p FROM (
 SELECT *, CASE WHEN alarm_today = 1 THEN 2 WHEN observed_today = 1 THEN 1 ELSE 0 END AS s FROM od)),
prior AS (SELECT a, b, (coalesce(n, 0) + 1) / sum(coalesce(n, 0) + 1) OVER (PARTITION BY a) AS pr
 FROM range(3) x(a) CROSS JOIN range(3) y(b) LEFT JOIN (SELECT p, s, count(*) AS n FROM states
  WHERE p IS NOT NULL AND "date" <= DATE '2024-01-15' GROUP BY ALL) ON p = a AND s = b),
wprior AS (SELECT w, (coalesce(sum(alarm_today), 0) + 1) / (count(od.object_id) + 2) AS pr
 FROM range(7) r(w) LEFT JOIN od ON isodow("date") - 1 = w AND "date" <= DATE '2024-01-15' GROUP BY w)"""


def _markov_sql(half: int) -> str:
    """Transition table of every day from all earlier days, then two steps."""
    return f"""t{half} AS (SELECT object_id, "date", s, a, b, (c + 5 * pr) / (sum(c) OVER (PARTITION BY object_id, "date", a) + 5) AS t
 FROM (SELECT x.object_id, x."date", x.s, prior.a, prior.b, any_value(pr) AS pr,
  coalesce(sum(pow(2, (y.i - x.i) / {half}.0)) FILTER (y.p = prior.a AND y.s = prior.b), 0) AS c
  FROM states x JOIN states y ON y.object_id = x.object_id AND y.i <= x.i CROSS JOIN prior GROUP BY ALL)),
m{half} AS (SELECT f.object_id, f."date", sum(f.t * g.t) AS score FROM t{half} f JOIN t{half} g
 ON g.object_id = f.object_id AND g."date" = f."date" AND g.a = f.b AND g.b = 2 WHERE f.a = f.s GROUP BY ALL)"""


@query("markov_forecast", f"WITH {_STATES}, {_markov_sql(45)}, {_markov_sql(180)} " + """
SELECT object_id, "date", round(m45.score, 6) AS markov_45, round(m180.score, 6) AS markov_180
FROM m45 JOIN m180 USING (object_id, "date")""")
def markov_forecast(spark, sf):
    mart = materialize(T.object_mart(spark, sf).select("object_id", "date", "alarm_today", "observed_today"), "mart")
    prior = O.markov_prior(mart, T.day(T.TRAIN_END))
    return shown(O.markov_forecast(O.markov_forecast(mart, prior, 45), prior, 180), "markov_45", "markov_180")


def _seasonal_sql(half: int) -> str:
    return f"""s{half} AS (SELECT x.object_id, x."date", (coalesce(sum(pow(2, (y.i - x.i) / {half}.0) * y.alarm_today), 0) + 10 * any_value(pr))
  / (coalesce(sum(pow(2, (y.i - x.i) / {half}.0)), 0) + 10) AS score
 FROM od x JOIN wprior ON w = isodow(x."date" + 2) - 1
 LEFT JOIN od y ON y.object_id = x.object_id AND y.i <= x.i AND isodow(y."date") = isodow(x."date" + 2) GROUP BY ALL)"""


@query("seasonal_forecast", f"WITH {_STATES}, {_seasonal_sql(90)}, {_seasonal_sql(365)} " + """
SELECT object_id, "date", round(s90.score, 6) AS seasonal_90, round(s365.score, 6) AS seasonal_365
FROM s90 JOIN s365 USING (object_id, "date")""")
def seasonal_forecast(spark, sf):
    mart = materialize(T.object_mart(spark, sf).select("object_id", "date", "alarm_today", "observed_today"), "mart")
    prior = O.weekday_prior(mart, T.day(T.TRAIN_END))
    return shown(O.seasonal_forecast(O.seasonal_forecast(mart, prior, 90), prior, 365), "seasonal_90", "seasonal_365")


_SCALER = "SELECT " + ", ".join(
    f"avg(ln(1 + {c})) AS {c}_mean, CASE WHEN stddev_pop(ln(1 + {c})) < 1e-8 THEN 1 ELSE stddev_pop(ln(1 + {c})) END AS {c}_std"
    for c in O.SEQUENCE_COUNTS) + """, count(*) AS fit_rows, max("date") AS fit_last_day FROM od WHERE "date" <= DATE '2024-01-15'"""


@query("train_scaler", "SELECT " + ", ".join(
    f"round({c}_{k}, 6) AS {c}_{k}" for c in O.SEQUENCE_COUNTS for k in ("mean", "std")) + f", fit_rows, fit_last_day FROM ({_SCALER})")
def train_scaler(spark, sf):
    return rounded(O.fit_scaler(T.object_mart(spark, sf), T.day(T.TRAIN_END)))


@query("sequence_windows", f"""
SELECT x.object_id, x."date", p.pos, coalesce(y.alarm_today, 0.0) AS alarm, round(coalesce((ln(1 + y.events_count) - events_count_mean) / events_count_std, 0), 6) + 0.0 AS events,
 CAST(y.object_id IS NOT NULL AS DOUBLE) AS present
FROM od x CROSS JOIN ({_SCALER}) CROSS JOIN (SELECT * FROM range(28)) p(pos)
LEFT JOIN od y ON y.object_id = x.object_id AND y.i = x.i - 27 + p.pos""")
def sequence_windows(spark, sf):
    mart = materialize(T.object_mart(spark, sf), "mart")
    windows = O.sequence_windows(mart, O.fit_scaler(mart, T.day(T.TRAIN_END)), 28)
    steps = windows.select("object_id", "date", F.posexplode("sequence").alias("pos", "v"))
    return shown(steps, "pos", F.col("v")[0].alias("alarm"), F.col("v")[6].alias("events"), F.col("v")[7].alias("present"))
