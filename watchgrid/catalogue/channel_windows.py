"""Channel window features and labels.

Short frames run on the dense journal grid (all channels, 30 days), long
frames on the seven-year history.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid.catalogue.registry import query, rounded
from watchgrid.functions.scalars import daily_rates
from watchgrid.operators import aggregate as A
from watchgrid.operators import features as W
from watchgrid.operators import joins as J
from watchgrid.operators import labels as L
from watchgrid.plans.calendar_fill import fill_calendar
from watchgrid.session import materialize
from watchgrid.sources import testtables as T

OVER = 'OVER (PARTITION BY channel_id ORDER BY "date"'


def run(expr: str) -> str:
    return f"{expr} {OVER})"


def frame(expr: str, days: int) -> str:
    return f"{expr} {OVER} ROWS BETWEEN {days - 1} PRECEDING AND CURRENT ROW)"


def shown(df, *columns, digits: int = 6):
    return rounded(df.select("channel_id", "date", *columns), digits)


_ROLLED = [f"{c}_sum_{k}d" for k in (3, 7, 14) for c in ("events_count", "alarm_count", "fault_count", "open_count")]


@query("rolling_sums", 'SELECT channel_id, "date", ' + ", ".join(
    f"CAST({frame(f'sum({c})', k)} AS BIGINT) AS {c}_sum_{k}d" for k in (3, 7, 14)
    for c in ("events_count", "alarm_count", "fault_count", "open_count")) + ", " + ", ".join(
    f"round(coalesce({frame('sum(alarm_count)', k)} / nullif({frame('sum(events_count)', k)}, 0), 0), 6) AS alarm_rate_{k}d"
    for k in (3, 7, 14)) + " FROM g")
def rolling_sums(spark, sf):
    return shown(W.compute(T.grid(spark, sf), W.rolling_family()), *_ROLLED, "alarm_rate_3d", "alarm_rate_7d", "alarm_rate_14d")


@query("rolling_sum_generic", f"""
SELECT channel_id, "date", CAST({frame('sum(alarm_count)', 60)} AS BIGINT) AS alarms_60d,
 CAST({frame('sum(events_count)', 180)} AS BIGINT) AS events_180d FROM lg""")
def rolling_sum_generic(spark, sf):
    return shown(T.long_grid(spark, sf), W.trailing("alarm_count", 60).alias("alarms_60d"),
                 W.trailing("events_count", 180).alias("events_180d"))


@query("days_since", 'SELECT channel_id, "date", ' + ", ".join(
    f"""coalesce(i - {run(f'max(CASE WHEN {m} = 1 THEN i END)')}, -1) AS days_since_{m}""" for m in ("alarm", "observed", "fault")) + " FROM g")
def days_since(spark, sf):
    return shown(W.compute(T.grid(spark, sf), W.days_since_family()), "days_since_alarm", "days_since_observed", "days_since_fault")


@query("active_day_rates", 'SELECT channel_id, "date", ' + ", ".join(
    f"CAST({frame('sum(alarm)', k)} AS BIGINT) AS alarm_days_{k}d, CAST({frame('sum(observed)', k)} AS BIGINT) AS observed_days_{k}d, "
    f"round({frame('sum(alarm)', k)} / least(i + 1, {k}), 6) AS alarm_day_rate_{k}d" for k in (3, 7, 28, 90)) + " FROM lg")
def active_day_rates(spark, sf):
    names = [f"{n}_{k}d" for k in (3, 7, 28, 90) for n in ("alarm_days", "observed_days", "alarm_day_rate")]
    return shown(W.compute(T.long_grid(spark, sf), W.active_days_family()), *names)


@query("running_history", f"""
SELECT channel_id, "date", {run('max(observed)')} AS seen_before_or_today,
 round({run('sum(alarm)')} / (i + 1), 6) AS historical_alarm_day_rate FROM g""")
def running_history(spark, sf):
    return shown(W.compute(T.grid(spark, sf), W.history_family()), "seen_before_or_today", "historical_alarm_day_rate")


@query("trends", f"""
SELECT channel_id, "date", round({frame('sum(alarm)', 7)} / least(i + 1, 7) - {frame('sum(alarm)', 28)} / least(i + 1, 28), 6) AS alarm_trend_7_28,
 round(events_count / (1 + {frame('sum(events_count)', 7)} / 7), 6) AS events_trend_1_7 FROM g""")
def trends(spark, sf):
    return shown(W.compute(T.grid(spark, sf), W.trend_family()), "alarm_trend_7_28", "events_trend_1_7")


def _others(keys: str, c: str, prefix: str) -> str:
    return (f'CAST(sum({c}) OVER (PARTITION BY {keys}, "date") - {c} AS BIGINT) AS {prefix}_{c}_others, '
            f'round((sum({c}) OVER (PARTITION BY {keys}, "date") - {c}) / (1 + sum(observed) OVER (PARTITION BY {keys}, "date") - observed), 6) AS {prefix}_{c}_rate')


@query("others_in_group", 'SELECT channel_id, "date", ' + ", ".join(
    [_others("object_id, sensor_type", c, "type_object") for c in ("alarm", "fault")]
    + [_others("parent", c, "parent") for c in ("alarm", "no_power")]
    + ['CAST(sum(events_count) OVER (PARTITION BY object_id, "date") - events_count AS BIGINT) AS object_events_count_others']) + " FROM gc")
def others_in_group(spark, sf):
    start, end = (T.day(d) for d in T.CALENDAR)
    days = T.channel_days(spark, sf).where(F.col("date").between(start, end)).select("channel_id", "date", "events_count", *W.masks())
    listed = T.channels(spark, sf).select("channel_id")
    rows = J.enrich(days.unionByName(listed, allowMissingColumns=True), T.catalog(spark, sf))
    df = rounded(W.others_in_groups(materialize(rows.drop("engineering_system", "object_kind"), "member_days"), {
        "type_object": (["object_id", "sensor_type"], ["alarm", "fault"], "observed"),
        "parent": (["parent"], ["alarm", "no_power"], "observed"),
        "object": (["object_id"], ["events_count"], None)}, start))
    # Rounded before the empty days, which are zeros, come in.
    return fill_calendar(df, None, "channel_id", start, end, df.columns[2:])


@query("lag_zero", 'SELECT channel_id, "date", ' + ", ".join(
    f"{run(f'lag(alarm, {n}, 0)')} AS alarm_lag_{n}" for n in (1, 2, 7, 14, 28)) + " FROM g")
def lag_zero(spark, sf):
    return shown(W.compute(T.grid(spark, sf), W.lag_family()), *[f"alarm_lag_{n}" for n in (1, 2, 7, 14, 28)])


@query("log_lags", 'SELECT channel_id, "date", ' + ", ".join(
    f"round({run(f'lag(ln(1 + {c}), {n})')}, 6) AS {c}_lag{n}" for c in ("fault_count", "no_power_count", "events_count") for n in (1, 2, 6)) + " FROM g")
def log_lags(spark, sf):
    return shown(W.compute(T.grid(spark, sf), W.log_lag_family()), *[
        f"{c}_lag{n}" for c in ("fault_count", "no_power_count", "events_count") for n in (1, 2, 6)])


_EWM = {f"{m}_ewm_{s}": (m, s) for m in ("alarm", "observed", "fault", "no_power") for s in (7, 28)} | {
    f"{c}_log_ewm{s}": (f"ln(1 + {c})", s) for c in ("events_count", "alarm_count") for s in (7, 28)}


# The oracle steps through the days of the long history one by one.
@query("ewm", "WITH RECURSIVE steps AS (SELECT channel_id, \"date\", i, " + ", ".join(
    f"CAST({x} AS DOUBLE) AS {n}" for n, (x, _) in _EWM.items()) + " FROM lg WHERE i = 0 UNION ALL SELECT lg.channel_id, lg.\"date\", lg.i, " + ", ".join(
    f"{2 / (s + 1)!r} * ({x.replace('(1 + ', '(1 + lg.') if '(' in x else 'lg.' + x}) + {1 - 2 / (s + 1)!r} * steps.{n}" for n, (x, s) in _EWM.items())
    + ' FROM steps JOIN lg ON lg.channel_id = steps.channel_id AND lg.i = steps.i + 1) SELECT channel_id, "date", '
    + ", ".join(f"round({n}, 6) AS {n}" for n in _EWM) + " FROM steps")
def ewm(spark, sf):
    return shown(W.ewm(T.long_grid(spark, sf)), *_EWM)


@query("streak", 'SELECT channel_id, "date", ' + ", ".join(
    f"CASE WHEN {m} = 1 THEN i - coalesce({run(f'max(CASE WHEN {m} = 0 THEN i END)')}, -1) ELSE 0 END AS {m}_streak" for m in W.MASKS)
    + f", CASE WHEN alarm = 0 THEN i - coalesce({run('max(CASE WHEN alarm = 1 THEN i END)')}, -1) ELSE 0 END AS quiet_streak FROM g")
def streak(spark, sf):
    return shown(W.compute(T.grid(spark, sf), W.streak_family()), *[f"{m}_streak" for m in W.MASKS], "quiet_streak")


@query("change_weekday_mean", 'SELECT channel_id, "date", ' + ", ".join(
    f"round(ln(1 + {c}) - {run(f'lag(ln(1 + {c}), 1, 0)')}, 6) + 0.0 AS {c}_change, round(("
    + " + ".join(run(f"lag(ln(1 + {c}), {n}, 0)") for n in (7, 14, 21, 28)) + f") / 4, 6) AS {c}_same_weekday_4w"
    for c in ("events_count", "alarm_count")) + " FROM g")
def change_weekday_mean(spark, sf):
    return shown(W.compute(T.grid(spark, sf), W.change_family()), "events_count_change", "events_count_same_weekday_4w",
                 "alarm_count_change", "alarm_count_same_weekday_4w")


def _prev(source: str) -> str:
    return f'(SELECT *, {run("lag(alarm)")} AS p FROM {source})'


def _part(expr: str, days: int) -> str:
    return f"sum(CASE WHEN {expr} THEN 1 ELSE 0 END) {OVER} ROWS BETWEEN {days - 1} PRECEDING AND CURRENT ROW)"


@query("transition_rates", f"""
SELECT channel_id, "date", round(({_part('p = 0 AND alarm = 1', 90)} + 1) / ({_part('p = 0', 90)} + 20), 6) AS transition_from_0,
 round(({_part('p = 1 AND alarm = 1', 90)} + 1) / ({_part('p = 1', 90)} + 20), 6) AS transition_from_1 FROM {_prev('lg')}""")
def transition_rates(spark, sf):
    return shown(W.compute(T.long_grid(spark, sf), W.transition_family()), "transition_from_0", "transition_from_1")


@query("alarm_dynamics", f"""
SELECT channel_id, "date", round({_part('alarm = 1', 28)} / (1 + {_part('observed = 1', 28)}), 6) AS alarm_rate_when_observed_28d,
 CAST({_part('p = 0 AND alarm = 1', 28)} AS BIGINT) AS alarm_starts_28d, CAST({_part('p <> alarm', 28)} AS BIGINT) AS alarm_switches_28d,
 round({_part('observed = 1', 7)} / 7 - {_part('observed = 1', 28)} / 28, 6) AS observation_change FROM {_prev('lg')}""")
def alarm_dynamics(spark, sf):
    return shown(W.compute(T.long_grid(spark, sf), W.dynamics_family()), "alarm_rate_when_observed_28d", "alarm_starts_28d",
                 "alarm_switches_28d", "observation_change")


def _past(c: str) -> str:
    return f"sum({c}) {OVER} ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)"


@query("numeric_regime", f"""
SELECT channel_id, "date", CASE WHEN n > 0 THEN round(s / n, 3) END AS numeric_past28_mean,
 CASE WHEN n > 0 THEN round(sqrt(greatest(q / n - (s / n) * (s / n), 0)), 3) END AS numeric_past28_std,
 CASE WHEN n > 0 AND numeric_count > 0 THEN round(greatest(-100, least(100,
  (value_sum / numeric_count - s / n) / (1 + sqrt(greatest(q / n - (s / n) * (s / n), 0))))), 3) END AS numeric_deviation
FROM (SELECT *, {_past('numeric_count')} AS n, {_past('value_sum')} AS s, {_past('value_sumsq')} AS q FROM lg)""")
def numeric_regime(spark, sf):
    return shown(W.compute(T.long_grid(spark, sf), W.numeric_family()), "numeric_past28_mean", "numeric_past28_std", "numeric_deviation", digits=3)


def grid_with_intraday(spark, sf):
    days = J.join_intraday(T.channel_days(spark, sf), A.intraday_daily(T.clean(spark, sf)))
    dense = J.fill_intraday(J.densify(days, T.channels(spark, sf), *[T.day(d) for d in T.CALENDAR]))
    rates = daily_rates()
    return W.with_masks(dense).withColumns({c: rates[c] for c in ("value_mean_1d", "value_std_1d")})


_GI = """(SELECT g.*, coalesce(intra_last_event_is_alarm, -1) AS intra_last_event_is_alarm,
 coalesce(intra_last_event_minute, -1) AS intra_last_event_minute, coalesce(intra_last_alarm_minute, -1) AS intra_last_alarm_minute
 FROM g LEFT JOIN intra USING (channel_id, "date"))"""


def _carry(c: str, condition: str) -> str:
    return run(f"last_value(CASE WHEN {condition} THEN {c} END IGNORE NULLS)")


def _known(c: str) -> str:
    return "numeric_count > 0" if c.startswith("value_") else "observed = 1"


@query("carry_last", 'SELECT channel_id, "date", ' + ", ".join(
    f"round(CAST({_carry(c, _known(c))} AS DOUBLE), 3) AS last_known_{c}" for c in W.CARRIED)
    + f", i - {_carry('i', 'observed = 1')} AS age_intra_last_event_is_alarm, i - {_carry('i', 'numeric_count > 0')} AS age_value_mean_1d FROM {_GI}")
def carry_last(spark, sf):
    out = W.carry_last(grid_with_intraday(spark, sf))
    names = [f"last_known_{c}" for c in W.CARRIED]
    return shown(out.withColumns({n: F.col(n).cast("double") for n in names}), *names,
                 "age_intra_last_event_is_alarm", "age_value_mean_1d", digits=3)


@query("minutes_since", f"""
SELECT channel_id, "date", round(CAST((i - {_carry('i', 'observed = 1')} + 1) * 1440 - {_carry('intra_last_event_minute', 'observed = 1')} AS DOUBLE), 6) AS minutes_since_event,
 round(CAST((i - {_carry('i', 'intra_last_alarm_minute >= 0')} + 1) * 1440 - {_carry('intra_last_alarm_minute', 'intra_last_alarm_minute >= 0')} AS DOUBLE), 6) AS minutes_since_alarm
FROM {_GI}""")
def minutes_since(spark, sf):
    return shown(W.minutes_since(grid_with_intraday(spark, sf)), "minutes_since_event", "minutes_since_alarm")


def _memory_sql(k: int) -> str:
    """Every earlier day with the same incoming context, weighted by its age."""
    code = "2 * alarm + observed"
    out = " + ".join(f"coalesce(lag({code}, {n}) OVER w, 0) * {4 ** n}" for n in range(k))
    came = " + ".join(f"coalesce(lag({code}, {n + 1}) OVER w, 0) * {4 ** n}" for n in range(k))
    w = "pow(0.5, (t.i - u.i) / 90.0)"
    # The smoothed base rate uses all days, the context only the matching ones.
    return f"""
SELECT channel_id, "date", {k} AS context_days, round((a + 10 * (pa + 0.1) / (pn + 10)) / (n + 10), 6) AS p_alarm,
 round((o + 10 * (po + 1) / (pn + 10)) / (n + 10), 6) AS p_observed, round(n, 6) AS support
FROM (SELECT t.channel_id, t."date",
 coalesce(sum({w}) FILTER (u.i >= {k} AND u.came = t.now), 0) AS n,
 coalesce(sum({w} * u.alarm) FILTER (u.i >= {k} AND u.came = t.now), 0) AS a,
 coalesce(sum({w} * u.observed) FILTER (u.i >= {k} AND u.came = t.now), 0) AS o,
 sum({w}) AS pn, sum({w} * u.alarm) AS pa, sum({w} * u.observed) AS po
 FROM ctx{k} t JOIN ctx{k} u ON u.channel_id = t.channel_id AND u.i <= t.i GROUP BY ALL)""", f"""
ctx{k} AS (SELECT channel_id, "date", i, alarm, observed, {out} AS now, {came} AS came FROM g
 WINDOW w AS (PARTITION BY channel_id ORDER BY "date"))"""


@query("context_memory", "WITH " + ", ".join(_memory_sql(k)[1] for k in (1, 2, 3)) + " UNION ALL ".join(_memory_sql(k)[0] for k in (1, 2, 3)))
def context_memory(spark, sf):
    out = W.context_memory(T.grid(spark, sf).select("channel_id", "date", "i", "alarm", "observed"))
    rows = F.explode(F.array(*[F.struct(
        F.lit(k).alias("context_days"), F.col(f"pattern{k}_alarm").alias("p_alarm"),
        F.col(f"pattern{k}_observed").alias("p_observed"), F.col(f"pattern{k}_support").alias("support")) for k in (1, 2, 3)]))
    return rounded(out.select("channel_id", "date", rows.alias("r")).select("channel_id", "date", "r.*"))


def _recurrence_sql(m: str) -> str:
    return f"""
SELECT channel_id, "date", '{m}' AS mask, i - {run('max(CASE WHEN hit = 1 THEN i END)')} AS age, {run('last_value(gap IGNORE NULLS)')} AS last_gap,
 round(CASE WHEN len(gaps) > 0 THEN list_reduce(gaps, lambda x, y: 0.7 * x + 0.3 * y) END, 6) AS gap_ema,
 round(CASE WHEN len(gaps) > 1 THEN list_stddev_pop(gaps) / (list_avg(gaps) + 1e-8) END, 5) AS gap_cv,
 round((i - {run('max(CASE WHEN hit = 1 THEN i END)')} + 1) / (CASE WHEN len(gaps) > 0 THEN list_reduce(gaps, lambda x, y: 0.7 * x + 0.3 * y) END + 1), 6) AS cycle_fraction
FROM (SELECT *, coalesce(list(CAST(gap AS DOUBLE)) FILTER (gap IS NOT NULL) {OVER}), []) AS gaps FROM (
 SELECT channel_id, "date", i, {m} AS hit, CASE WHEN {m} = 1 THEN i - max(CASE WHEN {m} = 1 THEN i END) {OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS gap FROM g))"""


@query("recurrence", " UNION ALL ".join(_recurrence_sql(m) for m in ("alarm", "observed")))
def recurrence(spark, sf):
    out = T.grid(spark, sf).select("channel_id", "date", "i", "alarm", "observed")
    for m in ("alarm", "observed"):
        out = W.recurrence(out, m)
    rows = F.explode(F.array(*[F.struct(
        F.lit(m).alias("mask"), F.col(f"{m}_age").alias("age"), F.col(f"{m}_last_gap").alias("last_gap"),
        F.col(f"{m}_gap_ema").alias("gap_ema"), F.round(f"{m}_gap_cv", 5).alias("gap_cv"),
        F.col(f"{m}_cycle_fraction").alias("cycle_fraction")) for m in ("alarm", "observed")]))
    return rounded(out.select("channel_id", "date", rows.alias("r")).select("channel_id", "date", "r.*"))


def _weekday_sql(m: str, weeks: int) -> str:
    total = " + ".join(run(f"lag({m}, {6 + 7 * n}, 0)") for n in range(weeks))
    exposure = " + ".join(f"CASE WHEN i >= {6 + 7 * n} THEN 1 ELSE 0 END" for n in range(weeks))
    return f"round(({total} + 0.1) / ({exposure} + 10), 6) AS {m}_tomorrow_weekday_{weeks}w"


@query("weekday_rate", 'SELECT channel_id, "date", ' + ", ".join(
    _weekday_sql(m, k) for m in ("alarm", "observed") for k in (4, 12)) + " FROM lg")
def weekday_rate(spark, sf):
    return shown(W.compute(T.long_grid(spark, sf), W.weekday_family()), *[
        f"{m}_tomorrow_weekday_{k}w" for m in ("alarm", "observed") for k in (4, 12)])


@query("window_rates", 'SELECT channel_id, "date", ' + ", ".join(
    f"round({frame(f'sum({m})', k)} / least(i + 1, {k}), 6) AS seq_{m}_rate_{k}d" for m in ("alarm", "observed") for k in (2, 5, 14, 60, 180)) + " FROM lg")
def window_rates(spark, sf):
    return shown(W.compute(T.long_grid(spark, sf), W.window_rate_family()), *[
        f"seq_{m}_rate_{k}d" for m in ("alarm", "observed") for k in (2, 5, 14, 60, 180)])


# --- labels -----------------------------------------------------------------------

@query("label_next_day", f"""
SELECT channel_id, "date", target FROM (SELECT channel_id, "date", i, {run('lead(alarm, 1, 0)')} AS target FROM g)
WHERE "date" < (SELECT max("date") FROM g)""")
def label_next_day(spark, sf):
    return shown(L.label_next_day(T.grid(spark, sf), T.day(T.CALENDAR[1])), "target")


@query("label_d2", f"SELECT channel_id, \"date\", {run('lead(alarm, 2)')} AS target FROM g")
def label_d2(spark, sf):
    return shown(L.label_lead(T.grid(spark, sf), "channel_id", F.col("alarm"), 2), "target")


@query("label_observed", f"SELECT channel_id, \"date\", {run('lead(observed, 1)')} AS observed_tomorrow FROM g")
def label_observed(spark, sf):
    return shown(L.label_observed(T.grid(spark, sf)), "observed_tomorrow")


_MART = ["events_trend_1_7", "alarm_trend_7_28", "alarm_streak", "days_since_alarm", "historical_alarm_day_rate",
         "alarm_lag_7", "alarm_starts_28d", "transition_from_0", "alarm_tomorrow_weekday_4w", "seq_alarm_rate_5d"]


@query("channel_mart", f"""
SELECT channel_id, "date", round(events_count / (1 + {frame('sum(events_count)', 7)} / 7), 6) AS events_trend_1_7,
 round({frame('sum(alarm)', 7)} / least(i + 1, 7) - {frame('sum(alarm)', 28)} / least(i + 1, 28), 6) AS alarm_trend_7_28,
 CASE WHEN alarm = 1 THEN i - coalesce({run('max(CASE WHEN alarm = 0 THEN i END)')}, -1) ELSE 0 END AS alarm_streak,
 coalesce(i - {run('max(CASE WHEN alarm = 1 THEN i END)')}, -1) AS days_since_alarm,
 round({run('sum(alarm)')} / (i + 1), 6) AS historical_alarm_day_rate, {run('lag(alarm, 7, 0)')} AS alarm_lag_7,
 CAST({_part('p = 0 AND alarm = 1', 28)} AS BIGINT) AS alarm_starts_28d,
 round(({_part('p = 0 AND alarm = 1', 90)} + 1) / ({_part('p = 0', 90)} + 20), 6) AS transition_from_0,
 {_weekday_sql('alarm', 4)}, round({frame('sum(alarm)', 5)} / least(i + 1, 5), 6) AS seq_alarm_rate_5d FROM {_prev('g')}""")
def channel_mart(spark, sf):
    """The wide mart as one chain: all windows share the partitioning of the grid."""
    return shown(W.channel_mart(T.grid(spark, sf)), *_MART)
