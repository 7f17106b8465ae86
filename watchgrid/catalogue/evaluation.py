"""Evaluation of scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid.catalogue.object_windows import _episode_sql
from watchgrid.catalogue.registry import query, rounded
from watchgrid.functions.draws import uniform_sql
from watchgrid.operators import bootstrap as B
from watchgrid.operators import evaluation as E
from watchgrid.operators import joins as J
from watchgrid.operators import labels as L
from watchgrid.operators import objects as O
from watchgrid.session import materialize
from watchgrid.sources import testtables as T


def confusion_sql(by: str, source: str, threshold: float, label: str = "alarm_target") -> str:
    w = f"score >= {threshold}"
    tp, p = f"count(*) FILTER ({w} AND {label} = 1)", f"count(*) FILTER ({label} = 1)"
    fp = f"count(*) FILTER ({w} AND {label} = 0)"
    return f"""
SELECT {by}, count(*) AS "rows", {p} AS positives, {tp} AS true_positive, {fp} AS false_positive, {p} - {tp} AS false_negative,
 count(DISTINCT "date") AS calendar_days, round({p} / count(*), 6) AS prevalence, round(coalesce({tp} / nullif({tp} + {fp}, 0), 0), 6) AS precision,
 round(coalesce({tp} / nullif({p}, 0), 0), 6) AS recall, round(coalesce(2 * {tp} / nullif({tp} + {fp} + {p}, 0), 0), 6) AS f1,
 round(({tp} + {fp}) / count(DISTINCT "date"), 6) AS alerts_per_day, round({fp} / count(DISTINCT "date"), 6) AS false_alerts_per_day
FROM {source} GROUP BY {by}"""


@query("confusion_metrics", confusion_sql("model", "scores", 0.3))
def confusion_metrics(spark, sf):
    return rounded(E.classification_metrics(T.scores(spark, sf), ["model"], "alarm_target", F.lit(0.3)))


def _curve(spark, sf):
    return E.pr_curve(T.scores(spark, sf), ["model"], "alarm_target")


@query("pr_curve", """
SELECT model, score, CAST(tp AS BIGINT) AS tp, CAST(pred AS BIGINT) AS warned, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM curve""")
def pr_curve(spark, sf):
    return rounded(_curve(spark, sf).select("model", "score", "tp", "warned", "precision", "recall", "f1"))


@query("average_precision", "SELECT model, round(sum(pos / p * precision), 6) AS average_precision FROM curve GROUP BY model")
def average_precision(spark, sf):
    return rounded(E.average_precision(_curve(spark, sf), ["model"]))


# The oracle compares every positive with every negative.
@query("roc_auc", """
SELECT a.model, round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END), 6) AS roc_auc
FROM scores a JOIN scores b ON a.model = b.model AND a.alarm_target = 1 AND b.alarm_target = 0 GROUP BY a.model""")
def roc_auc(spark, sf):
    return rounded(E.roc_auc(_curve(spark, sf), ["model"]))


@query("best_f1_threshold", """
SELECT model, score AS threshold, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall
FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, score) AS r FROM curve) WHERE r = 1""")
def best_f1_threshold(spark, sf):
    return rounded(E.best_threshold(_curve(spark, sf), ["model"]))


@query("operating_points", """
SELECT model, CAST(max(CASE WHEN precision > 0.4 AND recall > 0.3 THEN 1 ELSE 0 END) AS BIGINT) AS achievable,
 round(coalesce(max(recall) FILTER (precision > 0.4), 0), 6) AS max_recall_at_precision,
 arg_max(score, struct_pack(a := recall, b := -score)) FILTER (precision > 0.4) AS threshold_at_precision,
 round(max(precision) FILTER (recall > 0.3), 6) AS max_precision_at_recall FROM curve GROUP BY model""")
def operating_points(spark, sf):
    return rounded(E.operating_points(_curve(spark, sf), ["model"], 0.4, 0.3))


_COHORTS = """cohort_scores AS (SELECT 'all' AS cohort, * FROM scores UNION ALL SELECT 'no_alarm_today', * FROM scores WHERE alarm_today = 0
 UNION ALL SELECT 'observed_today', * FROM scores WHERE observed_today = 1),
sliced AS (SELECT *, CAST(date_trunc('week', "date" + 2) AS DATE) AS target_week FROM cohort_scores),
steps AS (SELECT model, cohort, target_week, sum(pos / nullif(p, 0) * tp / pred) AS ap FROM (
 SELECT *, sum(pos) OVER (w ORDER BY score DESC) AS tp, sum(n) OVER (w ORDER BY score DESC) AS pred, sum(pos) OVER w AS p
 FROM (SELECT model, cohort, target_week, score, sum(alarm_target) AS pos, count(*) AS n FROM sliced GROUP BY ALL)
 WINDOW w AS (PARTITION BY model, cohort, target_week)) GROUP BY ALL)"""


@query("slice_metrics", f"WITH {_COHORTS} " + """
SELECT s.model, s.cohort, s.target_week, count(*) AS "rows", CAST(sum(alarm_target) AS BIGINT) AS positives,
 round(coalesce(count(*) FILTER (score >= 0.3 AND alarm_target = 1) / nullif(count(*) FILTER (score >= 0.3), 0), 0), 6) AS precision,
 round(coalesce(count(*) FILTER (score >= 0.3 AND alarm_target = 1) / nullif(sum(alarm_target), 0), 0), 6) AS recall,
 round(coalesce(any_value(ap), 0), 6) AS average_precision
FROM sliced s LEFT JOIN steps t ON t.model = s.model AND t.cohort = s.cohort AND t.target_week = s.target_week GROUP BY ALL""")
def slice_metrics(spark, sf):
    week = F.to_date(F.date_trunc("week", F.date_add("date", 2)))
    rows = materialize(L.cohorts(T.scores(spark, sf)).withColumn("target_week", week), "slices")
    return rounded(E.slice_metrics(rows, ["model", "cohort", "target_week"], "alarm_target", F.lit(0.3)))


@query("budget_metrics", """
SELECT model, k, count(*) AS warnings, CAST(sum(alarm_target) AS BIGINT) AS tp, any_value(p) AS positives,
 round(sum(alarm_target) / count(*), 6) AS precision, round(sum(alarm_target) / any_value(p), 6) AS recall
FROM (SELECT *, row_number() OVER (PARTITION BY model, "date" ORDER BY score DESC, object_id) AS r,
 CAST(sum(alarm_target) OVER (PARTITION BY model) AS BIGINT) AS p FROM scores) JOIN (SELECT unnest([5, 10, 20]) AS k) ON r <= k GROUP BY model, k""")
def budget_metrics(spark, sf):
    return rounded(E.budget_metrics(T.scores(spark, sf), ["model"], "alarm_target"))


@query("warning_partition", """
SELECT model, count(*) AS "rows", count(DISTINCT "date") AS days, count(*) FILTER (r <= 10) AS warnings,
 count(*) FILTER (r <= 10 AND onset_target = 1) AS onset, count(*) FILTER (r <= 10 AND alarm_target = 1 AND onset_target = 0) AS repeat_alarm,
 count(*) FILTER (r <= 10 AND alarm_target = 0) AS no_alarm, CAST(sum(onset_target) AS BIGINT) AS onsets,
 round(count(*) FILTER (r <= 10 AND onset_target = 1) / count(*) FILTER (r <= 10), 6) AS precision_at_k,
 round(count(*) FILTER (r <= 10 AND onset_target = 1) / nullif(sum(onset_target), 0), 6) AS recall,
 round(count(*) FILTER (r <= 10) / count(DISTINCT "date"), 6) AS warnings_per_day
FROM (SELECT *, row_number() OVER (PARTITION BY model, "date" ORDER BY score DESC, object_id) AS r FROM scores) GROUP BY model""")
def warning_partition(spark, sf):
    return rounded(E.warning_partition(T.scores(spark, sf), ["model"], 10))


_EPISODES = f"""ep AS ({_episode_sql('(SELECT *, i AS d FROM od)', 3)}),
fe AS (SELECT s.model, s.score, s."date" + 2 AS target_date, od.alarm_today AS target_alarm, od.observed_today, m.observed_today AS between_records, ep.*
 FROM scores s JOIN od ON od.object_id = s.object_id AND od."date" = s."date" + 2 JOIN od m ON m.object_id = s.object_id AND m."date" = s."date" + 1
 JOIN ep ON ep.object_id = s.object_id AND ep."date" = s."date" + 2)"""


def _episode_counters(by: str) -> str:
    w, known = "score >= 0.3", "context_known = 1"

    def n(cond, name):
        return f"count(*) FILTER ({cond}) AS {name}"

    onset, every = "episode_start = 1", "gap_record_coverage = 'records_every_gap_day'"
    return f"""
SELECT {by}, count(*) AS "rows", count(DISTINCT target_date) AS target_calendar_days, {n(known, 'known_context_rows')}, {n('context_known = 0', 'unknown_context_rows')},
 {n('target_alarm = 1', 'alarm_days')}, {n(onset, 'registered_episode_starts')}, {n('repeat_alarm = 1', 'repeated_alarm_days')},
 {n(f'{w} AND {onset}', 'warned_episode_starts')}, {n(f'score < 0.3 AND {onset}', 'missed_episode_starts')}, {n(w, 'warnings_total')},
 {n(f'{w} AND repeat_alarm = 1', 'warnings_on_repeated_alarm_days')}, {n(f'{w} AND {known} AND target_alarm = 0', 'warnings_on_no_alarm_days')},
 {n(f'{w} AND context_known = 0', 'warnings_with_unknown_context')}, {n(f'{w} AND {known} AND NOT coalesce({onset}, false)', 'warnings_without_new_episode_known_context')},
 {n(f'{w} AND target_alarm = 1', 'any_alarm_true_warnings')}, {n(f'{onset} AND {every}', 'starts_with_records_every_gap_day')},
 {n(f'{onset} AND NOT ({every})', 'starts_with_some_record_free_gap_days')}, {n(f"{onset} AND gap_record_coverage = 'no_records_in_gap'", 'starts_with_no_records_in_gap')},
 round(count(*) FILTER ({w} AND {onset}) / nullif(count(*) FILTER ({onset}), 0), 6) AS episode_start_recall,
 round(count(*) FILTER ({w} AND {onset}) / nullif(count(*) FILTER ({w} AND {known}), 0), 6) AS episode_start_fraction_of_warnings,
 round(count(*) FILTER ({w} AND target_alarm = 1) / nullif(count(*) FILTER ({w}), 0), 6) AS original_any_alarm_precision,
 round(count(*) FILTER ({w} AND target_alarm = 1) / nullif(count(*) FILTER (target_alarm = 1), 0), 6) AS original_any_alarm_recall
FROM fe GROUP BY {by}"""


def episode_frame(spark, sf):
    """Forecasts with the episode labels of their exact target date."""
    mart = materialize(L.label_onset(T.object_mart(spark, sf)).select(
        "object_id", "date", "alarm_today", "observed_today", "alarm_target", "onset_target",
        "records_intermediate"), "mart")
    labels = O.episode_labels(mart, 3).drop("alarm_today", "observed_today").withColumnRenamed("date", "target_date")
    between = mart.select("object_id", F.col("date").alias("feature_date"), "records_intermediate")
    scored = T.scores(spark, sf).select("model", "object_id", "date", "alarm_target", "score")
    joined = J.join_forecasts(scored, mart.select("object_id", "date", "alarm_today", "observed_today"))
    return joined.join(labels, ["object_id", "target_date"]).join(between, ["object_id", "feature_date"])


@query("episode_metrics", f"WITH {_EPISODES} {_episode_counters('model')}")
def episode_metrics(spark, sf):
    return rounded(E.episode_metrics(episode_frame(spark, sf), ["model"], F.lit(0.3)))


@query("observability_strata", f"WITH {_EPISODES} {_episode_counters('model, between_records')}")
def observability_strata(spark, sf):
    frame = episode_frame(spark, sf).withColumnRenamed("records_intermediate", "between_records")
    return rounded(E.episode_metrics(frame, ["model", "between_records"], F.lit(0.3)))


@query("score_histogram", """
SELECT model, alarm_target, least(CAST(floor(score * 40) AS BIGINT), 39) AS bin, count(*) AS n,
 round(count(*) * 40 / sum(count(*)) OVER (PARTITION BY model, alarm_target), 6) AS density FROM scores GROUP BY 1, 2, 3""")
def score_histogram(spark, sf):
    return rounded(E.score_histogram(T.scores(spark, sf), ["model", "alarm_target"]))


@query("latency_distribution", """
SELECT event_type, count(*) AS "count", min(value) AS min, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50,
 quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max FROM events GROUP BY event_type""")
def latency_distribution(spark, sf):
    return rounded(E.distribution(T.table(spark, sf, "events").select("event_type", "value"), ["event_type"], "value"))


@query("weighted_ap", """
SELECT model, round(sum(pos / p * tp / pred), 6) AS average_precision FROM (
 SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY model ORDER BY score DESC) AS pred,
  sum(pos) OVER (PARTITION BY model) AS p FROM (
  SELECT model, score, sum(alarm_target * (day("date") % 4)) AS pos, sum(day("date") % 4) AS n FROM scores GROUP BY ALL) WHERE n > 0) GROUP BY model""")
def weighted_ap(spark, sf):
    counts = materialize(B.daily_score_counts(T.scores(spark, sf), "alarm_target"), "daily-counts")
    weights = counts.select("date").distinct().withColumn("weight", F.dayofmonth("date") % 4)
    return rounded(B.weighted_ap(counts, weights, ["model"]))


_PICKS = """picks AS (SELECT *, row_number() OVER (PARTITION BY model, "date" ORDER BY score DESC, object_id) <= 10 AS picked,
  date_trunc('week', "date" + 1) AS week, coalesce(onset_target, 0) = 1 AS onset FROM scores)"""


@query("week_block_bootstrap", f"""
WITH {_PICKS},
 weekly AS (SELECT *, row_number() OVER (ORDER BY week) - 1 AS i, count(*) OVER () AS m FROM (
  SELECT week, count(*) FILTER (picked AND onset AND model = 'smoothed') AS new_tp, count(*) FILTER (picked AND onset AND model = 'persistence') AS base_tp,
   count(*) FILTER (picked AND model = 'smoothed') AS warnings, count(*) FILTER (onset AND model = 'smoothed') AS onsets FROM picks GROUP BY week)),
 slots AS (SELECT draw, s.slot, {uniform_sql(84, 'draw', 's.slot')} % (SELECT max(m) FROM weekly) AS i
  FROM (SELECT unnest(range(1000)) AS draw) CROSS JOIN (SELECT unnest(range(1, (SELECT max(m) FROM weekly) + 1)) AS slot) s),
 sums AS (SELECT draw, sum(new_tp - base_tp) / nullif(sum(warnings), 0) AS p, sum(new_tp - base_tp) / nullif(sum(onsets), 0) AS r
  FROM slots JOIN weekly USING (i) GROUP BY draw)
SELECT m AS weeks, replicates, CASE WHEN m >= 2 THEN round(pl, 6) END AS precision_low, CASE WHEN m >= 2 THEN round(ph, 6) END AS precision_high,
 CASE WHEN m >= 2 THEN round(rl, 6) END AS recall_low, CASE WHEN m >= 2 THEN round(rh, 6) END AS recall_high, replicates_without_onsets,
 CAST(m < 8 AS BIGINT) AS few_weeks, round(gain / nullif(w, 0), 6) AS precision_difference, round(gain / nullif(o, 0), 6) AS recall_difference
FROM (SELECT count(*) AS replicates, quantile_cont(p, 0.025) AS pl, quantile_cont(p, 0.975) AS ph, quantile_cont(r, 0.025) AS rl, quantile_cont(r, 0.975) AS rh,
 count(*) FILTER (r IS NULL) AS replicates_without_onsets FROM sums),
 (SELECT max(m) AS m, sum(new_tp - base_tp) AS gain, sum(warnings) AS w, sum(onsets) AS o FROM weekly)""")
def week_block_bootstrap(spark, sf):
    weekly = materialize(B.weekly_sums(T.scores(spark, sf), ("smoothed", "persistence"), 10), "weekly")
    return rounded(B.week_bootstrap(weekly, draws=1000, seed=84))


@query("moving_block_bootstrap", f"""
WITH days AS (SELECT "date", row_number() OVER (ORDER BY "date") - 1 AS i FROM (SELECT DISTINCT "date" FROM scores)),
 size AS (SELECT count(*) AS m FROM days),
 spots AS (SELECT draw, ({uniform_sql(139, 'draw', 'spot // 7')} % m + spot % 7) % m AS i
  FROM size, (SELECT unnest(range(200)) AS draw), LATERAL (SELECT unnest(range(m)) AS spot)),
 weights AS (SELECT draw, "date", count(*) AS weight FROM spots JOIN days USING (i) GROUP BY ALL),
 drawn AS (SELECT model, draw, score, sum(alarm_target * weight) AS pos, sum(weight) AS n FROM scores JOIN weights USING ("date") GROUP BY ALL),
 ap AS (SELECT model, draw, sum(pos / p * tp / pred) AS ap FROM (
  SELECT *, sum(pos) OVER (PARTITION BY model, draw ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY model, draw ORDER BY score DESC) AS pred,
   sum(pos) OVER (PARTITION BY model, draw) AS p FROM drawn) GROUP BY model, draw)
SELECT a.model, count(*) AS draws, round(quantile_cont(a.ap - b.ap, 0.025), 6) AS lower, round(avg(a.ap - b.ap), 6) AS mean, round(quantile_cont(a.ap - b.ap, 0.975), 6) AS upper
FROM ap a JOIN ap b ON a.draw = b.draw AND b.model = 'persistence' WHERE a.model <> 'persistence' GROUP BY a.model""")
def moving_block_bootstrap(spark, sf):
    counts = materialize(B.daily_score_counts(T.scores(spark, sf), "alarm_target"), "daily-counts")
    return rounded(B.block_bootstrap(counts, "persistence", draws=200, length=7, seed=139))
