"""Metrics of scored rows: (model, ..., label, score) in long form.

Scores are first counted per distinct value with map-side combining.  Every
curve is then a running total over those counts (``plans.running``), never a
window over a whole model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchgrid.operators.quality import expect_empty
from watchgrid.functions.scalars import ratio
from watchgrid.plans.running import nearest_rank, running_totals
from watchgrid.session import materialize


def persistence(masked: DataFrame, states: list[str], leads: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Precision and recall of "today's state predicts an alarm in n days"."""
    w = Window.partitionBy("channel_id").orderBy("date")
    rows = masked.select(*states, *[F.lead("alarm", n).over(w).alias(f"_t{n}") for n in leads])
    cells = []
    for s in states:
        for n in leads:
            t = F.col(f"_t{n}")
            known = F.when(t.isNotNull(), F.col(s))
            cells.append(F.struct(
                F.lit(s).alias("state"), F.lit(n).alias("lead_days"), F.count(t).alias("rows"),
                F.sum(known).alias("predicted"), F.sum(t).alias("positives"), F.sum(known * t).alias("hits")))
    out = rows.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    return out.withColumns({"precision": ratio(F.col("hits"), F.col("predicted")),
                            "recall": ratio(F.col("hits"), F.col("positives"))})


def classification_metrics(rows: DataFrame, by: list[str], label: str, threshold: Column) -> DataFrame:
    """Counts and rates at a threshold, and alerts per calendar day."""
    warned, hit = F.col("score") >= threshold, F.col(label) == 1
    per_day = rows.groupBy(*by, "date").agg(
        F.count("*").alias("n"), F.count_if(hit).alias("p"), F.count_if(warned & hit).alias("tp"),
        F.count_if(warned & ~hit).alias("fp"))
    out = per_day.groupBy(*by).agg(
        F.sum("n").alias("rows"), F.sum("p").alias("positives"), F.sum("tp").alias("true_positive"),
        F.sum("fp").alias("false_positive"), F.count("*").alias("calendar_days"))
    tp, fp, p = F.col("true_positive"), F.col("false_positive"), F.col("positives")
    return out.select(
        *by, "rows", "positives", "true_positive", "false_positive", (p - tp).alias("false_negative"), "calendar_days",
        ratio(p, F.col("rows")).alias("prevalence"), ratio(tp, tp + fp, 0).alias("precision"),
        ratio(tp, p, 0).alias("recall"), ratio(2 * tp, tp + fp + p, 0).alias("f1"),
        ratio(tp + fp, F.col("calendar_days")).alias("alerts_per_day"),
        ratio(fp, F.col("calendar_days")).alias("false_alerts_per_day"))


def score_counts(rows: DataFrame, by: list[str], label: str, weight: Column | None = None) -> DataFrame:
    """Positives and rows per distinct score, optionally weighted."""
    weight = F.lit(1).cast("long") if weight is None else weight
    return rows.groupBy(*by, "score").agg(
        F.sum(F.when(F.col(label) == 1, weight).otherwise(F.lit(0))).alias("pos"), F.sum(weight).alias("n"))


def curve(counts: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall and F1 when warning at or above each distinct score."""
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("positives"), F.sum("n").alias("rows"))
    steps = running_totals(counts, by, [-F.col("score")], {"tp": F.col("pos"), "warned": F.col("n")})
    joined = steps.join(totals, by)
    return joined.select(
        *by, "score", "pos", "n", "tp", "warned", "positives", "rows",
        ratio(F.col("tp"), F.col("warned")).alias("precision"),
        ratio(F.col("tp"), F.col("positives")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("warned") + F.col("positives")).alias("f1"))


def pr_curve(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """Curve of scored rows; the counts are written once, several passes follow."""
    return curve(materialize(score_counts(rows, by, label), "score-counts"), by)


def average_precision(steps: DataFrame, by: list[str]) -> DataFrame:
    """Step-wise average precision, ties taken together; 0 without positives."""
    return steps.groupBy(*by).agg(
        F.coalesce(F.sum(ratio(F.col("pos"), F.col("positives")) * F.col("precision")), F.lit(0.0))
        .alias("average_precision"))


def roc_auc(steps: DataFrame, by: list[str]) -> DataFrame:
    """Probability that a positive outranks a negative, ties counted half."""
    negatives = F.col("n") - F.col("pos")
    above = F.col("tp") - F.col("pos")
    won = F.sum(negatives * (above + 0.5 * F.col("pos")))
    pairs = F.max(F.col("positives").cast("double") * (F.col("rows") - F.col("positives")))
    return steps.groupBy(*by).agg(F.try_divide(won, pairs).alias("roc_auc"))


def best_threshold(steps: DataFrame, by: list[str]) -> DataFrame:
    """Threshold of the highest F1, the lowest one on ties."""
    best = F.max(F.struct("f1", (-F.col("score")).alias("t"), "precision", "recall"))
    return steps.groupBy(*by).agg(best.alias("b")).select(
        *by, (-F.col("b.t")).alias("threshold"), F.col("b.f1").alias("f1"),
        F.col("b.precision").alias("precision"), F.col("b.recall").alias("recall"))


def operating_points(steps: DataFrame, by: list[str], precision: float = 0.7, recall: float = 0.5) -> DataFrame:
    """Whether both goals can be met, and the best reachable points for each."""
    precise, complete = F.col("precision") > precision, F.col("recall") > recall
    point = F.max(F.when(precise, F.struct("recall", (-F.col("score")).alias("t"))))
    return steps.groupBy(*by).agg(
        F.max((precise & complete).cast("int")).alias("achievable"),
        F.coalesce(F.max(F.when(precise, F.col("recall"))), F.lit(0.0)).alias("max_recall_at_precision"),
        point.alias("p"), F.max(F.when(complete, F.col("precision"))).alias("max_precision_at_recall"),
    ).select(*by, "achievable", "max_recall_at_precision",
             (-F.col("p.t")).alias("threshold_at_precision"), "max_precision_at_recall")


def slice_metrics(rows: DataFrame, by: list[str], label: str, threshold: Column) -> DataFrame:
    """Average precision with precision and recall at a threshold, per slice."""
    steps = pr_curve(rows, by, label)
    ap = average_precision(steps, by)
    at = classification_metrics(rows, by, label, threshold).select(
        *by, "rows", "positives", "precision", "recall")
    return at.join(ap, by)


# --- fixed daily budgets ----------------------------------------------------------

def day_order() -> list[Column]:
    """Score descending, ties by the identity as text."""
    return [F.desc("score"), F.col("object_id").cast("string").asc()]


def expect_full_days(rows: DataFrame, by: list[str], limit: int) -> None:
    """Raise where a day has fewer than ``limit`` rows to choose from."""
    short = rows.groupBy(*by, "date").agg(F.count("*").alias("rows")).where(F.col("rows") < limit)
    expect_empty(short, f"days with fewer than {limit} rows")


def daily_rank(rows: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The ``limit`` best rows of each day; the rest is cut before the shuffle.

    A day with fewer rows gives what it has; ``expect_full_days`` refuses it.
    """
    w = Window.partitionBy(*by, "date").orderBy(*day_order())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def budget_metrics(rows: DataFrame, by: list[str], label: str, budgets: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Precision and recall when warning the same number of objects each day."""
    chosen = daily_rank(rows, by, max(budgets))
    fits = F.explode(F.filter(F.array(*[F.lit(k) for k in budgets]), lambda k: k >= F.col("rank")))
    hits = chosen.select(*by, label, fits.alias("k")).groupBy(*by, "k").agg(
        F.count("*").alias("warnings"), F.count_if(F.col(label) == 1).alias("tp"))
    totals = rows.groupBy(*by).agg(F.count_if(F.col(label) == 1).alias("positives"))
    return hits.join(totals, by).select(
        *by, "k", "warnings", "tp", "positives", ratio(F.col("tp"), F.col("warnings")).alias("precision"),
        ratio(F.col("tp"), F.col("positives")).alias("recall"))


def warning_partition(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """Daily warnings split into onsets, repeated alarms and no alarm."""
    chosen = daily_rank(rows, by, k)
    onset, alarm = F.col("onset_target") == 1, F.col("alarm_target") == 1
    out = chosen.groupBy(*by).agg(
        F.count("*").alias("warnings"), F.count_if(onset).alias("onset"),
        F.count_if(alarm & ~onset).alias("repeat_alarm"), F.count_if(~alarm).alias("no_alarm"))
    per_day = rows.groupBy(*by, "date").agg(F.count("*").alias("n"), F.count_if(onset).alias("o"))
    totals = per_day.groupBy(*by).agg(
        F.sum("n").alias("rows"), F.count("*").alias("days"), F.sum("o").alias("onsets"))
    return out.join(totals, by).select(
        *by, "rows", "days", "warnings", "onset", "repeat_alarm", "no_alarm", "onsets",
        ratio(F.col("onset"), F.col("warnings")).alias("precision_at_k"),
        ratio(F.col("onset"), F.col("onsets")).alias("recall"),
        ratio(F.col("warnings"), F.col("days")).alias("warnings_per_day"))


def episode_metrics(rows: DataFrame, by: list[str], threshold: Column) -> DataFrame:
    """Warnings against registered episode starts, including unknown context.

    ``rows`` carry score, target_date, target_alarm and the episode labels of
    the target date.
    """
    warned = F.col("score") >= threshold
    known = F.col("context_known") == 1
    alarm = F.col("target_alarm") == 1
    onset = F.coalesce(F.col("episode_start") == 1, F.lit(False))
    repeat = F.coalesce(F.col("repeat_alarm") == 1, F.lit(False))
    coverage = F.col("gap_record_coverage")
    conditions = {
        "known_context_rows": known, "unknown_context_rows": ~known, "alarm_days": alarm,
        "registered_episode_starts": onset, "repeated_alarm_days": repeat,
        "warned_episode_starts": warned & onset, "missed_episode_starts": onset & ~warned,
        "warnings_total": warned, "warnings_on_repeated_alarm_days": warned & repeat,
        "warnings_on_no_alarm_days": warned & known & ~alarm, "warnings_with_unknown_context": warned & ~known,
        "warnings_without_new_episode_known_context": warned & known & ~onset,
        "warnings_known_context": warned & known, "any_alarm_true_warnings": warned & alarm,
        "starts_with_records_every_gap_day": onset & (coverage == "records_every_gap_day"),
        "starts_with_some_record_free_gap_days": onset & (coverage != "records_every_gap_day"),
        "starts_with_no_records_in_gap": onset & (coverage == "no_records_in_gap"),
    }
    per_day = rows.groupBy(*by, "target_date").agg(
        F.count("*").alias("rows"), *[F.count_if(c).alias(n) for n, c in conditions.items()])
    out = per_day.groupBy(*by).agg(
        F.sum("rows").alias("rows"), F.count("*").alias("target_calendar_days"),
        *[F.sum(n).alias(n) for n in conditions])
    c = F.col
    return out.withColumns({
        "episode_start_recall": ratio(c("warned_episode_starts"), c("registered_episode_starts")),
        "episode_start_fraction_of_warnings": ratio(c("warned_episode_starts"), c("warnings_known_context")),
        "original_any_alarm_precision": ratio(c("any_alarm_true_warnings"), c("warnings_total")),
        "original_any_alarm_recall": ratio(c("any_alarm_true_warnings"), c("alarm_days")),
    }).drop("warnings_known_context")


def score_histogram(rows: DataFrame, by: list[str], bins: int = 40) -> DataFrame:
    """Density of scores in equal bins of [0, 1]; 1 falls into the last bin."""
    index = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    counted = rows.groupBy(*by, index.alias("bin")).agg(F.count("*").alias("n"))
    totals = counted.groupBy(*by).agg(F.sum("n").alias("_total"))
    return counted.join(totals, by).select(
        *by, "bin", "n", (F.col("n") * bins / F.col("_total")).alias("density"))


def distribution(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, extremes, mean and nearest-rank percentiles per group."""
    counts = materialize(rows.groupBy(*by, value).agg(F.count("*").alias("n")), "value-counts")
    probs = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    ranks = nearest_rank(counts, by, value, "n", list(probs.values())).groupBy(*by).agg(*[
        F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for n, p in probs.items()])
    base = counts.groupBy(*by).agg(
        F.sum("n").alias("count"), F.min(value).alias("min"),
        (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"), F.max(value).alias("max"))
    return base.join(ranks, by)
