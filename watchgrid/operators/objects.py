"""Object-day mart, onset and episode features, and forecasts without a fitted model."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchgrid import vocab
from watchgrid.functions.scalars import log_count, ratio
from watchgrid.operators import aggregate as agg
from watchgrid.operators.features import running, since_last, streak
from watchgrid.operators.quality import expect_empty
from watchgrid.plans.calendar_fill import fill_calendar
from watchgrid.plans.decay import decayed_sum

def by_day():
    """Days of one object in order."""
    return Window.partitionBy("object_id").orderBy("date")


def object_mart(daily: DataFrame, channel_objects: DataFrame, objects: DataFrame,
                start: Column, end: Column, cutoff: Column | None = None,
                eligible: DataFrame | None = None) -> DataFrame:
    """Every eligible object on every day, with counters and catalog attributes.

    The population is either a given table of objects or, with ``cutoff``, the
    objects with a record up to that day.  The second form is decided inside
    the partitions of the object, without another pass over the journal.
    """
    facts = agg.object_daily(daily.where(F.col("date").between(start, end)), channel_objects)
    return mart_of(facts, attributes(objects, channel_objects), start, end, cutoff, eligible)


ATTRIBUTES = ["object_kind", "parent_id", "catalog_channels"]


def attributes(objects: DataFrame, channel_objects: DataFrame) -> DataFrame:
    """What the catalog says of each object that has channels."""
    return objects.select("object_id", F.coalesce("object_kind", F.lit("unknown")).alias("object_kind"),
                          F.coalesce("parent_id", F.lit("unknown")).alias("parent_id")).join(agg.catalog_channels(channel_objects), "object_id")


def mart_of(facts: DataFrame, attributes: DataFrame | None, start: Column, end: Column,
            cutoff: Column | None = None, eligible: DataFrame | None = None) -> DataFrame:
    """The mart from object-day counters.

    Facts that hold the attributes themselves go without ``attributes``: their ``object_id`` may stand for an
    object as seen at some time, with ``end`` an expression of it, and nothing is joined to their calendar.
    """
    carried = ATTRIBUTES if attributes is None else []
    counts = [c for c in facts.columns if c not in ("object_id", "date", *carried)]
    if eligible is not None:
        facts = facts.join(eligible.select("object_id"), "object_id", "left_semi")
    if cutoff is not None:
        seen = F.when(F.col("observed_channels") > 0, F.col("date"))
        facts = (facts.withColumn("_first", F.min(seen).over(Window.partitionBy("object_id")))
                 .where(F.col("_first") <= cutoff).drop("_first"))
    grid = fill_calendar(facts, None if eligible is None else eligible.select("object_id"),
                         "object_id", start, end, counts, carried)
    if attributes is not None:
        grid = grid.join(attributes, "object_id", "left")
    return grid.select(
        "object_id", "date", "object_kind", "parent_id", *counts, "catalog_channels",
        (F.col("alarm_channels") > 0).cast("int").alias("alarm_today"),
        (F.col("observed_channels") > 0).cast("int").alias("observed_today"),
        ratio(F.col("observed_channels"), F.col("catalog_channels")).alias("observed_fraction"),
        ratio(F.col("alarm_channels"), F.col("observed_channels")).alias("alarm_channel_fraction"))


def object_lags(mart: DataFrame, days: tuple[int, ...] = (1, 2, 7, 14)) -> DataFrame:
    return mart.select("*", *[F.lag(c, n).over(by_day()).alias(f"{c}_lag{n}")
                              for c in vocab.OBJECT_SIGNALS for n in days])


def with_signals(mart: DataFrame) -> DataFrame:
    """The 71 object features: lags, trailing means, history, streak and calendar."""
    means = [F.avg(c).over(by_day().rowsBetween(-(k - 1), 0)).alias(f"{c}_mean{k}")
             for c in vocab.OBJECT_SIGNALS for k in (3, 7, 28)]
    alarmed = F.col("alarm_today") == 1
    angle = F.lit(2 * math.pi) * F.dayofyear("date") / F.lit(365.25)
    numbered = object_lags(mart).select("*", *means, F.row_number().over(by_day()).alias("_n"))
    return numbered.select(
        "*", F.avg("alarm_today").over(running(by_day())).alias("historical_alarm_frequency"),
        streak(alarmed, by_day()).alias("alarm_streak"),
        since_last(alarmed, by_day()).alias("days_since_alarm"),
        F.weekday(F.date_add("date", 2)).alias("target_dayofweek"),
        F.sin(angle).alias("annual_sin"), F.cos(angle).alias("annual_cos")).drop("_n")


def onset_features(mart: DataFrame) -> DataFrame:
    """Onsets and clearances with their trailing means, frequency and age."""
    before, before2 = F.lag("alarm_today", 1).over(by_day()), F.lag("alarm_today", 2).over(by_day())
    today = F.col("alarm_today")
    df = mart.select(
        "*", F.when(before.isNotNull(), ((today == 1) & (before == 0)).cast("int")).alias("onset_today"),
        F.when(before.isNotNull(), ((today == 0) & (before == 1)).cast("int")).alias("clear_today"),
        (today + 2 * before + 4 * before2).alias("alarm_pattern3"))
    means = [F.avg(f"{p}_today").over(by_day().rowsBetween(-(k - 1), 0)).alias(f"{p}_mean{k}")
             for p in ("onset", "clear") for k in (7, 28)]
    return df.select(
        "*", *means, F.avg("onset_today").over(running(by_day())).alias("past_onset_frequency"),
        since_last(F.col("onset_today") == 1, by_day()).alias("days_since_onset"))


def recap_7d(mart: DataFrame) -> DataFrame:
    week = by_day().rowsBetween(-6, 0)
    return mart.select("*", F.sum("alarm_today").over(week).alias("alarm_days_7d"),
                       F.sum("observed_today").over(week).alias("observed_days_7d"))


def checked_history(history: DataFrame) -> DataFrame:
    """The history, if object-days are unique, states 0 or 1, and an alarm a record too; else an error."""
    states = F.coalesce(F.col("alarm_today").isin(0, 1) & F.col("observed_today").isin(0, 1), F.lit(False))
    proper = states & (F.col("alarm_today") <= F.col("observed_today")) & F.col("object_id").isNotNull() & F.col("date").isNotNull()
    expect_empty(history.where(~proper).select("object_id", "date", "alarm_today", "observed_today"), "improper object-days")
    expect_empty(history.groupBy("object_id", "date").agg(F.count("*").alias("rows")).where("rows > 1"), "repeated object-days")
    return history


def episode_labels(history: DataFrame, gap: int) -> DataFrame:
    """Episode starts after ``gap`` alarm-free calendar days.

    The frame is a range over day numbers, so missing days reduce the known
    context instead of moving it; such rows stay unknown (NULL).
    """
    if gap < 1:
        raise ValueError("gap must be at least one day")
    days = (Window.partitionBy("object_id").orderBy("_day").rangeBetween(-gap, -1))
    df = history.select("object_id", "date", "alarm_today", "observed_today",
                        F.unix_date("date").alias("_day"))
    df = df.select("*", F.count("*").over(days).alias("context_days"),
                   F.sum("alarm_today").over(days).alias("_alarms"),
                   F.sum("observed_today").over(days).alias("_records"))
    known = F.col("context_days") == gap
    onset = (F.col("alarm_today") == 1) & (F.col("_alarms") == 0)
    coverage = (F.when(~known, "unknown_context").when(F.col("_records") == gap, "records_every_gap_day")
                .when(F.col("_records") == 0, "no_records_in_gap").otherwise("records_some_gap_days"))
    return df.select(
        "object_id", "date", "alarm_today", "observed_today", F.lit(gap).alias("gap"), "context_days",
        known.cast("int").alias("context_known"),
        F.when(known, F.col("_alarms")).alias("gap_alarm_days"),
        F.when(known, F.col("_records")).alias("gap_record_days"),
        F.when(known, onset.cast("int")).alias("episode_start"),
        F.when(known, ((F.col("alarm_today") == 1) & ~onset).cast("int")).alias("repeat_alarm"),
        coverage.alias("gap_record_coverage"))


# --- priors and forecasts -------------------------------------------------------

def alarm_state() -> Column:
    """0 silent, 1 records without alarm, 2 alarm."""
    return F.when(F.col("alarm_today") == 1, 2).when(F.col("observed_today") == 1, 1).otherwise(0)


def markov_prior(mart: DataFrame, cutoff: Column) -> DataFrame:
    """Next-day state probabilities of the training period, one added to each count."""
    states = mart.where(F.col("date") <= cutoff).select(
        F.lag(alarm_state(), 1).over(by_day()).alias("from_state"), alarm_state().alias("to_state"))
    counted = states.where("from_state is not null").groupBy("from_state", "to_state").agg(F.count("*").alias("n"))
    pairs = mart.sparkSession.range(9).select(
        F.floor(F.col("id") / 3).cast("int").alias("from_state"), (F.col("id") % 3).cast("int").alias("to_state"))
    smoothed = pairs.join(counted, ["from_state", "to_state"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0)) + 1)
    return smoothed.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("from_state")))


def weekday_prior(mart: DataFrame, cutoff: Column) -> DataFrame:
    """Smoothed alarm rate of each weekday of the training period."""
    counted = (mart.where(F.col("date") <= cutoff).groupBy(F.weekday("date").alias("weekday"))
               .agg(F.sum("alarm_today").alias("pos"), F.count("*").alias("n")))
    days = mart.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
    joined = days.join(counted, "weekday", "left").fillna(0, ["pos", "n"])
    return joined.select("weekday", "pos", "n", ((F.col("pos") + 1) / (F.col("n") + 2)).alias("rate"))


def _as_array(df: DataFrame, order: list[str], value: str) -> Column:
    """A handful of prior rows as one array, read once as a scalar subquery."""
    return df.agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, value))),
                              lambda s: s[value]).alias("a")).scalar()


def markov_forecast(mart: DataFrame, prior: DataFrame, half_life: int, strength: float = 5.0) -> DataFrame:
    """Two-step alarm probability from decayed state transitions of each object."""
    decay = 2.0 ** (-1.0 / half_life)
    name = f"markov_{half_life}"
    base = mart.select("*", alarm_state().alias("_s"), F.lag(alarm_state(), 1).over(by_day()).alias("_p"),
                       (F.row_number().over(by_day()) - 1).alias("_i"), _as_array(prior, ["from_state", "to_state"], "probability").alias("_prior"))
    pairs = [(a, b) for a in range(3) for b in range(3)]

    def seen(a: int, b: int) -> Column:
        return F.coalesce((F.col("_p") == a) & (F.col("_s") == b), F.lit(False)).cast("int")

    counted = base.select("*", *[
        decayed_sum(seen(a, b), decay, F.col("_i"), running(by_day())).alias(f"_c{a}{b}") for a, b in pairs])
    step = counted.select("*", *[
        ((F.col(f"_c{a}{b}") + strength * F.col("_prior")[3 * a + b])
         / (F.col(f"_c{a}0") + F.col(f"_c{a}1") + F.col(f"_c{a}2") + strength)).alias(f"_t{a}{b}")
        for a, b in pairs])

    def two_steps(a: int) -> Column:
        return F.col(f"_t{a}0") * F.col("_t02") + F.col(f"_t{a}1") * F.col("_t12") + F.col(f"_t{a}2") * F.col("_t22")

    score = F.when(F.col("_s") == 0, two_steps(0)).when(F.col("_s") == 1, two_steps(1)).otherwise(two_steps(2))
    return step.select(*mart.columns, score.alias(name))


def seasonal_forecast(mart: DataFrame, prior: DataFrame, half_life: int, strength: float = 10.0) -> DataFrame:
    """Decayed alarm rate of the target weekday.

    The target weekday was last seen five days ago, so its state is the one of
    that day, five decay steps older.
    """
    decay = 2.0 ** (-1.0 / half_life)
    same = running(Window.partitionBy("object_id", "_wd").orderBy("date"))
    base = mart.select("*", F.weekday("date").alias("_wd"), (F.row_number().over(by_day()) - 1).alias("_i"),
                       _as_array(prior, ["weekday"], "rate").alias("_prior"))
    summed = base.select("*", decayed_sum(F.col("alarm_today"), decay, F.col("_i"), same).alias("_pos"),
                         decayed_sum(F.lit(1), decay, F.col("_i"), same).alias("_all"))
    older = summed.select("*", *[
        (F.coalesce(F.lag(c, 5).over(by_day()), F.lit(0.0)) * decay ** 5).alias(f"{c}_target") for c in ("_pos", "_all")])
    rate = F.col("_prior")[(F.col("_wd") + 2) % 7]
    return older.select(*mart.columns, (
        (F.col("_pos_target") + strength * rate) / (F.col("_all_target") + strength)).alias(f"seasonal_{half_life}"))


def _train_totals(cutoff: Column, label: str) -> tuple[Column, Column]:
    """Positives and labelled days of each object in the training period.

    A window over the object's own calendar: it shares the partitioning of the
    other object features, so nothing is aggregated and joined back.
    """
    whole = Window.partitionBy("object_id")
    train = F.when(F.col("date") <= cutoff, F.col(label))
    return F.coalesce(F.sum(train).over(whole), F.lit(0)), F.count(train).over(whole)


def frozen_frequency(labelled: DataFrame, cutoff: Column, label: str = "alarm_target") -> DataFrame:
    """Training-period label rate of each object, attached to every row."""
    pos, n = _train_totals(cutoff, label)
    return labelled.withColumn("frequency", ratio(pos, n))


def smoothed_frequency(labelled: DataFrame, cutoff: Column, label: str = "alarm_target",
                       strength: float = 30.0) -> DataFrame:
    """Label rate shrunk to the global rate; unknown objects get the global rate."""
    overall = labelled.where(F.col("date") <= cutoff).agg(F.avg(label)).scalar()
    pos, n = _train_totals(cutoff, label)
    rated = labelled.select("*", pos.alias("_pos"), n.alias("_n"), overall.alias("_g"))
    return rated.withColumn(
        "smoothed", (F.col("_pos") + strength * F.col("_g")) / (F.col("_n") + strength)).drop("_pos", "_n", "_g")


# --- sequences and designs --------------------------------------------------------

SEQUENCE_COUNTS = ["alarm_channels", "observed_channels", "fault_channels", "no_power_channels", "events_count"]


def fit_scaler(mart: DataFrame, cutoff: Column, columns: list[str] = SEQUENCE_COUNTS) -> DataFrame:
    """Mean and population deviation of log counts up to the cutoff, one row."""
    train = mart.where(F.col("date") <= cutoff)
    stats = []
    for c in columns:
        std = F.stddev_pop(F.log1p(c))
        stats += [F.avg(F.log1p(c)).alias(f"{c}_mean"), F.when(std < 1e-8, 1.0).otherwise(std).alias(f"{c}_std")]
    return train.agg(*stats, F.count("*").alias("fit_rows"), F.max("date").alias("fit_last_day"))


def sequence_windows(mart: DataFrame, scaler: DataFrame, length: int) -> DataFrame:
    """Last ``length`` daily vectors per row, zero-padded on the left.

    The last element of each vector is 1 for a real day: padding is not silence.
    """
    one = scaler.select(F.struct("*").alias("s")).scalar()
    scaled = [(F.log1p(c) - F.col("_s")[f"{c}_mean"]) / F.col("_s")[f"{c}_std"] for c in SEQUENCE_COUNTS]
    vector = F.array(*[F.col(c).cast("double") for c in ("alarm_today", "observed_today")], *scaled, F.lit(1.0))
    daily = mart.withColumn("_s", one).withColumn("_v", vector)
    recent = F.collect_list("_v").over(by_day().rowsBetween(-(length - 1), 0))
    width = 3 + len(SEQUENCE_COUNTS)
    pad = F.array_repeat(F.array(*[F.lit(0.0)] * width), length - F.size("_w"))
    return daily.withColumn("_w", recent).select(
        "object_id", "date", F.concat(pad, F.col("_w")).alias("sequence"))


ROW_INPUTS = [
    "alarm_today", "observed_today", "observed_fraction", "alarm_channel_fraction",
    "historical_alarm_frequency", "alarm_channels", "observed_channels", "fault_channels",
    "no_power_channels", "events_count", "catalog_channels", "alarm_streak", "days_since_alarm",
]
HISTORY_INPUTS = ([f"{c}_lag{n}" for c in vocab.OBJECT_SIGNALS for n in (1, 2, 7, 14)]
                  + [f"{c}_mean{k}" for c in vocab.OBJECT_SIGNALS for k in (3, 7, 28)])


def causal_design(signals: DataFrame) -> DataFrame:
    """Allow-listed predictors: counts on a log scale, shares as they are."""
    counts = {"catalog_channels", "alarm_streak", "days_since_alarm"}

    def is_count(name: str) -> bool:
        return name in counts or any(
            name == s or name.startswith(s + "_") for s in vocab.OBJECT_SIGNALS[1:])

    target = F.date_add("date", 2)
    week = F.lit(2 * math.pi) * F.weekday(target) / F.lit(7)
    year = F.lit(2 * math.pi) * (F.dayofyear(target) - 1) / F.lit(365.25)
    inputs = [(log_count(F.col(c)) if is_count(c) else F.col(c).cast("double")) for c in ROW_INPUTS + HISTORY_INPUTS]
    # greatest() skips NULL, an unknown lag must stay unknown.
    shown = [F.when(F.col(c).isNotNull(), x).alias(c) for c, x in zip(ROW_INPUTS + HISTORY_INPUTS, inputs)]
    return signals.select(
        "object_id", "date", *shown, (F.col("days_since_alarm") == -1).cast("int").alias("never_registered_alarm"),
        F.sin(week).alias("target_week_sin"), F.cos(week).alias("target_week_cos"),
        F.sin(year).alias("target_year_sin"), F.cos(year).alias("target_year_cos"),
        "object_kind", "parent_id")
