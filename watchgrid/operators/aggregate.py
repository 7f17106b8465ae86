"""Reductions of the journal to channel-days, object-days and profiles.

All counters are additive, so Spark combines them before the shuffle: a channel
that writes a third of all records still sends one row per task and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchgrid import vocab
from watchgrid.functions import parsing as P
from watchgrid.functions.scalars import or_default, population_std, ratio


def _count(flag: Column) -> Column:
    return F.sum(flag.cast("long"))


def _kind_counts(suffix: str) -> list[Column]:
    """Counts of value kinds, negative numbers and sentinels."""
    sentinel = P.sql_list(vocab.SENTINELS)
    counts = {"numeric": "kind = 'numeric'", "text": "kind = 'text'", "missing": "kind = 'missing'",
              "negative": "value < 0", "sentinel": f"value IN ({sentinel})"}
    return [F.expr(f"count_if({c}) AS {n}_{suffix}") for n, c in counts.items()]


def daily_aggregates() -> list[Column]:
    states = [F.expr(f"count_if(state_word = '{t}') AS {n}") for n, t in vocab.TEXT_STATES.items()]
    return [
        F.expr("count(*) AS events_count"), F.expr("sum(cast(is_alarm AS bigint)) AS alarm_count"),
        *_kind_counts("count"), *states,
        F.expr("coalesce(sum(value), 0D) AS value_sum"), F.expr("coalesce(sum(value * value), 0D) AS value_sumsq"),
        F.expr("min(value) AS value_min"), F.expr("max(value) AS value_max"),
    ]


def with_state_word(clean: DataFrame) -> DataFrame:
    """Lower-cased text of non-numeric values, computed once for all state counters."""
    return clean.withColumn("state_word", F.expr("CASE WHEN kind = 'text' THEN lower(value_text) END"))


def channel_daily(clean: DataFrame) -> DataFrame:
    """Counters, state counts and value moments per channel and day."""
    return with_state_word(clean).groupBy("channel_id", "date").agg(*daily_aggregates())


def combine_daily(parts: DataFrame) -> DataFrame:
    """Merge partial channel-days of several deliveries; order does not matter."""
    return parts.groupBy("channel_id", "date").agg(
        *[F.sum(c).alias(c) for c in vocab.DAILY_SUMS],
        F.min("value_min").alias("value_min"), F.max("value_max").alias("value_max"))


def with_order_key(clean: DataFrame) -> DataFrame:
    """Add ``order_key``: numeric id and alarm flag packed into one integer.

    Records without a whole-number id come first, alarms last among equal ids.  A
    decimal of fixed width keeps the aggregation hash-based and cannot overflow:
    ids have up to 37 digits.
    """
    number = "coalesce(try_cast(event_id AS decimal(37,0)), -9999999999999999999999999999999999999BD)"
    return clean.withColumn("order_key", F.expr(f"cast(2 * {number} + cast(is_alarm AS int) AS decimal(38,0))"))


def second_aggregates() -> list[Column]:
    """Per-second counts with the first and last record."""
    return [F.expr(e) for e in (
        "count(*) AS events", "sum(is_alarm) AS alarms", "min(order_key) AS first_key", "max(order_key) AS last_key")]


def intraday_aggregates() -> list[Column]:
    """Evening activity, first and last record, from per-second counts."""
    return [F.expr(e) for e in (
        "sum(if(second >= 64800, alarms, 0)) AS intra_alarm_count_last6h",
        "sum(if(second >= 43200, alarms, 0)) AS intra_alarm_count_last12h",
        "sum(if(second >= 64800, events, 0)) AS intra_events_last6h",
        "max_by(events, second) - 1 AS intra_last_timestamp_ties",
        "min(second) / 60D AS intra_first_event_minute",
        "cast(pmod(min_by(first_key, second), 2) AS int) AS intra_first_event_is_alarm",
        "max(second) / 60D AS intra_last_event_minute",
        "cast(pmod(max_by(last_key, second), 2) AS int) AS intra_last_event_is_alarm",
        "coalesce(max(if(alarms > 0, second, NULL)) / 60D, -1D) AS intra_last_alarm_minute")]


def intraday_daily(clean: DataFrame) -> DataFrame:
    """Within-day picture of each channel-day.

    Records are first combined per second, which bounds a channel-day to 86,400
    rows whatever it wrote and spreads a hot channel over many tasks.  Days
    without any valid time drop out at the end: an early filter would be pushed
    into the scan and parse every time twice.
    """
    seconds = with_order_key(clean).groupBy("channel_id", "date", "second").agg(*second_aggregates())
    days = seconds.groupBy("channel_id", "date").agg(*intraday_aggregates())
    return days.where("intra_last_event_minute IS NOT NULL")


def intraday_parts(clean: DataFrame) -> DataFrame:
    """What a share of a channel-day's records tells of the within-day picture; ``combine_intraday`` puts shares together."""
    seconds = with_order_key(clean).groupBy("channel_id", "date", "second").agg(*second_aggregates()).where("second IS NOT NULL")
    return seconds.groupBy("channel_id", "date").agg(*[F.expr(e) for e in (
        "sum(if(second >= 64800, alarms, 0)) AS alarms_6h", "sum(if(second >= 43200, alarms, 0)) AS alarms_12h",
        "sum(if(second >= 64800, events, 0)) AS events_6h", "min(struct(second, first_key)) AS first", "max(second) AS last_second",
        "max_by(last_key, second) AS last_key", "max_by(events, second) AS last_events", "max(if(alarms > 0, second, NULL)) AS last_alarm")])


def combine_intraday(parts: DataFrame) -> DataFrame:
    """Merge shares of channel-days of several deliveries; order does not matter."""
    # Shares that end in the same second add up there first.
    ends = parts.groupBy("channel_id", "date", "last_second").agg(
        *[F.sum(c).alias(c) for c in ("alarms_6h", "alarms_12h", "events_6h", "last_events")],
        F.min("first").alias("first"), F.max("last_key").alias("last_key"), F.max("last_alarm").alias("last_alarm"))
    return ends.groupBy("channel_id", "date").agg(*[F.expr(e) for e in (
        "sum(alarms_6h) AS intra_alarm_count_last6h", "sum(alarms_12h) AS intra_alarm_count_last12h", "sum(events_6h) AS intra_events_last6h",
        "max_by(last_events, last_second) - 1 AS intra_last_timestamp_ties", "min(first).second / 60D AS intra_first_event_minute",
        "cast(pmod(min(first).first_key, 2) AS int) AS intra_first_event_is_alarm", "max(last_second) / 60D AS intra_last_event_minute",
        "cast(pmod(max_by(last_key, last_second), 2) AS int) AS intra_last_event_is_alarm",
        "coalesce(max(last_alarm) / 60D, -1D) AS intra_last_alarm_minute")])


def object_daily(daily: DataFrame, channel_objects: DataFrame, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """Counters and numbers of reporting channels per object and day (or whatever ``by`` names)."""
    joined = daily.join(channel_objects.select("channel_id", "object_id"), "channel_id")
    flags = {"observed_channels": "events_count", "alarm_channels": "alarm_count",
             "fault_channels": "fault_count", "no_power_channels": "no_power_count"}
    return joined.groupBy("object_id", *by).agg(
        *[F.sum(c).alias(c) for c in vocab.MODEL_COUNTERS],
        *[F.count_if(F.col(c) > 0).alias(name) for name, c in flags.items()])


def catalog_channels(channel_objects: DataFrame) -> DataFrame:
    return channel_objects.groupBy("object_id").agg(
        F.count_distinct("channel_id").alias("catalog_channels"))


def _percent(part: Column, whole: Column) -> Column:
    return ratio(part * 100, whole)


def year_summary(clean: DataFrame) -> DataFrame:
    """One row per year: volume, alarms, value kinds and value moments."""
    value = F.col("value")
    per_channel = clean.groupBy(F.year("date").alias("year"), "channel_id").agg(
        F.count("*").alias("rows"), _count(F.col("is_alarm")).alias("alarms"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        *_kind_counts("rows"),
        _count(F.col("alarm_status") == "invalid").alias("invalid_alarm"),
        _count(F.col("second").isNull()).alias("invalid_time"),
        F.min("value").alias("value_min"), F.max("value").alias("value_max"),
        F.sum("value").alias("s1"), F.sum(value * value).alias("s2"))
    sums = ["rows", "alarms", "numeric_rows", "text_rows", "missing_rows", "negative_rows",
            "sentinel_rows", "invalid_alarm", "invalid_time"]
    years = per_channel.groupBy("year").agg(
        *[F.sum(c).alias(c) for c in sums], F.count("*").alias("channels"),
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"),
        F.min("value_min").alias("value_min"), F.max("value_max").alias("value_max"),
        F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    return years.select(
        "year", *sums, "channels", "first_date", "last_date", "value_min", "value_max",
        _percent(F.col("alarms"), F.col("rows")).alias("alarm_percent"),
        ratio(F.col("s1"), F.col("numeric_rows")).alias("value_mean"),
        F.when(F.col("numeric_rows") > 1, population_std(F.col("s1"), F.col("s2"), F.col("numeric_rows")))
        .alias("value_std"))


def _domain(spark, values: list) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias("unit"))


def time_profile(clean: DataFrame, unit: str) -> DataFrame:
    """Rows, alarms and alarm share by month, by hour (24) or by weekday (7)."""
    keys = {"month": F.date_format("date", "yyyy-MM"),
            "hour": F.floor(F.col("second") / 3600).cast("int"),
            "weekday": F.weekday("date")}
    counted = (clean.select(keys[unit].alias("unit"), "is_alarm").where("unit is not null")
               .groupBy("unit").agg(F.count("*").alias("rows"), _count(F.col("is_alarm")).alias("alarms")))
    if unit != "month":
        every = _domain(clean.sparkSession, list(range(24 if unit == "hour" else 7)))
        counted = every.join(counted, "unit", "left").fillna(0, ["rows", "alarms"])
    return counted.withColumn("alarm_percent", _percent(F.col("alarms"), F.col("rows")))


def time_profiles(clean: DataFrame) -> DataFrame:
    """profile, unit, rows, alarms and alarm share by month, hour and weekday from one pass over the records.

    Records are combined by (date, hour) first: what remains is bounded by the calendar.
    """
    hours = clean.groupBy("date", F.floor(F.col("second") / 3600).cast("int").alias("hour")).agg(
        F.count("*").alias("rows"), _count(F.col("is_alarm")).alias("alarms"))
    units = F.explode(F.array(
        F.struct(F.lit("month").alias("profile"), F.date_format("date", "yyyy-MM").alias("unit")),
        F.struct(F.lit("hour").alias("profile"), F.col("hour").cast("string").alias("unit")),
        F.struct(F.lit("weekday").alias("profile"), F.weekday("date").cast("string").alias("unit"))))
    counted = (hours.select(units.alias("u"), "rows", "alarms").where("u.unit IS NOT NULL")
               .groupBy("u.profile", "u.unit").agg(F.sum("rows").alias("rows"), F.sum("alarms").alias("alarms")))
    every = [_domain(clean.sparkSession, [str(v) for v in range(n)]).select(F.lit(p).alias("profile"), "unit")
             for p, n in (("hour", 24), ("weekday", 7))]
    empty = every[0].unionByName(every[1]).select("profile", "unit", F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("alarms"))
    whole = counted.unionByName(empty).groupBy("profile", "unit").agg(F.sum("rows").alias("rows"), F.sum("alarms").alias("alarms"))
    return whole.withColumn("alarm_percent", _percent(F.col("alarms"), F.col("rows")))


def dimension_summary(clean: DataFrame, catalog: DataFrame, dimension: str) -> DataFrame:
    """Rows, share, alarms and alarm share by a dictionary attribute.

    Records are combined per channel first, so the join never sees the raw
    journal and a hot channel costs one row.
    """
    per_channel = clean.groupBy("channel_id").agg(
        F.count("*").alias("rows"), _count(F.col("is_alarm")).alias("alarms"))
    known = catalog.select("channel_id", F.col(dimension).alias("_d"), F.lit(True).alias("_known"))
    name = F.when(F.col("_known"), or_default(F.col("_d"), vocab.UNSPECIFIED)).otherwise(vocab.NOT_IN_DICTIONARY)
    groups = (per_channel.join(known, "channel_id", "left")
              .groupBy(name.alias(dimension))
              .agg(F.sum("rows").alias("rows"), F.sum("alarms").alias("alarms")))
    total = per_channel.agg(F.sum("rows")).scalar()
    return groups.select(dimension, "rows", "alarms",
                         _percent(F.col("rows"), total).alias("share_percent"),
                         _percent(F.col("alarms"), F.col("rows")).alias("alarm_percent"))


def channel_profile(clean: DataFrame) -> DataFrame:
    """Totals, value kinds, active span and value statistics per channel."""
    value = F.col("value")
    base = clean.groupBy("channel_id").agg(
        F.count("*").alias("rows"), _count(F.col("is_alarm")).alias("alarms"),
        *_kind_counts("rows"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.min("value").alias("value_min"), F.max("value").alias("value_max"),
        F.sum("value").alias("s1"), F.sum(value * value).alias("s2"))
    days = F.datediff("last_date", "first_date") + 1
    n = F.col("numeric_rows")
    return base.select(
        "channel_id", "rows", "alarms", "numeric_rows", "text_rows", "missing_rows",
        "negative_rows", "sentinel_rows", "first_date", "last_date", "value_min", "value_max",
        days.alias("active_days"),
        _percent(F.col("alarms"), F.col("rows")).alias("alarm_percent"),
        _percent(n, F.col("rows")).alias("numeric_percent"),
        ratio(F.col("rows"), days).alias("events_per_day"),
        ratio(F.col("s1"), n).alias("value_mean"),
        F.when(n > 1, population_std(F.col("s1"), F.col("s2"), n)).alias("value_std"))


def value_kinds(clean: DataFrame) -> DataFrame:
    kinds = ["numeric", "text", "missing"]
    counted = clean.groupBy(F.year("date").alias("year")).agg(
        F.count("*").alias("rows"), *[_count(F.col("kind") == k).alias(k) for k in kinds])
    return counted.select("year", "rows", *kinds, *[
        _percent(F.col(k), F.col("rows")).alias(f"{k}_percent") for k in kinds])


def missing_by_column(raw: DataFrame, by: Column) -> DataFrame:
    """Blank cells per group and column."""
    cols = [c for c in vocab.JOURNAL_COLUMNS if c in raw.columns]
    wide = raw.groupBy(by.alias("part")).agg(
        F.count("*").alias("rows"),
        *[_count(F.coalesce(F.trim(c), F.lit("")) == "").alias(c) for c in cols])
    long = wide.unpivot(["part", "rows"], cols, "column_name", "blank_cells")
    return long.withColumn("blank_percent", _percent(F.col("blank_cells"), F.col("rows")))


def approx_duplicates(clean: DataFrame) -> DataFrame:
    """Estimated repeated record ids per year from a mergeable distinct sketch."""
    counted = clean.groupBy(F.year("date").alias("year")).agg(
        F.count("*").alias("rows"),
        F.approx_count_distinct("event_id", rsd=0.0087).alias("distinct_ids"))
    return counted.withColumn("estimated_duplicates",
                              F.greatest(F.col("rows") - F.col("distinct_ids"), F.lit(0).cast("long")))


#: log2 of a sketch's registers and the standard error that goes with it.
SKETCH_SIZE = 14
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_SIZE / 2)


def sketch_files(clean: DataFrame, file: Column) -> DataFrame:
    """file_name, year, rows and a distinct sketch of the record ids: one row for each file and year."""
    return clean.groupBy(file.alias("file_name"), F.year("date").alias("year")).agg(
        F.count("*").alias("rows"), F.hll_sketch_agg("event_id", SKETCH_SIZE).alias("sketch"))


def store_sketches(sketches: DataFrame, path: str) -> None:
    """Keep the sketches of new files beside those there; a file that comes again replaces its own."""
    (sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_name").parquet(path))


def merged_duplicates(sketches: DataFrame) -> DataFrame:
    """Estimated repeated record ids per year from stored sketches: no record is read again when files arrive."""
    merged = sketches.groupBy("year").agg(
        F.countDistinct("file_name").alias("files"), F.sum("rows").alias("rows"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_ids"))
    return merged.withColumn("estimated_duplicates", F.greatest(F.col("rows") - F.col("distinct_ids"), F.lit(0).cast("long")))


def exact_duplicates(clean: DataFrame) -> DataFrame:
    """Exact count of surplus records per year: two combined aggregations."""
    per_id = clean.groupBy(F.year("date").alias("year"), "event_id").agg(F.count("*").alias("n"))
    return per_id.groupBy("year").agg(
        F.sum("n").alias("rows"), F.count("*").alias("distinct_ids"),
        F.sum(F.col("n") - 1).alias("duplicate_rows"))


PROFILE_FEATURES = [
    "rows", "numeric_rows", "numeric_percent", "text_rows", "missing_rows",
    "negative_rows", "sentinel_rows", "active_days", "events_per_day",
    "value_mean", "value_std", "value_min", "value_max",
]


def _guarded_corr(x: str, y: str) -> Column:
    # corr() divides by zero on a constant column.
    varied = (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0) & (F.count("*") >= 3)
    return F.when(varied, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def _correlation_input(profile: DataFrame, min_rows: int) -> DataFrame:
    return profile.where(F.col("rows") >= min_rows).select(*[
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in [*PROFILE_FEATURES, "alarm_percent"]])


def target_correlations(profile: DataFrame, min_rows: int = 100) -> DataFrame:
    """Pearson correlation of 13 channel features with the alarm share."""
    rows = _correlation_input(profile, min_rows)
    wide = rows.agg(*[_guarded_corr(c, "alarm_percent").alias(c) for c in PROFILE_FEATURES])
    return wide.unpivot([], PROFILE_FEATURES, "feature", "pearson")


def correlation_matrix(profile: DataFrame, min_rows: int = 100) -> DataFrame:
    """All feature pairs from one pass; one row per feature."""
    rows = _correlation_input(profile, min_rows)
    wide = rows.agg(*[
        F.struct(*[_guarded_corr(a, b).alias(b) for b in PROFILE_FEATURES]).alias(a)
        for a in PROFILE_FEATURES])
    cells = F.array(*[F.struct(F.lit(a).alias("feature"), F.col(a).alias("c")) for a in PROFILE_FEATURES])
    return wide.select(F.explode(cells).alias("r")).select("r.feature", "r.c.*")


def quality_kpis(clean: DataFrame, catalog: DataFrame, objects: DataFrame) -> DataFrame:
    """Headline numbers as (kpi, value) rows."""
    per_channel = clean.groupBy("channel_id").agg(
        F.count("*").alias("rows"), _count(F.col("is_alarm")).alias("alarms"))
    known = catalog.select("channel_id", "object_id")
    joined = per_channel.join(known.withColumn("_known", F.lit(True)), "channel_id", "left").join(
        objects.select("object_id", F.lit(True).alias("_object")), "object_id", "left")
    wide = joined.agg(
        F.sum("rows").cast("double").alias("total_rows"),
        F.sum("alarms").cast("double").alias("total_alarms"),
        _percent(F.sum("alarms"), F.sum("rows")).alias("alarm_percent"),
        F.count_if(F.col("_known").isNull()).cast("double").alias("channels_without_dictionary"),
        F.count_distinct(F.when(F.col("_object").isNull(), F.col("object_id"))).cast("double")
        .alias("objects_without_dictionary"))
    return wide.unpivot([], wide.columns, "kpi", "value")


def state_days(daily: DataFrame) -> DataFrame:
    """Days and channels on which each state was seen, with and without an alarm."""
    masks = {"alarm": F.col("alarm_count") > 0, "fault": F.col("fault_count") > 0,
             "no_power": F.col("no_power_count") > 0, "undefined": F.col("undefined_count") > 0}
    shown = F.array_compact(F.array(*[F.when(m, F.lit(k)) for k, m in masks.items()]))
    rows = daily.select("channel_id", F.explode(shown).alias("state"), masks["alarm"].alias("alarmed"))
    per_channel = rows.groupBy("state", "channel_id").agg(
        F.count("*").alias("days"), F.count_if(~F.col("alarmed")).alias("quiet"))
    return per_channel.groupBy("state").agg(
        F.sum("days").alias("days"), F.count("*").alias("channels"),
        F.sum("quiet").alias("days_without_alarm"))


# --- frozen history -----------------------------------------------------------

_PROFILE_SUMS = [*vocab.DAILY_COUNTERS, "value_sum", "value_sumsq"]


def year_profile(daily: DataFrame, counters: list[str] = _PROFILE_SUMS) -> DataFrame:
    """Additive history of each channel and year."""
    return daily.groupBy("channel_id", F.year("date").alias("year")).agg(
        *[F.sum(c).alias(c) for c in counters],
        F.count_if(F.col("alarm_count") > 0).alias("alarm_days"),
        F.count_if(F.col("fault_count") > 0).alias("fault_days"),
        F.count_if(F.col("no_power_count") > 0).alias("no_power_days"),
        F.count("*").alias("observed_days"),
        F.min("date").alias("first_observed"), F.max("date").alias("last_observed"),
        F.max(F.when(F.col("alarm_count") > 0, F.col("date"))).alias("last_alarm"))


def channel_prior(profiles: DataFrame, cutoff: Column) -> DataFrame:
    """Frozen per-channel history before ``cutoff``, merged from year profiles."""
    keys = {"channel_id", "year", "first_observed", "last_observed", "last_alarm"}
    sums = [c for c in profiles.columns if c not in keys]
    merged = profiles.groupBy("channel_id").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.min("first_observed").alias("first_observed"), F.max("last_observed").alias("last_observed"),
        F.max("last_alarm").alias("last_alarm"), F.count_distinct("year").alias("observed_years"))
    n = F.col("numeric_count")
    days = F.col("observed_days")
    return merged.select(
        "channel_id", days.alias("old_observed_days"), F.col("alarm_days").alias("old_alarm_days"),
        F.col("fault_days").alias("old_fault_days"), F.col("no_power_days").alias("old_no_power_days"),
        F.col("events_count").alias("old_events"), F.col("alarm_count").alias("old_alarm_events"),
        F.col("observed_years").alias("old_years_observed"),
        F.datediff(cutoff, "last_observed").alias("old_last_observed_days"),
        F.coalesce(F.datediff(cutoff, "last_alarm"), F.lit(-1)).alias("old_last_alarm_days"),
        ((F.col("alarm_days") + 1) / (days + 2)).alias("old_alarm_days_per_observed_day"),
        ratio(F.col("alarm_count"), F.col("events_count")).alias("alarm_event_rate"),
        ratio(F.col("alarm_days"), days).alias("alarm_observed_day_rate"),
        ratio(F.col("fault_days"), days).alias("fault_observed_day_rate"),
        ratio(F.col("no_power_days"), days).alias("no_power_observed_day_rate"),
        ratio(F.col("events_count"), days).alias("events_per_observed_day"),
        ratio(F.col("value_sum"), n).alias("numeric_mean"),
        population_std(F.col("value_sum"), F.col("value_sumsq"), n).alias("numeric_std"))


def history_summary(daily: DataFrame) -> DataFrame:
    per_channel = daily.groupBy(F.year("date").alias("year"), "channel_id").agg(
        F.count("*").alias("rows"), F.sum("events_count").alias("records"),
        F.sum("alarm_count").alias("alarms"), F.sum("fault_count").alias("faults"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return per_channel.groupBy("year").agg(
        F.sum("rows").alias("rows"), F.count("*").alias("channels"),
        F.sum("records").alias("records"), F.sum("alarms").alias("alarms"), F.sum("faults").alias("faults"),
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))


def target_distribution(rows: DataFrame, label: str) -> DataFrame:
    """Rows by split and label, one column per label, 0 where empty."""
    return (rows.groupBy("split")
            .agg(F.count_if(F.col(label) == 0).alias("negatives"),
                 F.count_if(F.col(label) == 1).alias("positives"),
                 F.count_if(F.col(label).isNull()).alias("unlabelled")))
