"""Enrichment, population and comparison joins.

No join is hinted.  Dictionaries are broadcast when the optimizer or the
adaptive runtime measures them below ``autoBroadcastJoinThreshold``; larger ones
take a sort-merge join with skew handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchgrid import vocab
from watchgrid.plans.calendar_fill import fill_calendar

ATTRIBUTES = ["engineering_system", "sensor_type", "object_id", "object_kind"]


def enrich(facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Dictionary attributes of each channel; unknown ones get the fixed text."""
    known = catalog.select("channel_id", *ATTRIBUTES, F.coalesce("parent_id", F.lit("root")).alias("parent"))
    joined = facts.join(known, "channel_id", "left")
    return joined.select(*facts.columns, *[
        F.coalesce(c, F.lit(vocab.NOT_IN_DICTIONARY)).alias(c) for c in ATTRIBUTES],
        F.coalesce("parent", F.lit("unknown")).alias("parent"))


def densify(daily: DataFrame, catalog: DataFrame, start: Column | None = None,
            end: Column | None = None) -> DataFrame:
    """Every logged or listed channel on every day between the bounds.

    Counts are 0 and value extremes NULL on days without records.  Bounds
    default to the first and last day of the data.
    """
    start = daily.agg(F.min("date")).scalar() if start is None else start
    end = daily.agg(F.max("date")).scalar() if end is None else end
    zero = [c for c in vocab.DAILY_SUMS if c in daily.columns]
    return fill_calendar(daily, catalog.select("channel_id").distinct(), "channel_id", start, end, zero)


def split_population(daily: DataFrame, channel_objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """Channel-days labelled 'unknown', 'outside' or 'included'."""
    known = channel_objects.select("channel_id", "object_id")
    chosen = wanted.select("object_id").distinct().withColumn("_in", F.lit(True))
    joined = daily.join(known, "channel_id", "left").join(chosen, "object_id", "left")
    return joined.withColumn(
        "population", F.when(F.col("object_id").isNull(), "unknown")
        .when(F.col("_in").isNull(), "outside").otherwise("included")).drop("_in")


def population_counts(split: DataFrame) -> DataFrame:
    return split.groupBy("population").agg(
        F.count("*").alias("channel_days"), F.count_if(F.col("alarm_count") > 0).alias("alarm_channel_days"))


def eligible_objects(daily: DataFrame, channel_objects: DataFrame, cutoff: Column) -> DataFrame:
    """Objects with a record on or before the cutoff: the population is fixed first."""
    seen = daily.where(F.col("date") <= cutoff).select("channel_id").distinct()
    return channel_objects.join(seen, "channel_id", "left_semi").select("object_id").distinct()


def join_prior(grid: DataFrame, prior: DataFrame) -> DataFrame:
    """Frozen history of each channel; NULL for channels without one."""
    return grid.join(prior, "channel_id", "left")


def join_intraday(days: DataFrame, intraday: DataFrame) -> DataFrame:
    """Within-day columns of each channel-day.

    Join the sparse days before laying them out on the calendar: both sides
    come out of their aggregation partitioned by (channel, date), so the join
    moves nothing.  ``fill_intraday`` then completes the empty days.
    """
    columns = [c for c in intraday.columns if c.startswith("intra_")]
    return fill_intraday(days.join(intraday.select("channel_id", "date", *columns), ["channel_id", "date"], "left"))


def fill_intraday(days: DataFrame) -> DataFrame:
    """-1 for unknown minutes, states and ties, 0 for counts."""
    columns = [c for c in days.columns if c.startswith("intra_")]
    return days.fillna({c: (0 if "count" in c or "events_last" in c else -1) for c in columns})


def join_forecasts(predictions: DataFrame, labels: DataFrame, lead: int = 2) -> DataFrame:
    """Forecasts with the outcome of the exact target date.

    ``matched`` is false where no label row exists for that date; ``agrees``
    compares the target saved with the forecast to the realised one.
    """
    outcome = labels.select("object_id", F.col("date").alias("target_date"),
                            F.col("alarm_today").alias("target_alarm"),
                            F.col("observed_today").alias("target_has_records"))
    dated = (predictions.withColumnRenamed("date", "feature_date")
             .withColumn("target_date", F.date_add("feature_date", lead))
             .withColumn("issue_date", F.date_add("feature_date", 1)))
    joined = dated.join(outcome, ["object_id", "target_date"], "left")
    return joined.withColumn("matched", F.col("target_alarm").isNotNull()).withColumn(
        "agrees", F.col("alarm_target").eqNullSafe(F.col("target_alarm")))


def join_lagged(facts: DataFrame, context: DataFrame, days: int = 7, keys: list[str] = ()) -> DataFrame:
    """Daily context as known ``days`` earlier; keeps ``source_date`` for auditing."""
    shifted = context.withColumn("date", F.date_add("source_date", days))
    return facts.join(shifted, [*keys, "date"], "left")


def dictionary_coverage(channel_ids: DataFrame, catalog: DataFrame, objects: DataFrame) -> DataFrame:
    """Ids present on one side only, both ways, as (direction, ids)."""
    used = catalog.join(channel_ids, "channel_id", "left_semi").select("object_id").distinct()
    listed = objects.select("object_id").distinct()
    parts = {
        "channels_in_log_only": channel_ids.join(catalog, "channel_id", "left_anti"),
        "channels_in_dictionary_only": catalog.select("channel_id").distinct().join(channel_ids, "channel_id", "left_anti"),
        "objects_in_log_only": used.join(listed, "object_id", "left_anti"),
        "objects_in_dictionary_only": listed.join(used, "object_id", "left_anti"),
    }
    counted = [df.agg(F.lit(name).alias("direction"), F.count("*").alias("ids")) for name, df in parts.items()]
    out = counted[0]
    for df in counted[1:]:
        out = out.unionByName(df)
    return out


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Cell-by-cell comparison of two versions of a table, one row per column."""
    a = left.select(*keys, F.struct(*columns).alias("l"))
    b = right.select(*keys, F.struct(*columns).alias("r"))
    joined = a.join(b, keys, "full_outer")
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    per_column = []
    for c in columns:
        x, y = F.col(f"l.{c}"), F.col(f"r.{c}")
        per_column.append(F.struct(
            F.lit(c).alias("column_name"),
            F.count_if(both & ~x.eqNullSafe(y)).alias("mismatches"),
            F.max(F.when(both, F.abs(x - y))).cast("double").alias("max_abs_difference"),
            F.sum(x).cast("double").alias("left_total"), F.sum(y).cast("double").alias("right_total")))
    wide = joined.agg(
        F.count_if(F.col("r").isNull()).alias("left_only"),
        F.count_if(F.col("l").isNull()).alias("right_only"),
        F.count_if(both).alias("common"), F.array(*per_column).alias("cells"))
    return wide.select("left_only", "right_only", "common", F.explode("cells").alias("c")).select(
        "c.*", "left_only", "right_only", "common")


def reproduce(new: DataFrame, archived: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Whether archived scores are reproduced: equal keys, differences within tolerance."""
    joined = new.select(*keys, F.col("score").alias("a")).join(
        archived.select(*keys, F.col("score").alias("b")), keys, "full_outer")
    return joined.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unmatched"),
        F.max(F.abs(F.col("a") - F.col("b"))).alias("max_difference"),
        F.count_if(F.abs(F.col("a") - F.col("b")) > tolerance).alias("beyond_tolerance"))


def align_scores(predictions: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One row per key with one score column per model; keys must match in all."""
    out = None
    for model, df in predictions.items():
        part = df.select(*keys, F.col("score").alias(model))
        out = part if out is None else out.join(part, keys, "full_outer")
    return out
