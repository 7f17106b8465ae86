"""Adapter from the benchmark's star-schema tables to journal-shaped inputs.

``events`` plays the journal (one row per record, ``user_id`` the channel),
``customer`` the channel dictionary.  Customers with a negative balance are not
in the dictionary, so that unknown channels exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid.operators import aggregate as agg
from watchgrid.operators import features, joins, labels
from watchgrid.operators import objects as objects_ops
from watchgrid.session import materialize
from watchgrid.sources import catalogs
from watchgrid.sources.journal import clean_journal

CALENDAR = ("2024-01-01", "2024-01-30")
TRAIN_END = "2024-01-15"
TUNE = ("2024-01-18", "2024-01-22")
TEST = ("2024-01-25", "2024-01-28")


def day(text: str):
    return F.lit(text).cast("date")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def journal(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return journal_columns(e)


def journal_columns(e: DataFrame) -> DataFrame:
    """All-text records with the dirt of a real export: odd words, commas, sentinels, blanks."""
    return e.selectExpr(
        "cast(event_id AS string) AS event_id", "cast(user_id AS string) AS channel_id",
        "date_format(ts, 'yyyy-MM-dd') AS date", "date_format(ts, 'HH:mm:ss') AS time",
        """CASE WHEN event_type = 'error' AND value > 100
             THEN CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN ' True ' WHEN 2 THEN 'да' ELSE '1' END
             ELSE CASE event_id % 5 WHEN 0 THEN 'false' WHEN 1 THEN '0' WHEN 2 THEN 'Нет' WHEN 3 THEN '' ELSE 'unk' END
           END AS alarm_raw""",
        """CASE event_id % 12 WHEN 0 THEN '' WHEN 1 THEN 'Неисправен' WHEN 2 THEN ' обесточен ' WHEN 3 THEN 'Норма'
             WHEN 4 THEN '-999' WHEN 5 THEN '1d' WHEN 6 THEN concat('-', cast(value AS string))
             ELSE replace(cast(value AS string), '.', ',') END AS sensor_value""")


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return clean_journal(journal(spark, sf))


def channels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where("c_acctbal >= 0").selectExpr(
        "cast(c_custkey AS string) AS channel_id", "c_mktsegment AS engineering_system",
        "concat('s', cast(c_custkey % 4 AS string)) AS sensor_type",
        "cast(c_custkey DIV 6 AS string) AS object_id")


def objects(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "customer").selectExpr("c_custkey DIV 6 AS n").distinct()
    return ids.selectExpr(
        "cast(n AS string) AS object_id", "concat('object ', cast(n AS string)) AS object_name",
        "CASE WHEN n % 7 <> 3 THEN concat('k', cast(n % 3 AS string)) END AS object_kind",
        "CASE WHEN n % 11 <> 5 THEN cast(n DIV 5 AS string) END AS parent_id")


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    return catalogs.load_catalog(channels(spark, sf), objects(spark, sf))


def channel_days(spark: SparkSession, sf: str) -> DataFrame:
    return agg.channel_daily(clean(spark, sf))


def long_history(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse nation-days of all orders, 1995 to 2001: a long calendar."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    urgent = (F.col("o_orderpriority") == "1-URGENT").cast("int")
    late = (F.col("o_orderstatus") == "F").cast("int")
    return (o.join(c, o.o_custkey == c.c_custkey)
            .groupBy(F.col("c_nationkey").cast("string").alias("channel_id"),
                     F.to_date("o_orderdate").alias("date"))
            .agg(F.count("*").alias("events_count"), F.sum(urgent).alias("alarm_count"),
                 F.sum(late).alias("fault_count"), F.sum(1 - late).alias("no_power_count"),
                 F.count("*").alias("numeric_count"),
                 F.round(F.sum(F.col("o_totalprice") / 1000), 6).alias("value_sum"),
                 F.round(F.sum(F.pow(F.col("o_totalprice") / 1000, F.lit(2))), 6).alias("value_sumsq")))


def eligible(spark: SparkSession, sf: str) -> DataFrame:
    return joins.eligible_objects(channel_days(spark, sf), channels(spark, sf), day(TRAIN_END))


def object_mart(spark: SparkSession, sf: str) -> DataFrame:
    return objects_ops.object_mart(
        channel_days(spark, sf), channels(spark, sf), objects(spark, sf),
        *[day(d) for d in CALENDAR], cutoff=day(TRAIN_END))


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """Dense channel-days with masks over the known calendar."""
    dense = joins.densify(channel_days(spark, sf), channels(spark, sf), *[day(d) for d in CALENDAR])
    return features.with_masks(dense)


def long_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Dense long history with masks; bounds come from the data."""
    facts = long_history(spark, sf)
    return features.with_masks(joins.densify(facts, facts.select("channel_id").distinct()))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return labels.label_onset(object_mart(spark, sf))


def wide_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Frozen scores of four simple models on the evaluation days."""
    rows = objects_ops.smoothed_frequency(
        objects_ops.frozen_frequency(labelled(spark, sf), day(TRAIN_END)), day(TRAIN_END))
    smooth = F.round("smoothed", 6)
    return rows.where(F.col("date").between(day(TUNE[0]), day(TEST[1]))).select(
        "object_id", "date", "alarm_target", "onset_target", "alarm_today", "observed_today",
        F.col("alarm_today").cast("double").alias("persistence"),
        F.round("frequency", 6).alias("frequency"), smooth.alias("smoothed"),
        F.round(0.4 * smooth + 0.6 * F.col("alarm_today"), 6).alias("blend"))


MODELS = ["persistence", "frequency", "smoothed", "blend"]


def score_table(spark: SparkSession, sf: str) -> DataFrame:
    """The scores written once: metrics pass over them several times, not over the journal."""
    return materialize(wide_scores(spark, sf), "scores")


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """The same scores in long form: (model, object_id, date, labels, score)."""
    wide = score_table(spark, sf)
    keys = [c for c in wide.columns if c not in MODELS]
    return wide.unpivot(keys, MODELS, "model", "score")
