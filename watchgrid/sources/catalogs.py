"""Channel and object dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T



def read_dictionary(spark: SparkSession, path: str, headers: dict[str, str]) -> DataFrame:
    """A dictionary CSV with every column as text, renamed to our names."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in headers])
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", True)
            .csv(path).withColumnsRenamed(headers))


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the first in ``order``, so the choice does not vary."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(key, *[F.col("_row")[c].alias(c) for c in rest])


def load_catalog(channels: DataFrame, objects: DataFrame) -> DataFrame:
    """Channels with the kind and parent of their object, one row per channel."""
    order = [c for c in channels.columns if c != "channel_id"]
    one = first_per_key(channels.where(F.col("channel_id").isNotNull()), "channel_id", order)
    # Size unknown to us: the optimizer broadcasts the objects only when small.
    return one.join(objects, "object_id", "left").select(
        "channel_id", "engineering_system", "sensor_type", "object_id", "object_kind", "parent_id")


def with_parent(objects: DataFrame) -> DataFrame:
    """Name of the parent object, or a group text when it is not listed."""
    parent = objects.select(F.col("object_id").alias("parent_id"),
                            F.col("object_name").alias("_parent_name"))
    return objects.join(parent, "parent_id", "left").select(
        "object_id", "object_name", "object_kind", "parent_id",
        F.coalesce("_parent_name", F.concat(F.lit("Группа "), "parent_id")).alias("parent_name"))
