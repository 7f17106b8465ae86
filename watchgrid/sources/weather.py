"""Daily context delivered as one JSON document of parallel arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Measured fields, in document order.
WEATHER_FIELDS = [
    "temperature_mean", "temperature_min", "temperature_max",
    "precipitation", "humidity", "pressure", "wind",
]
DOCUMENT_SCHEMA = "time array<string>, " + ", ".join(f"{f} array<double>" for f in WEATHER_FIELDS)


def unzip_daily_json(documents: DataFrame, body: str = "body", keys: list[str] = ()) -> DataFrame:
    """One row per day from documents whose fields are arrays of equal length.

    A document with arrays of different length keeps the longest; the missing
    cells are NULL and ``weather_violations`` reports them.
    """
    parsed = documents.select(*keys, F.from_json(body, DOCUMENT_SCHEMA).alias("d"))
    zipped = F.arrays_zip("d.time", *[f"d.{f}" for f in WEATHER_FIELDS])
    days = parsed.select(*keys, F.explode(zipped).alias("r"))
    return days.select(*keys, F.to_date("r.time").alias("source_date"),
                       *[F.col(f"r.{f}").alias(f) for f in WEATHER_FIELDS])


def weather_violations(days: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Counters of broken rules; all zero for a usable delivery."""
    low, mid, high = (F.col(f"temperature_{p}") for p in ("min", "mean", "max"))
    missing = F.lit(False)
    for f in WEATHER_FIELDS:
        missing = missing | F.col(f).isNull()
    return days.groupBy(*keys).agg(
        F.count("*").alias("days"),
        F.count_if(~((low <= mid) & (mid <= high))).alias("temperature_order"),
        F.count_if(F.col("precipitation") < 0).alias("negative_precipitation"),
        F.count_if(~F.col("humidity").between(0, 100)).alias("humidity_range"),
        F.count_if(F.col("pressure") <= 0).alias("pressure_range"),
        F.count_if(missing).alias("missing_values"),
        (F.datediff(F.max("source_date"), F.min("source_date")) + 1
         - F.count_distinct("source_date")).alias("missing_days"),
    )
