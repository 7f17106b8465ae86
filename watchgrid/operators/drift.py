"""Coverage and drift of features between the train period and later splits.

Features go to long form and are counted per (feature, value, split) with
map-side combining; order statistics come from running totals over those
counts, so no task ever holds a whole column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchgrid.functions.scalars import ratio
from watchgrid.session import materialize
from watchgrid.plans.running import exact_quantiles, running_totals


def feature_coverage(rows: DataFrame, features: list[str]) -> DataFrame:
    """Known share, zero share and distinct values per split and feature."""
    values = rows.unpivot(["split"], features, "feature", "value")
    counted = values.groupBy("split", "feature", "value").agg(F.count("*").alias("n"))
    zero = F.coalesce(F.col("value"), F.lit(0.0)) == 0
    out = counted.groupBy("split", "feature").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("non_null"),
        F.sum(F.when(zero, F.col("n")).otherwise(0)).alias("zeros"),
        F.count("value").alias("unique_values"))
    return out.select("split", "feature", "rows", "non_null",
                      ratio(F.col("non_null"), F.col("rows")).alias("coverage"),
                      ratio(F.col("zeros"), F.col("rows")).alias("zero_share"), "unique_values")


def drift_moments(rows: DataFrame, features: list[str], splits: tuple[str, ...] = ("train", "valid", "test")) -> DataFrame:
    """Mean and sample deviation per feature and split, splits as columns."""
    values = rows.unpivot(["split"], features, "feature", "value")
    out = []
    for s in splits:
        x = F.when(F.col("split") == s, F.col("value"))
        out += [F.avg(x).alias(f"{s}_mean"), F.stddev_samp(x).alias(f"{s}_std")]
    return values.groupBy("feature").agg(*out)


def _counts(rows: DataFrame, features: list[str]) -> DataFrame:
    """Rows per feature value and split, written once: several passes follow."""
    values = rows.unpivot(["split"], features, "feature", "value").where("value is not null")
    counted = values.groupBy("feature", "value").pivot("split", ["train", "valid", "test"]).agg(
        F.count(F.lit(1))).fillna(0, ["train", "valid", "test"])
    return materialize(counted, "value-counts")


def psi(rows: DataFrame, features: list[str], bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """Population stability index of later splits over the train deciles.

    NULL when the train split has under two values or the deciles leave fewer
    than three distinct edges.
    """
    counts = _counts(rows, features)
    train = counts.where("train > 0").select("feature", "value", F.col("train").alias("n"))
    probs = [i / bins for i in range(bins + 1)]
    edges = (exact_quantiles(train, ["feature"], "value", "n", probs).groupBy("feature")
             .agg(F.sort_array(F.collect_set("quantile")).alias("edges")))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    binned = counts.join(edges, "feature").withColumn(
        "bin", F.size(F.filter(inner, lambda e: e < F.col("value"))))
    splits = ("train", "valid", "test")
    per_bin = binned.groupBy("feature", "bin").agg(
        F.max(F.size("edges")).alias("edges"), *[F.sum(s).alias(s) for s in splits])
    totals = counts.groupBy("feature").agg(
        F.count_if(F.col("train") > 0).alias("train_values"), *[F.sum(s).alias(f"{s}_total") for s in splits])
    joined = per_bin.join(totals, "feature")
    expected = F.col("train") / F.greatest(F.col("train_total"), F.lit(1)) + eps
    out = []
    for s in splits[1:]:
        actual = F.col(s) / F.greatest(F.col(f"{s}_total"), F.lit(1)) + eps
        usable = (F.max("edges") >= 3) & (F.max("train_values") >= 2) & (F.max(f"{s}_total") > 0)
        out.append(F.when(usable, F.sum((actual - expected) * F.log(actual / expected))).alias(s))
    return joined.groupBy("feature").agg(*out).unpivot(["feature"], list(splits[1:]), "split", "psi")


def ks(rows: DataFrame, features: list[str]) -> DataFrame:
    """Largest distance between the distribution functions of train and a later split."""
    splits = ("train", "valid", "test")
    counts = _counts(rows, features)
    totals = counts.groupBy("feature").agg(*[F.sum(s).alias(f"{s}_total") for s in splits])
    steps = running_totals(counts, ["feature"], [F.col("value")], {f"{s}_upto": F.col(s) for s in splits})
    joined = steps.join(totals, "feature")

    def share(s):
        return ratio(F.col(f"{s}_upto"), F.col(f"{s}_total"))

    return joined.groupBy("feature").agg(*[
        F.max(F.abs(share("train") - share(s))).alias(s) for s in splits[1:]]).unpivot(
        ["feature"], list(splits[1:]), "split", "ks")
