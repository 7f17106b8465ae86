"""Rankings, queues, samples and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchgrid.functions.scalars import ratio
from watchgrid.functions.draws import order_key
from watchgrid.plans.running import ranked
from watchgrid.session import materialize

#: Hexadecimal digits of the order key by which a sample is counted: 65,536 cells a class.
CELL_DIGITS = 4


def rank_queue(cards: DataFrame, k: int, by: list[str] = ("date",)) -> DataFrame:
    """Rank of every card of a day, warning for the first k, score at the boundary.

    All cards are ranked, so the order is cut into ranges instead of pulling a
    whole day into one task.
    """
    by = list(by)
    rows = ranked(cards, by, [-F.col("score"), F.col("object_id").cast("string")])
    boundary = rows.where(F.col("rank") == k).select(*by, F.col("score").alias("threshold"))
    return (rows.withColumn("warning", (F.col("rank") <= k).cast("int"))
            .join(boundary, by, "left"))


def top_by_rows(profile: DataFrame, n: int = 50) -> DataFrame:
    return profile.orderBy(F.desc("rows"), "channel_id").limit(n)


def top_by_alarm_rate(profile: DataFrame, n: int = 50, min_rows: int = 1000) -> DataFrame:
    return (profile.where(F.col("rows") >= min_rows)
            .orderBy(F.desc("alarm_percent"), F.desc("rows"), "channel_id").limit(n))


def top_values(clean: DataFrame, n: int = 50) -> DataFrame:
    """Most frequent text values, counted over all records."""
    return (clean.where(F.col("kind") == "text").groupBy("value_text").agg(F.count("*").alias("rows"))
            .orderBy(F.desc("rows"), "value_text").limit(n))


def unknown_channels(journal: DataFrame, catalog: DataFrame, n: int = 50) -> DataFrame:
    """Most active channels that the dictionary does not list."""
    counted = journal.groupBy("channel_id").agg(F.count("*").alias("rows"))
    return (counted.join(catalog.select("channel_id"), "channel_id", "left_anti")
            .orderBy(F.desc("rows"), "channel_id").limit(n))


def combine_importance(importances: DataFrame, columns: list[str], n: int = 20) -> DataFrame:
    """Top features by the sum of normalised importances.

    Holds one row per feature; totals come from a one-row subquery.
    """
    clipped = importances.select("feature", *[F.greatest(F.col(c), F.lit(0.0)).alias(c) for c in columns])
    totals = clipped.agg(*[F.sum(c).alias(c) for c in columns]).select(F.struct("*").alias("t")).scalar()
    shares = clipped.withColumn("_t", totals).select(
        "feature", *[ratio(F.col(c), F.col("_t")[c], 0).alias(c) for c in columns])
    score = sum([F.col(c) for c in columns[1:]], F.col(columns[0]))
    return shares.withColumn("combined", score).orderBy(F.desc("combined"), "feature").limit(n)


def channel_queue(scored: DataFrame, n: int = 100) -> DataFrame:
    """Riskiest channels among those with a record in the last seven days."""
    return (scored.where(F.col("observed_days_7d") > 0)
            .orderBy(F.desc("score"), "channel_id").limit(n))


# --- samples and weights ------------------------------------------------------------

def stratified_sample(rows: DataFrame, label: str, keys: list[str], cap: int,
                      positive_share: float, seed: int) -> DataFrame:
    """At most ``cap`` rows, positives up to their share, chosen by a seeded order.

    The order is global and fixed, so neither the partitioning nor
    a restarted task changes the sample.  Kept rows carry the class sizes.
    Rows are counted per class and first digits of their order key; only the
    rows of the one cell that a class's last kept row lies in are ranked.
    """
    drawn = rows.where(F.col(label).isNotNull()).withColumn("_h", order_key(seed, *[F.col(k) for k in keys]))
    drawn = drawn.withColumn("_cell", F.substring("_h", 1, CELL_DIGITS))
    counts = materialize(drawn.groupBy(F.col(label).alias("_label"), "_cell").agg(F.count("*").alias("_n")), "cells")
    sizes = counts.agg(*[F.coalesce(F.sum(F.when(F.col("_label") == v, F.col("_n"))), F.lit(0)).alias(c) for v, c in ((1, "p"), (0, "n"))])
    keep_p = F.least(F.col("p"), F.lit(max(1, int(cap * positive_share))))
    keep_n = F.least(F.col("n"), F.lit(cap) - keep_p)
    positive = F.col("_label") == 1
    sized = counts.crossJoin(sizes).select(
        "_label", "_cell", "_n", F.when(positive, F.col("p")).otherwise(F.col("n")).alias("class_size"),
        F.when(positive, keep_p).otherwise(keep_n).alias("class_sample"))
    upto = F.sum("_n").over(Window.partitionBy("_label").orderBy("_cell"))
    # The first cell that the sample does not hold whole; of a class that is taken whole there is none.
    last = F.when(F.col("_upto") > F.col("class_sample"), F.struct("_cell", (F.col("_upto") - F.col("_n")).alias("before")))
    cuts = sized.withColumn("_upto", upto).groupBy("_label", "class_size", "class_sample").agg(F.min(last).alias("_cut"))
    cuts = materialize(cuts, "cuts")
    placed = drawn.join(cuts, F.col(label) == F.col("_label"))
    whole = placed.where(F.col("_cut").isNull() | (F.col("_cell") < F.col("_cut._cell")))
    edge = materialize(placed.where(F.col("_cell") == F.col("_cut._cell")), "edge")
    edge = ranked(edge, ["_label"], [F.col("_h"), *[F.col(k) for k in keys]], "_rank")
    edge = edge.where(F.col("_rank") + F.col("_cut.before") <= F.col("class_sample"))
    columns = [*rows.columns, "class_size", "class_sample"]
    return whole.select(*columns).unionByName(edge.select(*columns))


def inverse_weights(sample: DataFrame) -> DataFrame:
    """Weight of each sampled row so that classes count as before, mean 1."""
    raw = sample.withColumn("weight", F.col("class_size") / F.col("class_sample"))
    return normalised(raw)


def normalised(rows: DataFrame) -> DataFrame:
    mean = rows.agg(F.avg("weight")).scalar()
    return rows.withColumn("weight", F.col("weight") / mean)


def recency_weights(rows: DataFrame, anchor: Column, half_life: float) -> DataFrame:
    """Halve the weight of a row every ``half_life`` days, mean 1."""
    age = F.datediff(anchor, "date")
    return normalised(rows.withColumn("weight", F.col("weight") * F.pow(F.lit(0.5), age / half_life)))
