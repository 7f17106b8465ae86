"""Block bootstraps of paired model differences.

Rows are reduced to sums per week or counts per (day, score) first.  Draws come from
counters (``functions.draws``), so a repeated task draws the same blocks.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchgrid.functions.draws import below
from watchgrid.functions.scalars import ratio
from watchgrid.operators.evaluation import average_precision, curve, daily_rank
from watchgrid.session import materialize

FEW_WEEKS = 8


def _in_order(rows: DataFrame, order: str, *columns: str) -> Column:
    """Calendar-sized rows as one sorted array (one entry per week or day)."""
    return rows.agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("a")).scalar()


def weekly_sums(rows: DataFrame, models: tuple[str, str], k: int) -> DataFrame:
    """Hits of two models, warnings and onsets per Monday-to-Sunday issue week."""
    week = F.to_date(F.date_trunc("week", F.date_add("date", 1)))
    onset = F.col("onset_target") == 1
    new, base = models
    chosen = daily_rank(rows.where(F.col("model").isin(*models)), ["model"], k)
    picked = chosen.groupBy(week.alias("week")).agg(
        F.count_if((F.col("model") == new) & onset).alias("new_tp"),
        F.count_if((F.col("model") == base) & onset).alias("base_tp"),
        F.count_if(F.col("model") == new).alias("warnings"),
        F.count_if(F.col("model") == base).alias("base_warnings"))
    totals = rows.where(F.col("model") == new).groupBy(week.alias("week")).agg(
        F.count_if(onset).alias("onsets"), F.count_distinct("date").alias("days"))
    return picked.join(totals, "week")


def week_bootstrap(weekly: DataFrame, draws: int, seed: int) -> DataFrame:
    """Intervals of the differences in precision and recall, one row.

    Weeks are drawn with replacement and ratios formed from block sums.  A
    single week gives no interval; recall uses replicates with onsets only.
    """
    spark = weekly.sparkSession
    columns = ("new_tp", "base_tp", "warnings", "onsets")
    replicates = (spark.range(draws).withColumnRenamed("id", "draw")
                  .withColumn("_w", _in_order(weekly, "week", *columns))
                  .withColumn("_m", F.size("_w")))
    slots = replicates.select("draw", "_w", "_m", F.explode(F.sequence(F.lit(1), F.col("_m"))).alias("slot"))
    picked = slots.select("draw", "_m", F.element_at("_w", below(seed, F.col("_m"), F.col("draw"), F.col("slot")) + 1).alias("w"))
    sums = picked.groupBy("draw").agg(F.max("_m").alias("weeks"), *[F.sum(f"w.{c}").alias(c) for c in columns])
    gain = F.col("new_tp") - F.col("base_tp")
    differences = sums.select("weeks", ratio(gain, F.col("warnings")).alias("p"), ratio(gain, F.col("onsets")).alias("r"))

    def interval(c: str, q: float) -> Column:
        return F.when(F.max("weeks") >= 2, F.percentile(c, F.lit(q)))

    bounds = differences.agg(
        F.max("weeks").alias("weeks"), F.count("*").alias("replicates"),
        interval("p", 0.025).alias("precision_low"), interval("p", 0.975).alias("precision_high"),
        interval("r", 0.025).alias("recall_low"), interval("r", 0.975).alias("recall_high"),
        F.count_if(F.col("r").isNull()).alias("replicates_without_onsets"))
    t = {c: weekly.agg(F.sum(c)).scalar() for c in columns}
    return bounds.select(
        "*", (F.col("weeks") < FEW_WEEKS).cast("int").alias("few_weeks"),
        ratio(t["new_tp"] - t["base_tp"], t["warnings"]).alias("precision_difference"),
        ratio(t["new_tp"] - t["base_tp"], t["onsets"]).alias("recall_difference"))


def daily_score_counts(rows: DataFrame, label: str) -> DataFrame:
    """Positives and rows per model, day and score: all that any draw needs."""
    return rows.groupBy("model", "date", "score").agg(
        F.sum(label).cast("long").alias("pos"), F.count("*").alias("n"))


def weighted_ap(counts: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """Average precision with a weight per day; days without a weight count 0."""
    weighted = counts.join(weights, "date").groupBy(*by, "score").agg(
        F.sum(F.col("pos") * F.col("weight")).alias("pos"), F.sum(F.col("n") * F.col("weight")).alias("n"))
    return average_precision(curve(materialize(weighted.where("n > 0"), "weighted-counts"), by), by)


def block_weights(days: DataFrame, draws: int, length: int, seed: int) -> DataFrame:
    """date, weights: how often each day occurs in circular blocks of consecutive days, one entry for each draw."""
    spark = days.sparkSession
    base = (spark.range(draws).withColumnRenamed("id", "draw")
            .withColumn("_d", _in_order(days, "date")).withColumn("_m", F.size("_d")))
    spots = base.select("draw", "_d", "_m", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("spot"))
    start = below(seed, F.col("_m"), F.col("draw"), F.floor(F.col("spot") / length))
    index = (start + F.col("spot") % length) % F.col("_m")
    times = spots.select("draw", F.get("_d", index.cast("int"))["date"].alias("date")).groupBy("date", "draw").agg(F.count("*").alias("n"))
    by_draw = times.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("draw", "n"))).alias("_n"))
    return by_draw.select("date", F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda i: F.coalesce(
        F.try_element_at("_n", i.cast("long")), F.lit(0)).cast("double")).alias("weights"))


def drawn_counts(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """model, draw, score, pos, n: the day counts under every draw's weights.

    Days are added up as vectors, one entry for each draw, so rows are not multiplied by the draws before
    they are summed.  The vector sums are doubles off by a rounding, hence the rounding.
    """
    def scaled(c: str) -> Column:
        return array_to_vector(F.transform("weights", lambda w: w * F.col(c))).alias(c)

    sums = counts.join(weights, "date").select("model", "score", scaled("pos"), scaled("n")).groupBy("model", "score").agg(
        *[Summarizer.sum(F.col(c)).alias(c) for c in ("pos", "n")])
    both = F.arrays_zip(vector_to_array("pos").alias("pos"), vector_to_array("n").alias("n"))
    each = sums.select("model", "score", F.posexplode(both).alias("draw", "c"))
    return each.select("model", "draw", "score", F.round("c.pos").cast("long").alias("pos"), F.round("c.n").cast("long").alias("n")).where("n > 0")


def block_bootstrap(counts: DataFrame, baseline: str, draws: int, length: int, seed: int) -> DataFrame:
    """Interval of each model's AP difference to the baseline over block draws."""
    weights = block_weights(counts.select("date").distinct(), draws, length, seed)
    drawn = materialize(drawn_counts(counts, weights), "drawn-counts")
    ap = average_precision(curve(drawn, ["model", "draw"]), ["model", "draw"])
    base = ap.where(F.col("model") == baseline).select("draw", F.col("average_precision").alias("_b"))
    differences = ap.where(F.col("model") != baseline).join(base, "draw").withColumn(
        "d", F.col("average_precision") - F.col("_b"))
    return differences.groupBy("model").agg(
        F.count("*").alias("draws"), F.percentile("d", F.lit(0.025)).alias("lower"),
        F.avg("d").alias("mean"), F.percentile("d", F.lit(0.975)).alias("upper"))
