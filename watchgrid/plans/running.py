"""Running totals, ranks and exact quantiles over a global order.

A window without PARTITION BY would pull everything into one task.  These
helpers cut the order into ranges, sum each range, and add the totals of the
earlier ranges, so that every task sees a bounded share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STEP = 16      # fine bounds behind one coarse bound
_SAMPLE = 8     # sampled rows per range


def _range_count(df: DataFrame) -> int:
    """Ranges to cut into: as many as shuffle partitions, which follow the volume; 8 at least."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _edges(df: DataFrame, position: Column, ranges: int) -> Column:
    """Sorted range bounds, and every ``_STEP``-th of them as coarse bounds, as a scalar subquery.

    Taken from the rows with the smallest hashes: a bounded sample that depends
    on the data only, so a recomputed task finds the same bounds.
    """
    size = _SAMPLE * ranges
    sample = (df.select(position.alias("_p"))
              .orderBy(F.xxhash64("_p"), "_p").limit(size)
              .agg(F.sort_array(F.collect_list("_p")).alias("s")))
    picked = F.filter(F.col("s"), lambda _, i: (i % _SAMPLE) == _SAMPLE - 1)
    coarse = F.filter(F.col("edges"), lambda _, i: (i % _STEP) == _STEP - 1)
    return sample.select(picked.alias("edges")).select(F.struct("edges", coarse.alias("coarse")).alias("e")).scalar()


def _with_range(rows: DataFrame, edges: Column, position: Column) -> DataFrame:
    """``_range``, the number of bounds below the position: coarse bounds first, then one slice.

    A row is compared with the coarse bounds once, and never with all bounds.
    """
    rows = rows.withColumn("_edges", edges)
    rows = rows.withColumn("_block", F.size(F.filter(F.col("_edges.coarse"), lambda e: e < position)))
    fine = F.filter(F.slice(F.col("_edges.edges"), F.col("_block") * _STEP + 1, F.lit(_STEP)), lambda e: e < position)
    return rows.withColumn("_range", F.col("_block") * _STEP + F.size(fine))


def running_totals(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    totals: dict[str, Column],
    ranges: int | None = None,
) -> DataFrame:
    """Add inclusive running sums per ``by`` in ascending ``order``.

    (by, order) must be unique; aggregate ties first or append an identity.
    ``by`` may hold any mix of small and huge groups: ranges are cut over the
    combined order, so a group with most of the rows is spread over many ranges.
    """
    ranges = ranges or _range_count(df)
    columns = df.columns
    names = list(totals)
    rows = df.select("*", *[x.alias(f"_x_{n}") for n, x in totals.items()],
                     *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    keys = [*by, *[f"_o{i}" for i in range(len(order))]]
    position = F.struct(*keys)
    edges = _edges(rows, position, ranges)
    rows = _with_range(rows, edges, position)

    group = [*by, "_range"]
    sums = rows.groupBy(*group).agg(*[F.sum(f"_x_{n}").alias(f"_s_{n}") for n in names])
    earlier = (Window.partitionBy(*by).orderBy("_range")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*group, *[F.sum(f"_s_{n}").over(earlier).alias(f"_b_{n}") for n in names])

    inside = (Window.partitionBy(*group).orderBy(*[F.col(k) for k in keys[len(by):]])
              .rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select("*", *[F.sum(f"_x_{n}").over(inside).alias(f"_i_{n}") for n in names])
    match = [rows[c].eqNullSafe(offsets[c]) for c in group]
    joined = rows.join(offsets, match)
    return joined.select(*[rows[c] for c in columns], *[
        (F.col(f"_i_{n}") + F.coalesce(F.col(f"_b_{n}"), F.lit(0))).alias(n) for n in names])


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Row number per ``by`` over a unique ascending order, without one big window."""
    return running_totals(df, by, order, {name: F.lit(1).cast("long")})


def exact_quantiles(counts: DataFrame, by: list[str], value: str, n: str, probs: list[float]) -> DataFrame:
    """Linearly interpolated quantiles from (by, value, n) counts.

    Returns one row per group and probability: (by, prob, quantile).
    """
    size = counts.groupBy(*by).agg(F.sum(n).alias("_size"))
    running = running_totals(counts, by, [F.col(value)], {"_upto": F.col(n)})
    rows = running.join(size, by)
    spot = F.array(*[
        F.struct(
            F.lit(p).alias("prob"),
            F.floor((F.col("_size") - 1) * F.lit(p)).alias("lo"),
            F.ceil((F.col("_size") - 1) * F.lit(p)).alias("hi"),
            ((F.col("_size") - 1) * F.lit(p)).alias("at"),
        ) for p in probs])
    first, last = F.col("_upto") - F.col(n), F.col("_upto") - 1
    hit = F.filter(spot, lambda s: s["lo"].between(first, last) | s["hi"].between(first, last))
    hits = rows.select(*by, F.col(value).alias("_v"), first.alias("_f"), last.alias("_l"),
                       F.explode(hit).alias("s"))
    low = F.max(F.when(F.col("s.lo").between(F.col("_f"), F.col("_l")), F.col("_v")))
    high = F.max(F.when(F.col("s.hi").between(F.col("_f"), F.col("_l")), F.col("_v")))
    part = F.max(F.col("s.at") - F.col("s.lo"))
    return (hits.groupBy(*by, F.col("s.prob").alias("prob"))
            .agg(low.alias("_low"), high.alias("_high"), part.alias("_part"))
            .select(*by, "prob",
                    (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias("quantile")))


def nearest_rank(counts: DataFrame, by: list[str], value: str, n: str, probs: list[float]) -> DataFrame:
    """Nearest-rank percentiles (by, prob, quantile): the ceil(p * size)-th value."""
    size = counts.groupBy(*by).agg(F.sum(n).alias("_size"))
    rows = running_totals(counts, by, [F.col(value)], {"_upto": F.col(n)}).join(size, by)
    spot = F.array(*[
        F.struct(F.lit(p).alias("prob"),
                 F.greatest(F.ceil(F.col("_size") * F.lit(p)), F.lit(1)).alias("at")) for p in probs])
    hit = F.filter(spot, lambda s: s["at"].between(F.col("_upto") - F.col(n) + 1, F.col("_upto")))
    return (rows.select(*by, F.col(value).alias("quantile"), F.explode(hit).alias("s"))
            .select(*by, F.col("s.prob").alias("prob"), "quantile"))
