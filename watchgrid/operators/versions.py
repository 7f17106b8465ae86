"""Point-in-time selection among versions of whole daily deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ISSUE_ZONE = "Europe/Moscow"
BATCH_KEYS = ["day", "available_at", "batch_id"]


def issue_time(feature_date: Column) -> Column:
    """Midnight after the feature day, Moscow time, as an instant."""
    return F.to_utc_timestamp(F.date_add(feature_date, 1).cast("timestamp"), ISSUE_ZONE)


def forecast_window(date: Column) -> dict[str, Column]:
    """Cutoff, issue time and target window of a forecast made from one day."""
    def local(days: int, seconds: int = 0) -> Column:
        start = F.date_add(date, days).cast("timestamp")
        return F.to_utc_timestamp(start - F.make_dt_interval(secs=F.lit(seconds)), ISSUE_ZONE)
    issue, start, end = local(1), local(2), local(3)
    return {
        "feature_cutoff": local(1, 1), "issue_time": issue,
        "forecast_start": start, "forecast_end": end,
        "minimum_lead_hours": (F.unix_timestamp(start) - F.unix_timestamp(issue)) / 3600.0,
        "window_hours": (F.unix_timestamp(end) - F.unix_timestamp(start)) / 3600.0,
    }


def _hash(columns: list[str]) -> Column:
    """64-bit hash of the columns with their null flags: the hash itself skips nulls."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])


def row_hash(columns: list[str]) -> Column:
    return _hash(columns).cast("decimal(38,0)")


def content_parts(columns: list[str]) -> list[Column]:
    """Aggregates that tell contents apart, whatever the order of the rows."""
    return [F.count("*").alias("rows"), F.sum(row_hash(columns)).alias("hash_sum"), F.bit_xor(_hash(columns)).alias("hash_xor")]


def fingerprints(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Order-independent content identity of each group of rows."""
    return rows.groupBy(*keys).agg(*content_parts(columns))


def _content_digest(columns: list[str], rows: Column, hash_sum: Column, hash_xor: Column) -> Column:
    parts = (rows, F.coalesce(hash_sum, F.lit(0)), F.coalesce(hash_xor, F.lit(0)))
    return F.sha2(F.concat_ws("|", F.lit(",".join(columns)), *[p.cast("string") for p in parts]), 256)


def content_sha256(rows: DataFrame, columns: list[str]) -> Column:
    """Digest of a whole table's content as a scalar: independent of the order of rows and of their partitions."""
    return rows.agg(_content_digest(columns, F.count("*"), F.sum(row_hash(columns)), F.bit_xor(_hash(columns))).alias("sha")).scalar()


def delivered_versions(batches: DataFrame, columns: list[str]) -> DataFrame:
    """One row per version: its content identity, and ``strayed``, how many of its rows are of another day.

    All that a replay asks of whole versions, from one pass over the rows.
    """
    kept = batches.withColumn("_strayed", ~F.col("date").eqNullSafe(F.col("day")))
    return kept.groupBy(*BATCH_KEYS).agg(*content_parts(columns), F.count_if("_strayed").alias("strayed"))


def _conflicts(prints: DataFrame) -> DataFrame:
    return prints.groupBy("day", "available_at").agg(
        F.count_distinct("rows", "hash_sum", "hash_xor").alias("contents")).where("contents > 1")


def version_conflicts(batches: DataFrame, columns: list[str]) -> DataFrame:
    """Deliveries for the same day and instant that differ in content."""
    return _conflicts(fingerprints(batches, BATCH_KEYS, columns))


def premature_batches(batches: DataFrame) -> DataFrame:
    """A complete day cannot be available before its end."""
    return batches.where(F.col("available_at") < issue_time(F.col("day"))).select(*BATCH_KEYS).distinct()


def known_batches(batches: DataFrame, feature_date: Column) -> DataFrame:
    """Rows of all versions that existed at issue time."""
    return batches.where((F.col("day") <= feature_date) & (F.col("available_at") <= issue_time(feature_date)))


def visible_batches(batches: DataFrame, feature_date: Column) -> DataFrame:
    """Rows of the newest version of each day that existed at issue time.

    The choice is one row per calendar day; the optimizer broadcasts it when its
    measured size allows.
    """
    known = known_batches(batches, feature_date)
    newest = (known.groupBy("day").agg(F.max(F.struct("available_at", "batch_id")).alias("_v"))
              .select("day", F.col("_v.available_at").alias("available_at"), F.col("_v.batch_id").alias("batch_id")))
    return known.join(newest, BATCH_KEYS, "left_semi")


def assemble_history(seed: DataFrame, batches: DataFrame, feature_date: Column) -> DataFrame:
    """Bootstrap history plus the visible daily versions, one row per channel-day."""
    columns = [c for c in batches.columns if c not in BATCH_KEYS]
    daily = visible_batches(batches, feature_date).select(*columns)
    return seed.select(*columns).unionByName(daily)


def history_problems(seed: DataFrame, batches: DataFrame, columns: list[str],
                     seed_end: Column, feature_date: Column) -> DataFrame:
    """Reasons to refuse a forecast, as (problem, day) rows; empty means usable.

    Versions that arrive after the issue time cannot conflict: an earlier
    forecast stays possible whatever is delivered later.
    """
    return _problems(seed, delivered_versions(batches, columns), seed_end, feature_date)


def _problems(seed: DataFrame, told: DataFrame, seed_end: Column, feature_date: Column) -> DataFrame:
    from watchgrid.operators.sets import missing_days

    def tag(df: DataFrame, name: str, day: str) -> DataFrame:
        return df.select(F.lit(name).alias("problem"), F.col(day).alias("day"))

    days = told.select("day", "available_at").distinct()
    visible = days.where((F.col("day") <= feature_date)
                         & (F.col("available_at") <= issue_time(feature_date)))
    late_seed = seed.where(F.col("date") > seed_end).select("date").distinct()
    known = known_batches(told, feature_date)
    strayed = known.where("strayed > 0").select("day").distinct()
    return (tag(_conflicts(known), "conflicting versions", "day")
            .unionByName(tag(strayed, "rows of another day", "day"))
            .unionByName(tag(premature_batches(told), "available before the day ended", "day"))
            .unionByName(tag(days.where(F.col("day") <= seed_end), "overlaps the bootstrap", "day"))
            .unionByName(tag(late_seed, "bootstrap after its end", "date"))
            .unionByName(tag(missing_days(visible, F.date_add(seed_end, 1), feature_date), "missing day", "day"))
            .distinct())


# --- all feature days at once -------------------------------------------------------

def first_seen(available_at: Column) -> Column:
    """The first feature day whose issue time is not before the instant."""
    local = F.from_utc_timestamp(available_at, ISSUE_ZONE)
    return F.when(local == F.date_trunc("day", local), F.date_sub(local, 1)).otherwise(F.to_date(local))


def validity(deliveries: DataFrame) -> DataFrame:
    """Every version with the feature days that see it: from its availability to that of the day's next version.

    ``deliveries`` holds one row per version (``BATCH_KEYS`` and anything else).  Versions that no
    feature day sees are left out; ``last_date`` is NULL for the newest.
    """
    order = Window.partitionBy("day").orderBy("available_at", "batch_id")
    until = F.date_sub(first_seen(F.lead("available_at").over(order)), 1)
    known = deliveries.select("*", F.greatest("day", first_seen(F.col("available_at"))).alias("first_date"), until.alias("last_date"))
    return known.where("last_date IS NULL OR first_date <= last_date")


def on_feature_days(rows: DataFrame, last: Column, lookback: int | None = None) -> DataFrame:
    """One row per row of ``rows`` (day, first_date, last_date, ...) and feature day that sees it, up to ``last``.

    The interval itself yields its days, so no join of versions with days is needed.  With
    ``lookback`` a day is seen for so many feature days only.
    """
    end = F.least(F.coalesce("last_date", last), last)
    if lookback is not None:
        end = F.least(end, F.date_add("day", lookback - 1))
    seen = rows.where(F.col("first_date") <= end)
    return seen.select(F.explode(F.sequence("first_date", end)).alias("feature_date"), "*").drop("first_date", "last_date")


def content_digests(seed: DataFrame, told: DataFrame, columns: list[str], last: Column) -> DataFrame:
    """feature_date, input_sha256: what ``content_sha256`` says of the assembled history of each feature day.

    ``told`` is of ``delivered_versions``.  Counts, sums and parities of whole versions add up, so no row is read twice.
    """
    prints = on_feature_days(validity(told), last)
    daily = prints.groupBy("feature_date").agg(F.sum("rows").alias("n"), F.sum("hash_sum").alias("s"), F.bit_xor("hash_xor").alias("x"))
    base = seed.agg(F.struct(F.count("*").alias("n"), F.coalesce(F.sum(row_hash(columns)), F.lit(0)).cast("decimal(38,0)").alias("s"),
                             F.coalesce(F.bit_xor(_hash(columns)), F.lit(0).cast("long")).alias("x")).alias("b")).scalar()
    daily = daily.withColumn("b", base)
    return daily.select("feature_date", _content_digest(
        columns, F.col("n") + F.col("b.n"), (F.col("s") + F.col("b.s")).cast("decimal(38,0)"), F.col("x").bitwiseXOR(F.col("b.x"))).alias("input_sha256"))


def replay_problems(seed: DataFrame, batches: DataFrame, columns: list[str], seed_end: Column, last: Column,
                    told: DataFrame | None = None) -> DataFrame:
    """Reasons to refuse a replay of all feature days after the bootstrap: (problem, day), as ``history_problems``.

    What an earlier feature day knows the last one knows too, but a day that arrives late is
    missing until then.  ``told`` is what ``delivered_versions`` said of the batches, if that is known.
    """
    told = delivered_versions(batches, columns) if told is None else told
    seen = told.groupBy("day").agg(F.min(first_seen(F.col("available_at"))).alias("f"))
    late = seen.where((F.col("day") > seed_end) & (F.col("day") <= last) & (F.col("f") > F.col("day")))
    return _problems(seed, told, seed_end, last).unionByName(
        late.select(F.lit("missing day").alias("problem"), "day")).distinct()
