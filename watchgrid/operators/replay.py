"""Replay of point-in-time forecasts: one day, or all days at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchgrid import vocab
from watchgrid.operators import aggregate as agg
from watchgrid.operators import objects as O
from watchgrid.operators import release, versions
from watchgrid.operators.quality import expect_empty
from watchgrid.session import materialize


def forecast_day(history: DataFrame, channel_objects: DataFrame, objects: DataFrame, score: Callable[[DataFrame], DataFrame],
                 start: Column, feature_date: str, cutoff: Column, k: int, prefix: str = "object",
                 identity: dict[str, str] | None = None) -> DataFrame:
    """Ranked cards of one feature day from the history visible at its issue time.

    ``identity`` (digests of model and input) becomes part of the run's id.
    """
    day = F.lit(feature_date).cast("date")
    mart = O.recap_7d(O.object_mart(history, channel_objects, objects, start, day, cutoff=cutoff))
    scored = score(mart).where(F.col("date") == day)
    lineage = F.struct(F.date_format(day, "yyyy-MM-dd").alias("feature_date"), F.lit(prefix).alias("model"),
                       *[F.lit(v).alias(n) for n, v in sorted((identity or {}).items())])
    scored = scored.withColumn("run_id", release.release_id(prefix, day, lineage))
    return release.ranked_cards(scored, objects, k)


def as_of(seed: DataFrame, batches: DataFrame, channel_objects: DataFrame, start: Column, seed_end: Column, last: Column,
          lookback: int | None = None, told: DataFrame | None = None, attributes: DataFrame | None = None) -> DataFrame:
    """Object-day counters as each feature day after the bootstrap sees them; ``object_id`` is ``feature day|object``.

    Channels are added up once per version, and versions are spread over the feature days that
    see them: rows move per object, not per channel.  ``attributes`` of objects are joined before that.
    ``told`` holds the versions, one row each, if they are known.
    """
    columns = ["channel_id", "date", *vocab.MODEL_COUNTERS]
    dated = batches.where((F.col("date") == F.col("day")) & (F.col("day") >= start)).select(*columns, *versions.BATCH_KEYS)
    objects = agg.object_daily(dated, channel_objects, ("date", *versions.BATCH_KEYS))
    known = batches.select(*versions.BATCH_KEYS).distinct() if told is None else told.select(*versions.BATCH_KEYS)
    valid = versions.validity(known)
    daily = objects.join(valid, versions.BATCH_KEYS).drop("available_at", "batch_id")
    old = agg.object_daily(seed.select(*columns).where(F.col("date").between(start, seed_end)), channel_objects)
    old = old.select("*", F.col("date").alias("day"), F.date_add(seed_end, 1).alias("first_date"), F.lit(None).cast("date").alias("last_date"))
    daily = daily.unionByName(old)
    if attributes is not None:
        daily = daily.join(attributes, "object_id", "left")
    seen = versions.on_feature_days(daily, last, lookback).drop("day")
    return seen.withColumn("object_id", F.concat_ws("|", F.date_format("feature_date", "yyyy-MM-dd"), "object_id")).drop("feature_date")


def replay_days(seed: DataFrame, batches: DataFrame, channel_objects: DataFrame, objects: DataFrame,
                score: Callable[[DataFrame], DataFrame], start: Column, seed_end: Column, cutoff: Column, k: int,
                path: str, model_sha256: str, last: Column | None = None, prefix: str = "object", lookback: int | None = None) -> int:
    """Assemble, score, rank and publish every feature day from the bootstrap's end to ``last``, in one job.

    Each day sees the versions that were there at its issue time, as ``forecast_day`` on ``assemble_history``
    would; identities and digests are the same.  ``last`` is the newest delivered day unless given.
    ``score`` works within ``object_id``, which here is ``feature day|object``, and looks back only.
    With ``lookback`` so many days are seen at most.  Repeats change nothing.  Returns the number of new
    releases.
    """
    columns = [c for c in batches.columns if c not in versions.BATCH_KEYS]
    if last is None:
        last = F.lit(batches.agg(F.max("day")).first()[0])
    told = materialize(versions.delivered_versions(batches, columns), "versions")
    expect_empty(versions.replay_problems(seed, batches, columns, seed_end, last, told), "histories")
    key = F.col("object_id")
    feature_date = F.to_date(F.substring_index(key, "|", 1))
    facts = as_of(seed, batches, channel_objects, start, seed_end, last, lookback, told, O.attributes(objects, channel_objects))
    mart = O.mart_of(facts, None, start, feature_date, cutoff)
    scored = score(O.recap_7d(mart)).where(F.col("date") == feature_date).withColumn("object_id", F.expr("substring(object_id, 12)"))
    digests = materialize(versions.content_digests(seed, told, columns, last).withColumnRenamed("feature_date", "date"), "digests")
    lineage = F.struct(F.date_format("date", "yyyy-MM-dd").alias("feature_date"), F.lit(prefix).alias("model"),
                       F.col("input_sha256").alias("input"), F.lit(model_sha256).alias("model_sha"))
    scored = scored.join(digests, "date").withColumn("run_id", release.release_id(prefix, F.col("date"), lineage))
    cards = materialize(release.ranked_cards(scored.drop("input_sha256"), objects, k), "cards")
    runs = materialize(release.build_runs(cards, model_sha256, digests), "runs")
    return release.publish(runs, cards, path, k)
