"""Forecast releases as two flat tables: runs and cards.

A run has one card per object, without a bound, so cards stay rows.  The
content identity of a run is an order-independent fingerprint of its cards.
"""

from __future__ import annotations

import functools
import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchgrid import vocab
from watchgrid.operators.quality import expect_empty
from watchgrid.operators.ranking import rank_queue
from watchgrid.operators.versions import fingerprints, forecast_window
from watchgrid.plans.running import ranked
from watchgrid.session import materialize
from watchgrid.sources.catalogs import with_parent


def release_id(prefix: str, date: Column, lineage: Column) -> Column:
    """Prefix, feature date and 16 hex digits of the lineage's canonical JSON."""
    digest = F.sha2(F.to_json(lineage), 256)
    return F.concat(F.lit(f"{prefix}_"), F.date_format(date, "yyyy-MM-dd"), F.lit("_"), F.substring(digest, 1, 16))


def value_text(value: Column) -> Column:
    """Three significant digits as in "%.3g", or the text for no observation."""
    x = value.cast("double")
    power = F.when(x == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(x))))
    scale = F.pow(F.lit(10.0), 2 - power)
    digits = F.round(x * scale) / scale
    # Rounding may carry into the next power of ten.
    power = F.when(digits == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(digits)) + 1e-12))
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.8f", digits), "0+$", ""), r"\.$", "")
    mantissa = F.regexp_replace(F.regexp_replace(
        F.format_string("%.2f", digits / F.pow(F.lit(10.0), power)), "0+$", ""), r"\.$", "")
    exponent = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    far = (power < -4) | (power >= 3)
    return F.when(x.isNull(), vocab.NO_OBSERVATION).when(far, F.concat(mantissa, F.lit("e"), exponent)).otherwise(plain)


def explain_top3(coefficients: dict[str, float]) -> Column:
    """Up to three largest positive linear contributions with their values as text."""
    terms = F.array(*[
        F.struct((F.col(f).cast("double") * c).alias("contribution"), F.lit(f).alias("feature"),
                 value_text(F.col(f)).alias("value")) for f, c in coefficients.items()])
    positive = F.filter(terms, lambda t: t["contribution"] > 0)
    return F.slice(F.sort_array(positive, asc=False), 1, 3)


def build_cards(scored: DataFrame, objects: DataFrame) -> DataFrame:
    """Cards of the feature days: state, recap, names and the observation note.

    ``scored`` holds object-day rows with recap columns, run_id and score.  Objects that the dictionary
    lacks keep their card, named by their id.
    """
    # The parent may be listed or not; the mart's attributes give way to the catalog's.
    rows = scored.drop("object_name", "parent_id", "parent_name", "object_kind").join(with_parent(objects), "object_id", "left")
    return rows.select(
        "run_id", F.concat_ws("_", "run_id", "object_id").alias("id"), "object_id", "date", F.coalesce("object_name", "object_id").alias("object_name"),
        F.coalesce("object_kind", F.lit("unknown")).alias("object_kind"), "parent_id", "parent_name", "score",
        F.col("alarm_today").alias("current_alarm"), F.col("events_count").alias("events_today"),
        "alarm_channels", "observed_channels", "catalog_channels", "alarm_days_7d", "observed_days_7d",
        F.when(F.col("observed_channels") == 0, vocab.NOTE_NO_RECORDS).otherwise(vocab.NOTE_RECORDS).alias("observation_note"))


def release_summary(cards: DataFrame) -> DataFrame:
    """Counters of each run from its ranked cards."""
    return cards.groupBy("run_id", "date").agg(
        F.count("*").alias("total_objects"), F.sum("warning").alias("warnings_count"),
        F.count_if(F.col("observed_channels") > 0).alias("observed_objects_today"),
        F.max("threshold").alias("threshold"))


def build_runs(cards: DataFrame, model_sha256: str, input_sha256: Column | DataFrame, mode: str = "historical_replay") -> DataFrame:
    """Run headers: summary, times of the forecast, lineage and content digest.

    The input's digest is one value, or a table (date, input_sha256) of each feature day's.
    """
    parts = forecast_window(F.col("date"))
    content = [c for c in cards.columns if c not in ("run_id", "explanation")]
    prints = fingerprints(cards, ["run_id"], content).select(
        "run_id", F.concat_ws("|", F.col("rows").cast("string"), F.col("hash_sum").cast("string")).alias("cards_print"))
    summary = release_summary(cards).join(prints, "run_id")
    if isinstance(input_sha256, DataFrame):
        summary, input_sha256 = summary.join(input_sha256, "date"), F.col("input_sha256")
    runs = summary.select(
        *[c for c in summary.columns if c != "input_sha256"], F.lit(mode).alias("mode"), F.lit("object").alias("entity_mode"),
        *[c.alias(n) for n, c in parts.items()],
        F.lit(model_sha256).alias("model_sha256"), input_sha256.alias("input_sha256"))
    return runs.withColumn("content_sha256", content_digest())


def content_digest() -> Column:
    fields = ["run_id", "date", "mode", "entity_mode", "issue_time", "forecast_start", "forecast_end", "threshold",
              "total_objects", "warnings_count", "model_sha256", "input_sha256", "cards_print"]
    return F.sha2(F.to_json(F.struct(*fields)), 256)


# --- validation -------------------------------------------------------------------

def forbidden_fields(schema: T.DataType, path: str = "") -> list[str]:
    """Nested field names that carry outcomes, at any depth of the schema."""
    if isinstance(schema, T.StructType):
        found = []
        for f in schema.fields:
            here = f"{path}.{f.name}".lstrip(".")
            if f.name.lower().startswith("actual_") or f.name.lower() in vocab.OUTCOME_FIELDS:
                found.append(here)
            found += forbidden_fields(f.dataType, here)
        return found
    if isinstance(schema, T.ArrayType):
        return forbidden_fields(schema.elementType, f"{path}[]")
    if isinstance(schema, T.MapType):
        return forbidden_fields(schema.valueType, f"{path}{{}}")
    return []


def release_violations(runs: DataFrame, cards: DataFrame, k: int) -> DataFrame:
    """Counters of broken release rules per run; all zero for a valid release."""
    leaked = forbidden_fields(runs.schema) + forbidden_fields(cards.schema)
    if leaked:
        raise ValueError(f"outcome fields in a release: {leaked}")
    sha = "^[0-9a-f]{64}$"
    hour = F.lit(3600.0)
    lead = (F.unix_timestamp("forecast_start") - F.unix_timestamp("issue_time")) / hour
    window = (F.unix_timestamp("forecast_end") - F.unix_timestamp("forecast_start")) / hour
    run_rules = {
        "lead_below_24h": lead < 24, "lead_mismatch": F.abs(lead - F.col("minimum_lead_hours")) > 1e-9,
        "empty_window": window <= 0, "window_mismatch": F.abs(window - F.col("window_hours")) > 1e-9,
        "cutoff_after_issue": F.col("feature_cutoff") >= F.col("issue_time"),
        "bad_digest": ~F.col("model_sha256").rlike(sha) | ~F.col("input_sha256").rlike(sha),
        "threshold_range": F.col("threshold").isNull() | ~F.col("threshold").between(0, 1)}
    ordered = ranked(cards, ["run_id"], [-F.col("score"), F.col("object_id").cast("string"), F.col("id")], "_expected")
    score = F.col("score")
    card_rules = {
        "card_id_without_run": ~F.contains("id", "run_id"),
        "score_range": score.isNull() | F.isnan(score) | ~score.between(0, 1),
        "rank_mismatch": F.col("rank") != F.col("_expected"),
        "warning_mismatch": F.col("warning") != (F.col("_expected") <= k).cast("int")}
    per_card = ordered.groupBy("run_id").agg(
        F.count("*").alias("_cards"), F.sum("warning").alias("_warnings"),
        F.max(F.when(F.col("_expected") == k, score)).alias("_boundary"),
        *[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in card_rules.items()])
    # Repeated objects are counted per (run, object): no distinct set per run is built.
    repeated = (cards.groupBy("run_id", "object_id").agg((F.count("*") - 1).alias("n"))
                .groupBy("run_id").agg(F.sum("n").alias("repeated_objects")))
    # A run without cards and cards without a run are violations themselves.
    joined = runs.join(per_card, "run_id", "full").join(repeated, "run_id", "left")
    totals = {
        "threshold_mismatch": ~F.col("threshold").eqNullSafe(F.col("_boundary")),
        "total_mismatch": F.col("total_objects") != F.col("_cards"),
        "warnings_mismatch": (F.col("warnings_count") != F.col("_warnings")) | (F.col("_warnings") != k)}
    return joined.select(
        "run_id", *[F.coalesce(c, F.lit(True)).cast("int").alias(n) for n, c in {**run_rules, **totals}.items()],
        *[F.coalesce(F.col(n), F.lit(1)).alias(n) for n in card_rules], F.coalesce("repeated_objects", F.lit(0)).alias("repeated_objects"))


def broken_releases(runs: DataFrame, cards: DataFrame, k: int) -> DataFrame:
    """Runs that break a rule, with the counters of ``release_violations``."""
    found = release_violations(runs, cards, k)
    rules = [F.coalesce(F.col(c), F.lit(1)) > 0 for c in found.columns if c != "run_id"]
    return found.where(functools.reduce(lambda a, b: a | b, rules))


# --- archive ----------------------------------------------------------------------

MANIFEST = "run_id string, content_sha256 string, attempt string"


def _create_exclusively(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that was not there; False if somebody else was first.

    The file system decides: creation without overwriting succeeds for one writer only.
    """
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    try:
        out = fs.create(target, False)
    except Py4JJavaError as error:
        if "AlreadyExists" not in str(error.java_exception.getClass().getName()):
            raise
        return False
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _manifest(spark: SparkSession, path: str, run_id: str) -> dict | None:
    """What the archive says of one run, if it is published; no other run is looked at."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{run_id}.json")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for _ in range(50):  # the winner may still be writing its few bytes
        if not fs.exists(target):
            return None
        row = spark.read.schema(MANIFEST).json(target.toString()).first()
        if row is not None and row.attempt is not None:
            return row.asDict()
        time.sleep(0.1)
    raise ValueError(f"the manifest of {run_id} is not complete; remove it if its writer is gone")


def publish(runs: DataFrame, cards: DataFrame, path: str, k: int | None = None) -> int:
    """Archive releases once; returns how many were new.

    With ``k`` every release is validated first; a broken one stops the publication.  The same run with the
    same content is a no-op, with other content an error, also beside a second writer: rows go to a
    folder of this attempt, partitioned by run, and the exclusive creation of the run's manifest
    makes them visible.  Only the published runs' own manifests are read.
    """
    spark = runs.sparkSession
    if k is not None:
        expect_empty(broken_releases(runs, cards, k), "broken releases")
    expect_empty(cards.where(~F.contains("id", "run_id")).select("run_id", "id"), "a card id belongs to another release")
    asked = {r.run_id: r.content_sha256 for r in runs.select("run_id", "content_sha256").collect()}  # one row for each run

    def known(run_id: str) -> bool:
        there = _manifest(spark, path, run_id)
        if there is not None and there["content_sha256"] != asked[run_id]:
            raise ValueError(f"release exists with other content: {run_id}")
        return there is not None

    fresh = sorted(r for r in asked if not known(r))
    if not fresh:
        return 0
    attempt = f"a-{uuid.uuid4().hex}"
    new = F.col("run_id").isin(fresh)
    cards.where(new).write.partitionBy("run_id").parquet(f"{path}/cards/attempt={attempt}")
    runs.where(new).write.partitionBy("run_id").parquet(f"{path}/runs/attempt={attempt}")
    count = 0
    for run_id in fresh:
        text = json.dumps({"run_id": run_id, "content_sha256": asked[run_id], "attempt": attempt})
        if _create_exclusively(spark, f"{path}/manifests/{run_id}.json", text):
            count += 1
        else:
            known(run_id)
    return count


def open_archive(spark: SparkSession, path: str, run_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(runs, cards) of the published releases, or of one; rows of attempts that lost or broke off are not seen."""
    manifests = spark.read.schema(MANIFEST).json(f"{path}/manifests/{run_id or '*'}.json").select("run_id", "attempt")

    def committed(name: str) -> DataFrame:
        rows = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
        if run_id is not None:
            rows = rows.where(F.col("run_id") == run_id)
        return rows.join(manifests, ["run_id", "attempt"], "left_semi").drop("attempt")

    return committed("runs"), committed("cards")


def list_releases(runs: DataFrame, mode: str | None = None, limit: int = 100) -> DataFrame:
    """Newest releases first."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    rows = runs if mode is None else runs.where(F.col("mode") == mode)
    return rows.orderBy(F.desc("issue_time"), F.desc("run_id")).limit(limit)


def verify_releases(runs: DataFrame, cards: DataFrame) -> DataFrame:
    """Recompute card fingerprints and digests of stored releases."""
    content = [c for c in cards.columns if c not in ("run_id", "explanation")]
    prints = fingerprints(cards, ["run_id"], content).select(
        "run_id", F.concat_ws("|", F.col("rows").cast("string"), F.col("hash_sum").cast("string")).alias("_print"))
    joined = runs.withColumn("_digest", content_digest()).join(prints, "run_id", "left")
    return joined.select(
        "run_id", F.col("cards_print").eqNullSafe(F.col("_print")).cast("int").alias("cards_intact"),
        (F.col("_digest") == F.col("content_sha256")).cast("int").alias("header_intact"))


def outcomes(cards: DataFrame, mart: DataFrame) -> DataFrame:
    """Realised outcome of each card, kept apart from the release itself."""
    real = mart.select("object_id", F.date_sub("date", 2).alias("date"),
                       F.col("alarm_today").alias("actual_alarm"), F.col("observed_today").alias("actual_records"))
    return cards.select("run_id", "id", "object_id", "date").join(real, ["object_id", "date"], "left")


def without_outcomes(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("actual_") or c in vocab.OUTCOME_FIELDS])


def ranked_cards(scored: DataFrame, objects: DataFrame, k: int) -> DataFrame:
    # Ranking passes over its input three times; the cards are written first.
    return rank_queue(materialize(build_cards(scored, objects), "unranked"), k)
