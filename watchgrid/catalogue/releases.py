"""Forecast releases, recommendations, replay and causality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid import vocab
from watchgrid.catalogue.joins import BATCH_COLUMNS, SEED_END, batches
from watchgrid.catalogue.object_windows import _episode_sql
from watchgrid.catalogue.registry import query, rounded
from watchgrid.operators import features as W
from watchgrid.operators import invariants as I
from watchgrid.operators import joins as J
from watchgrid.operators import labels as L
from watchgrid.operators import objects as O
from watchgrid.operators import recommend as RC
from watchgrid.operators import release as R
from watchgrid.operators import replay, versions
from watchgrid.session import materialize, shared_folder
from watchgrid.sources import testtables as T

MODEL_SHA = "0" * 63 + "1"


@query("table_fingerprint", """
SELECT "date", count(*) AS "rows", CAST(1 AS BIGINT) AS same_after_shuffle, CAST(max(CASE WHEN alarm_count > 0 THEN 0 ELSE 1 END) = 1
 AND max(CASE WHEN alarm_count > 0 THEN 1 ELSE 0 END) = 0 AS BIGINT) AS same_after_change FROM cd GROUP BY "date" """)
def table_fingerprint(spark, sf):
    daily = materialize(T.channel_days(spark, sf).select(*BATCH_COLUMNS), "daily")
    versions_of = {
        "same_after_shuffle": daily.repartition(5, "alarm_count"),
        "same_after_change": daily.withColumn("alarm_count", F.col("alarm_count") * 2)}
    out = versions.fingerprints(daily, ["date"], BATCH_COLUMNS).select("date", "rows", F.struct("rows", "hash_sum", "hash_xor").alias("p"))
    for name, other in versions_of.items():
        prints = versions.fingerprints(other, ["date"], BATCH_COLUMNS).select(
            "date", F.struct("rows", "hash_sum", "hash_xor").alias("_q"))
        out = out.join(prints, "date").withColumn(name, (F.col("p") == F.col("_q")).cast("int")).drop("_q")
    return rounded(out.drop("p"))


_RUN = """concat('object_', strftime("date", '%Y-%m-%d'), '_', substr(sha256('{"alarms":' || alarms || ',"events":' || events
 || ',"feature_date":"' || strftime("date", '%Y-%m-%d') || '"}'), 1, 16))"""
_RUNS = f"""run_ids AS (SELECT "date", {_RUN} AS run_id FROM (
 SELECT "date", CAST(sum(alarm_today) AS BIGINT) AS alarms, CAST(sum(events_count) AS BIGINT) AS events FROM od GROUP BY "date"))"""


@query("release_identity", f"WITH {_RUNS} SELECT * FROM run_ids")
def release_identity(spark, sf):
    return run_ids(T.object_mart(spark, sf))


def run_ids(mart):
    """Run id of each day from a lineage of its inputs, keys in sorted order."""
    inputs = mart.groupBy("date").agg(F.sum("alarm_today").alias("alarms"), F.sum("events_count").alias("events"))
    lineage = F.struct("alarms", "events", F.date_format("date", "yyyy-MM-dd").alias("feature_date"))
    return inputs.select("date", R.release_id("object", F.col("date"), lineage).alias("run_id"))


_SCORED = f"""{_RUNS}, scored AS (SELECT od.*, round((pos + 30 * g) / (n + 30), 6) AS score, run_id,
 CAST(sum(alarm_today) OVER w AS BIGINT) AS alarm_days_7d, CAST(sum(observed_today) OVER w AS BIGINT) AS observed_days_7d
 FROM od JOIN rates USING (object_id) CROSS JOIN global_rate JOIN run_ids USING ("date")
 WINDOW w AS (PARTITION BY object_id ORDER BY "date" ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
cards AS (SELECT s.run_id, concat(s.run_id, '_', s.object_id) AS id, s.object_id, s."date", o.object_name, coalesce(o.object_kind, 'unknown') AS object_kind,
 o.parent_id, coalesce(p.object_name, 'Группа ' || o.parent_id) AS parent_name, score, alarm_today AS current_alarm, events_count AS events_today,
 alarm_channels, observed_channels, catalog_channels, alarm_days_7d, observed_days_7d,
 CASE WHEN observed_channels = 0 THEN '{vocab.NOTE_NO_RECORDS}' ELSE '{vocab.NOTE_RECORDS}' END AS observation_note,
 row_number() OVER (PARTITION BY s."date" ORDER BY score DESC, s.object_id) AS "rank"
 FROM scored s JOIN objects o USING (object_id) LEFT JOIN objects p ON p.object_id = o.parent_id)"""
_FINAL = """final AS (SELECT *, CAST("rank" <= 10 AS BIGINT) AS warning, max(CASE WHEN "rank" = 10 THEN score END) OVER (PARTITION BY "date") AS threshold FROM cards)"""


def scored_mart(spark, sf):
    mart = materialize(O.recap_7d(T.object_mart(spark, sf)), "mart")
    scored = O.smoothed_frequency(L.label_onset(mart), T.day(T.TRAIN_END)).withColumn("score", F.round("smoothed", 6))
    return R.without_outcomes(scored).join(run_ids(mart), "date")


def cards(spark, sf):
    """Ranked cards of every day, written once."""
    return materialize(R.ranked_cards(scored_mart(spark, sf), T.objects(spark, sf), 10), "cards")


@query("build_cards", f"WITH {_SCORED}, {_FINAL} SELECT * FROM final")
def build_cards(spark, sf):
    return rounded(R.ranked_cards(scored_mart(spark, sf), T.objects(spark, sf), 10))


@query("release_summary", f"""WITH {_SCORED}, {_FINAL}
SELECT run_id, "date", count(*) AS total_objects, CAST(sum(warning) AS BIGINT) AS warnings_count,
 count(*) FILTER (observed_channels > 0) AS observed_objects_today, max(threshold) AS threshold FROM final GROUP BY ALL""")
def release_summary(spark, sf):
    return rounded(R.release_summary(cards(spark, sf)))


COEFFICIENTS = {"alarm_channels": 0.7, "events_count": 0.013, "observed_channels": -0.2, "alarm_days_7d": 0.31,
                "alarm_channel_fraction": 1.9, "catalog_channels": 0.05}


@query("explain_top3", f"""WITH {_RUNS}, t AS (SELECT object_id, "date", alarm_channels, events_count, observed_channels, catalog_channels,
 CAST(sum(alarm_today) OVER (PARTITION BY object_id ORDER BY "date" ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS alarm_days_7d,
 alarm_channels / nullif(observed_channels, 0) AS alarm_channel_fraction FROM od),
 terms AS (""" + " UNION ALL ".join(
    f"SELECT object_id, \"date\", '{f}' AS feature, {f} * {c} AS contribution, coalesce(printf('%.3g', CAST({f} AS DOUBLE)), '{vocab.NO_OBSERVATION}') AS value FROM t"
    for f, c in COEFFICIENTS.items()) + """)
SELECT object_id, "date", place - 1 AS place, feature, round(contribution, 6) AS contribution, value FROM (
 SELECT *, row_number() OVER (PARTITION BY object_id, "date" ORDER BY contribution DESC, feature DESC) AS place FROM terms WHERE contribution > 0) WHERE place <= 3""")
def explain_top3(spark, sf):
    mart = O.recap_7d(T.object_mart(spark, sf))
    top = mart.select("object_id", "date", F.posexplode(R.explain_top3(COEFFICIENTS)).alias("place", "t"))
    return rounded(top.select("object_id", "date", "place", "t.feature", "t.contribution", "t.value"))


def releases(spark, sf):
    made = cards(spark, sf)
    digest = F.sha2(F.col("run_id"), 256)
    return materialize(R.build_runs(made, MODEL_SHA, digest), "runs"), made


@query("validate_release", f"""WITH {_SCORED}, {_FINAL},
 broken AS (SELECT *, CASE WHEN observed_channels = 0 THEN 1 - warning ELSE warning END AS w, CASE WHEN alarm_channels > 1 THEN score + 1 ELSE score END AS s FROM final),
 ordered AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY s DESC, object_id) AS e FROM broken)
SELECT run_id, count(*) FILTER (s > 1) AS score_range, count(*) FILTER ("rank" <> e) AS rank_mismatch,
 count(*) FILTER (w <> CASE WHEN e <= 10 THEN 1 ELSE 0 END) AS warning_mismatch,
 CAST(max(threshold) IS DISTINCT FROM max(CASE WHEN e = 10 THEN s END) AS BIGINT) AS threshold_mismatch, CAST(sum(w) <> 10 AS BIGINT) AS warnings_mismatch,
 CAST(0 AS BIGINT) AS total_mismatch, CAST(0 AS BIGINT) AS lead_below_24h, CAST(0 AS BIGINT) AS repeated_objects FROM ordered GROUP BY run_id""")
def validate_release(spark, sf):
    # Releases damaged after the fact: flipped warnings on silent objects, raised scores.
    runs, made = releases(spark, sf)
    damaged = made.withColumn("warning", F.when(F.col("observed_channels") == 0, 1 - F.col("warning")).otherwise(F.col("warning")))
    damaged = damaged.withColumn("score", F.when(F.col("alarm_channels") > 1, F.col("score") + 1).otherwise(F.col("score")))
    found = R.release_violations(runs, materialize(damaged, "damaged"), 10)
    return rounded(found.select("run_id", "score_range", "rank_mismatch", "warning_mismatch", "threshold_mismatch",
                                "warnings_mismatch", "total_mismatch", "lead_below_24h", "repeated_objects"))


def published(spark, sf):
    """An archive after a first, a repeated and a second publication."""
    path = shared_folder(spark, "archive")
    runs, made = releases(spark, sf)
    early = F.col("date") <= T.day("2024-01-20")
    counts = [R.publish(runs.where(early), made.where(early), path), R.publish(runs.where(early), made.where(early), path),
              R.publish(runs, made, path)]
    return path, counts, runs, made


@query("publish_release", f"""WITH {_SCORED}
SELECT run_id, count(*) AS stored_cards, CAST(20 AS BIGINT) AS first_time, CAST(0 AS BIGINT) AS again, CAST(10 AS BIGINT) AS later FROM cards GROUP BY run_id""")
def publish_release(spark, sf):
    path, counts, runs, made = published(spark, sf)
    stored = R.open_archive(spark, path)[1]
    return stored.groupBy("run_id").agg(F.count("*").alias("stored_cards")).select(
        "*", *[F.lit(n).cast("long").alias(c) for c, n in zip(("first_time", "again", "later"), counts)])


@query("list_releases", f"""WITH {_SCORED}, {_FINAL}
SELECT run_id, "date", max(threshold) AS threshold FROM final GROUP BY run_id, "date" ORDER BY "date" DESC LIMIT 12""")
def list_releases(spark, sf):
    runs, _ = releases(spark, sf)
    return R.list_releases(runs, "historical_replay", 12).select("run_id", "date", "threshold")


@query("verify_releases", f"""WITH {_SCORED}, {_FINAL}
SELECT run_id, CAST(max(alarm_channels) <= 1 AS BIGINT) AS cards_intact, CAST(1 AS BIGINT) AS header_intact FROM final GROUP BY run_id""")
def verify_releases(spark, sf):
    # Stored cards of objects with several alarm channels were altered.
    runs, made = releases(spark, sf)
    altered = made.withColumn("events_today", F.when(F.col("alarm_channels") > 1, F.col("events_today") + 1).otherwise(F.col("events_today")))
    return rounded(R.verify_releases(runs, altered))


def facts(spark, sf):
    """Card facts, some damaged: too many observed channels, lost recaps, alarms without channels."""
    made = T.object_mart(spark, sf)
    ranked = O.recap_7d(made).select(
        "object_id", "date", "observed_channels", "catalog_channels", F.col("events_count").alias("events_today"),
        "alarm_channels", (F.col("alarm_today") == 1).alias("current_alarm"), "alarm_days_7d", "observed_days_7d",
        (F.col("alarm_days_7d") >= 1).alias("warning"), F.lit(1).alias("rank"))
    return ranked.withColumns({
        "observed_channels": F.expr("CASE WHEN events_today > 25 THEN observed_channels + 7 ELSE observed_channels END"),
        "alarm_days_7d": F.expr("CASE WHEN alarm_channels >= 2 THEN NULL ELSE alarm_days_7d END"),
        "alarm_channels": F.expr("CASE WHEN events_today BETWEEN 18 AND 20 THEN 0 ELSE alarm_channels END"),
        "rank": F.expr("CASE WHEN events_today = 3 THEN 0 ELSE 1 END")})


_FACTS = """facts AS (SELECT object_id, "date", CASE WHEN events_count > 25 THEN observed_channels + 7 ELSE observed_channels END AS oc, catalog_channels AS cc,
 events_count AS ev, CASE WHEN events_count BETWEEN 18 AND 20 THEN 0 ELSE alarm_channels END AS ac, alarm_today = 1 AS ca,
 CASE WHEN alarm_channels >= 2 THEN NULL ELSE a7 END AS a7, o7, a7 >= 1 AS warn, CASE WHEN events_count = 3 THEN 0 ELSE 1 END AS rk FROM (
 SELECT *, CAST(sum(alarm_today) OVER w AS BIGINT) AS a7, CAST(sum(observed_today) OVER w AS BIGINT) AS o7 FROM od
 WINDOW w AS (PARTITION BY object_id ORDER BY "date" ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))),
errs AS (SELECT *, concat_ws(';', CASE WHEN a7 IS NULL THEN 'alarm_days_7d:missing' END, CASE WHEN rk < 1 THEN 'rank:expected_positive_integer' END) AS e1,
 concat_ws(';', CASE WHEN oc > cc THEN 'observed_channels:exceeds_catalog_channels' END, CASE WHEN ac > oc THEN 'alarm_channels:exceeds_observed_channels' END,
  CASE WHEN ev < oc THEN 'events_today:fewer_events_than_observed_channels' END, CASE WHEN (ev > 0) <> (oc > 0) THEN 'events_today:inconsistent_with_observed_channels' END,
  CASE WHEN ca <> (ac > 0) THEN 'current_alarm:inconsistent_with_alarm_channels' END, CASE WHEN a7 > o7 THEN 'alarm_days_7d:exceeds_observed_days' END,
  CASE WHEN ca AND a7 = 0 THEN 'alarm_days_7d:omits_current_alarm_day' END, CASE WHEN oc > 0 AND o7 = 0 THEN 'observed_days_7d:omits_current_observed_day' END,
  CASE WHEN oc = 0 AND o7 = 7 THEN 'observed_days_7d:includes_unobserved_current_day' END,
  CASE WHEN NOT ca AND a7 = 7 THEN 'alarm_days_7d:includes_unalarmed_current_day' END) AS e2 FROM facts),
checked AS (SELECT *, CASE WHEN e1 <> '' THEN e1 ELSE e2 END AS errors FROM errs)"""


@query("check_facts", f"""WITH {_FACTS} SELECT object_id, "date", errors, CASE WHEN errors = '' THEN 'ok' ELSE 'insufficient_data' END AS status FROM checked""")
def check_facts(spark, sf):
    checked = RC.check_facts(facts(spark, sf))
    text = F.array_join(F.transform("validation_errors", lambda e: F.concat_ws(":", e["field"], e["code"])), ";")
    return checked.select("object_id", "date", text.alias("errors"), "status")


def _text_sql(rule: str) -> str:
    text = vocab.REVIEW_RULES[rule][1]
    for name, column in (("observed_channels", "oc"), ("catalog_channels", "cc"), ("alarm_days_7d", "a7")):
        text = text.replace("{" + name + "}", f"' || {column} || '")
    return f"'{text}'"


@query("recommend", f"""WITH {_FACTS}, steps AS (
 SELECT *, 1 AS o, 'NO_RECORDS_TODAY' AS rule_id, {_text_sql('NO_RECORDS_TODAY')} AS "text" FROM checked WHERE errors = '' AND oc = 0
 UNION ALL SELECT *, 2, 'PARTIAL_CATALOG_RECORDS', {_text_sql('PARTIAL_CATALOG_RECORDS')} FROM checked WHERE errors = '' AND oc > 0 AND oc < cc
 UNION ALL SELECT *, 3, 'ALARM_RECORDED_TODAY', {_text_sql('ALARM_RECORDED_TODAY')} FROM checked WHERE errors = '' AND oc > 0 AND ca
 UNION ALL SELECT *, 4, 'MULTIPLE_ALARM_DAYS', {_text_sql('MULTIPLE_ALARM_DAYS')} FROM checked WHERE errors = '' AND oc > 0 AND a7 >= 2
 UNION ALL SELECT *, 5, CASE WHEN warn THEN 'SELECTED_FOR_REVIEW' ELSE 'OUTSIDE_WARNING_POLICY' END,
  CASE WHEN warn THEN {_text_sql('SELECTED_FOR_REVIEW')} ELSE {_text_sql('OUTSIDE_WARNING_POLICY')} END
  FROM checked WHERE errors = '' AND oc > 0 AND NOT (oc < cc) AND NOT ca AND NOT (a7 >= 2))
SELECT object_id, "date", row_number() OVER (PARTITION BY object_id, "date" ORDER BY o) - 1 AS place, rule_id, "text" FROM steps""")
def recommend(spark, sf):
    steps = RC.recommend(facts(spark, sf)).select("object_id", "date", F.posexplode("steps").alias("place", "s"))
    return rounded(steps.select("object_id", "date", "place", "s.rule_id", "s.text"))


@query("outcome_join", f"""WITH {_SCORED}
SELECT c.run_id, c.id, c.object_id, c."date", od.alarm_today AS actual_alarm, od.observed_today AS actual_records
FROM cards c LEFT JOIN od ON od.object_id = c.object_id AND od."date" = c."date" + 2""")
def outcome_join(spark, sf):
    return rounded(R.outcomes(cards(spark, sf), T.object_mart(spark, sf)))


# Every feature day from the bootstrap's end to the last delivery, each with the history of its issue time: corrections of
# earlier fifth days only, and objects with a record up to the cutoff that this day has already seen.
@query("replay_days", """
SELECT object_id, "date", score, row_number() OVER (PARTITION BY "date" ORDER BY score DESC, object_id) AS "rank",
 CAST(row_number() OVER (PARTITION BY "date" ORDER BY score DESC, object_id) <= 10 AS BIGINT) AS warning, CAST(0 AS BIGINT) AS repeated FROM (
 SELECT object_id, f AS "date", round(sum(alarm) / (f - DATE '2024-01-01' + 1), 6) AS score FROM (
  SELECT f, object_id, "date", max(CASE WHEN alarm_count > 0 OR "date" > DATE '2024-01-03' AND "date" < f AND day("date") % 5 = 0 THEN 1 ELSE 0 END) AS alarm
  FROM cd JOIN channels USING (channel_id)
  JOIN (SELECT DISTINCT "date" AS f FROM cd WHERE "date" > DATE '2024-01-03') d ON "date" <= f GROUP BY ALL)
 GROUP BY object_id, f HAVING min("date") <= DATE '2024-01-15')""")
def replay_days(spark, sf):
    columns = ["channel_id", "date", *vocab.MODEL_COUNTERS]
    days = materialize(T.channel_days(spark, sf).select(*columns), "days")
    delivered = materialize(batches(spark, sf, columns, days), "batches")
    seed = materialize(days.where(F.col("date") <= T.day(SEED_END)), "seed")
    path = shared_folder(spark, "archive")

    def score(mart):
        return mart.withColumn("score", F.round(F.avg("alarm_today").over(W.running(O.by_day())), 6))

    def run():
        return replay.replay_days(seed, delivered, T.channels(spark, sf), T.objects(spark, sf), score,
                                  T.day(T.CALENDAR[0]), T.day(SEED_END), T.day(T.TRAIN_END), 10, path, MODEL_SHA)

    run()
    repeated = run()
    stored = R.open_archive(spark, path)[1]
    return rounded(stored.select("object_id", "date", "score", "rank", "warning", F.lit(repeated).alias("repeated")))


# --- causality --------------------------------------------------------------------

def _zero_sql(source: str, columns: list[str], cut: str) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS column_name, CAST(0 AS BIGINT) AS mismatches, CAST(0 AS BIGINT) AS left_only,
 CAST(0 AS BIGINT) AS right_only, count(*) AS common FROM {source} WHERE "date" <= DATE '{cut}'""" for c in columns)


_CHANNEL = ["alarm_streak", "days_since_alarm", "alarm_starts_28d", "transition_from_0", "alarm_ewm_7",
            "numeric_deviation", "observed_tomorrow_weekday_4w", "events_count_sum_7d"]


def _short(df):
    return df.select("column_name", "mismatches", "left_only", "right_only", "common")


@query("prefix_invariance", _zero_sql("g", _CHANNEL, "2024-01-20"))
def prefix_invariance(spark, sf):
    daily = materialize(T.channel_days(spark, sf), "daily")

    def build(raw):
        grid = J.densify(raw, T.channels(spark, sf), T.day(T.CALENDAR[0]), raw.agg(F.max("date")).scalar())
        return materialize(W.channel_mart(W.with_masks(grid)).select("channel_id", "date", *_CHANNEL), "mart")

    return _short(I.check_prefix(build, daily, ["channel_id", "date"], _CHANNEL, T.day("2024-01-20")))


_OBJECT = ["alarm_streak", "historical_alarm_frequency", "events_count_mean28", "alarm_channels_lag7",
           "past_onset_frequency", "markov_45"]


@query("future_mutation", _zero_sql("od", _OBJECT, "2024-01-20"))
def future_mutation(spark, sf):
    daily = materialize(T.channel_days(spark, sf), "daily")

    def build(raw):
        mart = O.object_mart(raw, T.channels(spark, sf), T.objects(spark, sf), *[T.day(d) for d in T.CALENDAR],
                             cutoff=T.day(T.TRAIN_END))
        mart = materialize(mart, "mart")
        features = O.onset_features(O.with_signals(mart))
        return materialize(O.markov_forecast(features, O.markov_prior(mart, T.day(T.TRAIN_END)), 45).select(
            "object_id", "date", *_OBJECT), "features")

    return _short(I.check_mutation(build, daily, ["object_id", "date"], _OBJECT, vocab.MODEL_COUNTERS, T.day("2024-01-20")))


@query("label_free_scoring", _zero_sql("od", ["score"], "2024-01-30"))
def label_free_scoring(spark, sf):
    frame = materialize(T.labelled(spark, sf), "labelled")
    prior = O.weekday_prior(frame, T.day(T.TRAIN_END))

    def score(df):
        return O.seasonal_forecast(df, prior, 90).withColumnRenamed("seasonal_90", "score")

    return _short(I.check_label_free(score, frame, ["object_id", "date"], "score", [
        "alarm_target", "onset_target", "joint_target", "quiet_intermediate"]))


@query("gap_nesting", "WITH e AS (" + " UNION ALL ".join(_episode_sql("(SELECT *, i AS d FROM od)", g) for g in (1, 3, 7)) + """)
SELECT count(*) FILTER (gap = 1 AND episode_start = 1) AS starts_1, count(*) FILTER (gap = 3 AND episode_start = 1) AS starts_3,
 count(*) FILTER (gap = 7 AND episode_start = 1) AS starts_7, CAST(0 AS BIGINT) AS broken_7_in_3, CAST(0 AS BIGINT) AS broken_3_in_1 FROM e""")
def gap_nesting(spark, sf):
    mart = materialize(T.object_mart(spark, sf).select("object_id", "date", "alarm_today", "observed_today"), "mart")
    parts = [O.episode_labels(mart, g) for g in (1, 3, 7)]
    return I.check_nesting(parts[0].unionByName(parts[1]).unionByName(parts[2]))
