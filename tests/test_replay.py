"""All feature days at once against one day at a time."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from watchgrid import vocab
from watchgrid.operators import features as W
from watchgrid.operators import objects as O
from watchgrid.operators import release, replay, versions
from watchgrid.session import materialize, shared_folder

D = dt.date
SHA = "0" * 63 + "2"
COLUMNS = ["channel_id", "date", *vocab.MODEL_COUNTERS]
FIRST, SEED_END, LAST = D(2024, 3, 1), D(2024, 3, 3), D(2024, 3, 10)


def made(spark):
    """Three objects; corrections at odd hours, one at the very instant of the original, one beyond the last issue time."""
    def row(channel, day, alarms):
        counts = {c: 1 for c in vocab.MODEL_COUNTERS} | {"alarm_count": alarms, "events_count": 5}
        return (channel, day, *[counts[c] for c in vocab.MODEL_COUNTERS])

    days = [FIRST + dt.timedelta(i) for i in range(10)]
    seed, deliveries = [], []
    for i, day in enumerate(days):
        midnight = dt.datetime.combine(day, dt.time()) + dt.timedelta(hours=21)  # the day's end in the issue zone
        rows = [row(f"c{k}", day, (i * 7 + k * 3) % 4 // 3) for k in range(6) if (i + k) % 5 and (k < 5 or i > 6)]
        if day <= SEED_END:
            seed += rows
            continue
        deliveries += [(*r, day, midnight, "a") for r in rows]
        if i % 2:
            deliveries += [(*r[:2], *[v + 1 for v in r[2:]], day, midnight + dt.timedelta(hours=30), "b") for r in rows]
        if i % 3 == 0:
            deliveries += [(*r, day, midnight, "0") for r in rows]
        if i == 4:
            deliveries += [(*r[:2], *[v + 2 for v in r[2:]], day, midnight + dt.timedelta(days=60), "z") for r in rows]
    kinds = "channel_id string, date date, " + ", ".join(f"{c} long" for c in vocab.MODEL_COUNTERS)
    channels = spark.createDataFrame([(f"c{k}", f"o{k // 2}") for k in range(6)], "channel_id string, object_id string")
    objects = spark.createDataFrame([("o0", "first", "k", None), ("o1", "second", None, "o0")],
                                    "object_id string, object_name string, object_kind string, parent_id string")
    return (spark.createDataFrame(seed, kinds), spark.createDataFrame(deliveries, kinds + ", day date, available_at timestamp, batch_id string"),
            channels, objects)


def score(mart):
    return mart.withColumn("score", F.round(F.avg("alarm_today").over(W.running(O.by_day())), 6))


def lit(day):
    return F.lit(day)


def test_all_days_at_once_equal_each_day_alone(spark):
    seed, batches, channels, objects = made(spark)
    path = shared_folder(spark, "test-archive")
    args = (seed, batches, channels, objects, score, lit(FIRST), lit(SEED_END), lit(D(2024, 3, 9)), 2, path, SHA)
    assert replay.replay_days(*args) == 7 and replay.replay_days(*args) == 0
    runs, cards = release.open_archive(spark, path)
    columns = [c for c in cards.columns if c not in ("run_id", "id")]
    for n in range(7):
        day = LAST - dt.timedelta(n)
        history = materialize(versions.assemble_history(seed, batches, lit(day)), "test-history")
        digest = history.sparkSession.range(1).select(versions.content_sha256(history, COLUMNS)).first()[0]
        alone = replay.forecast_day(history, channels, objects, score, lit(FIRST), str(day), lit(D(2024, 3, 9)), 2,
                                    identity={"input": digest, "model_sha": SHA})
        want = sorted(map(str, (r.asDict() for r in alone.select("run_id", "id", *columns).collect())))
        assert sorted(map(str, (r.asDict() for r in cards.where(F.col("date") == lit(day)).select("run_id", "id", *columns).collect()))) == want
        header = runs.where(F.col("date") == lit(day)).first()
        assert header.input_sha256 == digest
        assert header.content_sha256 == release.build_runs(alone, SHA, F.lit(digest)).first().content_sha256
    assert {r.object_name for r in cards.select("object_name").distinct().collect()} == {"first", "second", "o2"}  # o2 is not in the dictionary


def test_a_late_day_stops_the_replay(spark):
    seed, batches, channels, objects = made(spark)
    late = batches.withColumn("available_at", F.when(F.col("day") == lit(D(2024, 3, 6)), F.col("available_at") + F.expr("INTERVAL 3 DAYS"))
                              .otherwise(F.col("available_at")))
    problems = versions.replay_problems(seed, late, COLUMNS, lit(SEED_END), lit(LAST)).collect()
    assert [(r.problem, r.day) for r in problems] == [("missing day", D(2024, 3, 6))]
    assert versions.history_problems(seed, late, COLUMNS, lit(SEED_END), lit(LAST)).isEmpty()  # by then it is there
    with pytest.raises(ValueError):
        replay.replay_days(seed, late, channels, objects, score, lit(FIRST), lit(SEED_END), lit(LAST), 2, shared_folder(spark, "x"), SHA)


def test_validity_is_what_each_issue_time_sees(spark):
    _, batches, _, _ = made(spark)
    valid = versions.validity(batches.select(*versions.BATCH_KEYS).distinct())
    got = {(r.feature_date, r.day, r.batch_id) for r in versions.on_feature_days(valid, lit(LAST)).collect()}
    want = set()
    for n in range(7):
        day = LAST - dt.timedelta(n)
        want |= {(day, r.day, r.batch_id) for r in versions.visible_batches(batches, lit(day)).select("day", "batch_id").distinct().collect()}
    assert got == want
    week = {(f, d, b) for f, d, b in want if (f - d).days < 3}
    assert {(r.feature_date, r.day, r.batch_id) for r in versions.on_feature_days(valid, lit(LAST), 3).collect()} == week


def test_versions_are_summed_in_one_pass_and_attributes_come_before_the_calendar(spark):
    seed, batches, channels, objects = made(spark)
    told = versions.delivered_versions(batches, COLUMNS)
    prints = versions.fingerprints(batches, versions.BATCH_KEYS, COLUMNS)
    assert sorted(map(str, told.drop("strayed").collect())) == sorted(map(str, prints.collect()))
    moved = batches.withColumn("date", F.when(F.col("day") == lit(D(2024, 3, 6)), F.date_add("date", 1)).otherwise(F.col("date")))
    assert [r.day for r in versions.delivered_versions(moved, COLUMNS).where("strayed > 0").select("day").distinct().collect()] == [D(2024, 3, 6)]
    told = materialize(told, "test-versions")
    facts = materialize(replay.as_of(seed, batches, channels, lit(FIRST), lit(SEED_END), lit(LAST), None, told, O.attributes(objects, channels)), "test-facts")
    mart = O.mart_of(facts, None, lit(FIRST), F.to_date(F.substring_index("object_id", "|", 1)), lit(LAST))
    assert "Join" not in mart._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.object_id.split("|")[1], r.object_kind, r.parent_id, r.catalog_channels) for r in mart.collect()}
    assert got == {("o0", "k", "unknown", 2), ("o1", "unknown", "o0", 2), ("o2", None, None, None)}
