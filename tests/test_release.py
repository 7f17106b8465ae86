import datetime as dt

import pytest
from pyspark.sql import functions as F

from watchgrid.operators import recommend as RC
from watchgrid.operators import release as R
from watchgrid.operators import versions as V
from watchgrid.operators.joins import reconcile
from watchgrid.sources import daily

DAY = dt.date(2024, 1, 10)
UTC = dt.timezone.utc


def cards(spark, n=12, shift=0.0):
    rows = [("object_2024-01-10_abc", f"object_2024-01-10_abc_{i}", str(i), DAY, 0.9 - i / 20 + shift, 3, 2) for i in range(n)]
    df = spark.createDataFrame(rows, "run_id string, id string, object_id string, date date, score double, observed_channels int, events_today int")
    from watchgrid.operators.ranking import rank_queue
    return rank_queue(df, 10)


def run(spark, made):
    return R.build_runs(made, "a" * 64, F.lit("b" * 64))


def test_valid_release_has_no_violations(spark):
    made = cards(spark)
    row = R.release_violations(run(spark, made), made, 10).first().asDict()
    assert {k: v for k, v in row.items() if k != "run_id" and v} == {}


def test_rank_and_counter_violations(spark):
    made = cards(spark)
    bad = made.withColumn("rank", F.when(F.col("rank") == 1, 2).when(F.col("rank") == 2, 1).otherwise(F.col("rank")))
    row = R.release_violations(run(spark, made), bad, 10).first()
    assert row.rank_mismatch == 2 and row.warning_mismatch == 0
    few = R.release_violations(run(spark, made), made.where("rank <= 9"), 10).first()
    assert few.total_mismatch == 1 and few.warnings_mismatch == 1


def test_outcome_fields_are_forbidden_at_any_depth(spark):
    made = cards(spark).withColumn("extra", F.array(F.struct(F.lit(1).alias("Actual_alarm"))))
    with pytest.raises(ValueError, match="Actual_alarm"):
        R.release_violations(run(spark, cards(spark)), made, 10)


def test_two_writers_publish_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "archive")
    made, other = cards(spark).cache(), cards(spark, shift=0.01).cache()
    header, changed = run(spark, made).cache(), run(spark, other).cache()

    def attempt(pair):
        try:
            return R.publish(*pair, path)
        except ValueError as error:
            return str(error)

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(attempt, [(header, made), (header, made), (changed, other), (changed, other)]))
    assert got.count(1) == 1 and got.count(0) == 1 and sum("other content" in str(g) for g in got) == 2
    runs, stored = R.open_archive(spark, path)
    assert runs.count() == 1 and stored.count() == made.count()
    winner = runs.first().content_sha256
    assert R.open_archive(spark, path, runs.first().run_id)[0].first().content_sha256 == winner
    ok = R.verify_releases(runs, stored.select(*made.columns)).first()
    assert (ok.cards_intact, ok.header_intact) == (1, 1)


def test_publish_once_and_refuse_changes(spark, tmp_path):
    path = str(tmp_path / "archive")
    made = cards(spark).cache()
    header = run(spark, made)
    assert [R.publish(header, made, path), R.publish(header, made, path)] == [1, 0]
    other = cards(spark, shift=0.01)
    with pytest.raises(ValueError, match="other content"):
        R.publish(run(spark, other), other, path)
    stolen = cards(spark).withColumn("run_id", F.lit("object_2024-01-11_zzz"))
    with pytest.raises(ValueError, match="another release"):
        R.publish(run(spark, stolen), stolen, path)
    runs, stored = R.open_archive(spark, path)
    ok = R.verify_releases(runs, stored.select(*made.columns)).first()
    assert (ok.cards_intact, ok.header_intact) == (1, 1)


@pytest.mark.parametrize("value", [0.0, 1.0, 0.5, 12.0, 123.456, 999.6, 1234.5, 98765.0, 0.000123456, 0.0000123, -2.345, 100.0, 1e9])
def test_value_text_matches_general_format(spark, value):
    assert spark.range(1).select(R.value_text(F.lit(value)).alias("t")).first().t == f"{value:.3g}"


FACTS = dict(observed_channels=2, catalog_channels=4, events_today=9, alarm_channels=1, current_alarm=True,
             warning=True, alarm_days_7d=3, observed_days_7d=5, rank=1)
SCHEMA = ("observed_channels int, catalog_channels int, events_today int, alarm_channels int, current_alarm boolean, "
          "warning boolean, alarm_days_7d int, observed_days_7d int, rank int")


def advise(spark, **changes):
    facts = {**FACTS, **changes}
    return RC.recommend(spark.createDataFrame([tuple(facts.values())], SCHEMA)).first()


def test_rules_in_order(spark):
    row = advise(spark)
    assert row.rule_ids == ["PARTIAL_CATALOG_RECORDS", "ALARM_RECORDED_TODAY", "MULTIPLE_ALARM_DAYS"]
    assert "2 из 4" in row.steps[0].text and row.status == "ok"
    silent = advise(spark, observed_channels=0, events_today=0, alarm_channels=0, current_alarm=False, alarm_days_7d=0)
    assert silent.rule_ids == ["NO_RECORDS_TODAY"]
    calm = dict(observed_channels=4, alarm_channels=0, current_alarm=False, alarm_days_7d=1)
    assert advise(spark, **calm).rule_ids == ["SELECTED_FOR_REVIEW"]
    assert advise(spark, **calm, warning=False).rule_ids == ["OUTSIDE_WARNING_POLICY"]


@pytest.mark.parametrize("changes,error", [
    (dict(observed_channels=5), ("observed_channels", "exceeds_catalog_channels")),
    (dict(alarm_days_7d=None), ("alarm_days_7d", "missing")),
    (dict(observed_days_7d=8), ("observed_days_7d", "outside_seven_day_window")),
    (dict(rank=0), ("rank", "expected_positive_integer")),
    (dict(events_today=1), ("events_today", "fewer_events_than_observed_channels")),
    (dict(current_alarm=False), ("current_alarm", "inconsistent_with_alarm_channels")),
    (dict(alarm_days_7d=0), ("alarm_days_7d", "omits_current_alarm_day"))])
def test_inconsistent_facts_give_no_advice(spark, changes, error):
    row = advise(spark, **changes)
    assert row.status == "insufficient_data" and row.steps is None
    assert error in [(e.field, e.code) for e in row.validation_errors]


def at(day, hour):
    return dt.datetime(2024, 1, day, hour, tzinfo=UTC)


def batch_rows(spark, rows):
    return spark.createDataFrame(rows, "channel_id string, date date, alarm_count int, day date, available_at timestamp, batch_id string")


def delivery(day, available, batch, alarms=0):
    return ("c", dt.date(2024, 1, day), alarms, dt.date(2024, 1, day), available, batch)


def test_late_corrections_are_visible_later_only(spark):
    rows = [delivery(9, at(9, 21), "a"), delivery(9, at(10, 9), "b", 5), delivery(10, at(10, 21), "a", 1), delivery(10, at(11, 9), "b", 7)]
    seen = {r.date.day: r.alarm_count for r in V.visible_batches(batch_rows(spark, rows), F.lit(DAY)).collect()}
    assert seen == {9: 5, 10: 1}
    later = V.visible_batches(batch_rows(spark, rows), F.lit(DAY + dt.timedelta(days=1))).collect()
    assert {r.date.day: r.alarm_count for r in later} == {9: 5, 10: 7}


def test_history_problems(spark):
    seed = spark.createDataFrame([("c", dt.date(2024, 1, 6), 0)], "channel_id string, date date, alarm_count int")
    rows = [delivery(5, at(5, 21), "a"), delivery(8, at(8, 12), "a"), delivery(9, at(9, 21), "a"), delivery(9, at(9, 21), "b", 1)]
    found = V.history_problems(seed, batch_rows(spark, rows), ["channel_id", "date", "alarm_count"], F.lit(dt.date(2024, 1, 5)), F.lit(DAY))
    assert {(r.problem, r.day.day) for r in found.collect()} == {
        ("conflicting versions", 9), ("available before the day ended", 8), ("overlaps the bootstrap", 5),
        ("bootstrap after its end", 6), ("missing day", 6), ("missing day", 7), ("missing day", 10)}


def test_reconcile_counts_both_sides(spark):
    a = spark.createDataFrame([(1, 5), (2, None), (3, 1)], "k int, v int")
    b = spark.createDataFrame([(1, 7), (2, None), (4, 1)], "k int, v int")
    r = reconcile(a, b, ["k"], ["v"]).first()
    assert (r.mismatches, r.max_abs_difference, r.left_only, r.right_only, r.common) == (1, 2.0, 1, 1, 2)


def test_daily_cache_replaces_only_its_years(spark, tmp_path):
    path = str(tmp_path / "daily")
    schema = "channel_id string, date date, events_count int"
    daily.write_daily(spark.createDataFrame([("a", dt.date(2023, 5, 1), 1), ("a", dt.date(2024, 5, 1), 2)], schema), path)
    daily.write_daily(spark.createDataFrame([("b", dt.date(2024, 6, 1), 3)], schema), path)
    found = daily.read_daily(spark, path, "2023-01-01", "2024-12-31", ["events_count"])
    assert {(r.channel_id, r.events_count) for r in found.collect()} == {("a", 1), ("b", 3)}
    with pytest.raises(ValueError):
        daily.require_rows(daily.read_daily(spark, path, "2022-01-01", "2022-12-31", []), "2022")
