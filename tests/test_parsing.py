import datetime as dt

import pytest

from watchgrid import vocab
from watchgrid.functions import parsing as P
from watchgrid.functions import scalars as S
from watchgrid.operators import aggregate as A
from watchgrid.sources import journal as J
from pyspark.sql import functions as F


def journal(spark, rows):
    return spark.createDataFrame(rows, J._text_schema(vocab.JOURNAL_COLUMNS))


def test_alarm_words(spark):
    words = [(" True ", "true"), ("ДА", "true"), ("истина", "true"), ("Нет", "false"), ("0", "false"),
             ("", "missing"), (None, "missing"), ("NaN", "missing"), ("\tfalse\n", "false"), ("unk", "invalid"), ("2", "invalid")]
    df = spark.createDataFrame([(w,) for w, _ in words], "w string").select("w", P.word_of("w").alias("x"))
    got = [r.s for r in df.select(P.alarm_status("x").alias("s")).collect()]
    assert got == [s for _, s in words]


@pytest.mark.parametrize("text,value", [
    ("1,5", 1.5), (" -7.25 ", -7.25), ("+3", 3.0), (".5", 0.5), ("5,", 5.0), ("1e3", 1000.0), ("-999", -999.0),
    ("1d", None), ("1f", None), ("inf", None), ("NaN", None), ("1_000", None), ("1 2", None), ("", None), (None, None)])
def test_numbers_are_strict(spark, text, value):
    df = spark.createDataFrame([(text,)], "s string").select(P.stripped("s").alias("t"))
    assert df.select(P.parse_value("t").alias("v")).first().v == value


@pytest.mark.parametrize("text,second", [
    ("00:00:00", 0), ("23:59:59", 86399), ("7:05:09", 25509), ("12:00:00.75", 43200), ("24:00:00", None),
    ("12:60:00", None), ("12:00:61", None), ("-1:00:00", None), ("noon", None), ("", None), (None, None)])
def test_second_of_day(spark, text, second):
    df = spark.createDataFrame([(text,)], "t string").select(P.time_digits("t").alias("d"))
    assert df.select(P.second_of_day("d").alias("s")).first().s == second


def test_clean_and_daily_reconcile(spark):
    rows = [("1", "c", "2024-01-01", "10:00:00", "true", "Неисправен"), ("2", "c", "2024-01-01", "10:00:01", "1", "1,5"),
            ("3", "c", "2024-01-01", "x", "unk", "NA"), ("4", "c", "2024-01-01", "10:00:02", "да", " -999 "),
            ("5", "c", "bad", "10:00:03", "0", "1"), ("6", None, "2024-01-01", "10:00:03", "0", "1"),
            ("7", "c", "2024-13-01", "10:00:03", "0", "1")]
    day = A.channel_daily(J.clean_journal(journal(spark, rows))).collect()
    assert len(day) == 1
    d = day[0].asDict()
    assert (d["events_count"], d["alarm_count"], d["numeric_count"], d["text_count"], d["missing_count"]) == (4, 3, 2, 1, 1)
    assert (d["fault_count"], d["negative_count"], d["sentinel_count"]) == (1, 1, 1)
    assert (d["value_sum"], d["value_min"], d["value_max"]) == (-997.5, -999.0, 1.5)
    bad = J.invalid_counters(journal(spark, rows)).first()
    assert (bad.input_rows, bad.invalid_date, bad.invalid_time, bad.invalid_alarm) == (7, 2, 1, 1)


def test_intraday_order_ties_and_midnight(spark):
    rows = [("9", "c", "2024-01-01", "18:00:00", "0", ""), ("10", "c", "2024-01-01", "18:00:00", "1", ""),
            ("x", "c", "2024-01-01", "00:00:00", "1", ""), ("1", "c", "2024-01-01", "00:00:00", "0", ""),
            ("2", "c", "2024-01-01", "17:59:59", "1", ""), ("3", "d", "2024-01-01", "00:00:00", "0", ""),
            ("4", "e", "2024-01-01", "bad", "1", "")]
    out = {r.channel_id: r for r in A.intraday_daily(J.clean_journal(journal(spark, rows))).collect()}
    assert set(out) == {"c", "d"}
    c = out["c"]
    assert (c.intra_alarm_count_last6h, c.intra_alarm_count_last12h, c.intra_events_last6h) == (1, 2, 2)
    assert c.intra_last_timestamp_ties == 1 and c.intra_last_event_is_alarm == 1   # id 10 after 9
    assert c.intra_first_event_is_alarm == 1                                       # no number: first
    assert c.intra_last_alarm_minute == 1080.0 and out["d"].intra_last_alarm_minute == -1.0


def test_combine_is_independent_of_the_split(spark):
    rows = [(str(i), f"c{i % 3}", f"2024-01-0{1 + i % 4}", "10:00:00", "1" if i % 5 == 0 else "0", str(i % 7)) for i in range(60)]
    clean = J.clean_journal(journal(spark, rows))
    whole = {tuple(r) for r in A.channel_daily(clean).collect()}
    cut = F.col("event_id").cast("int") < 23
    parts = A.channel_daily(clean.where(cut)).unionByName(A.channel_daily(clean.where(~cut)))
    merged = A.combine_daily(parts).select(A.channel_daily(clean).columns)
    assert {tuple(r) for r in merged.collect()} == whole


def test_ratio_and_std(spark):
    row = spark.range(1).select(
        S.ratio(F.lit(1), F.lit(0)).alias("a"), S.ratio(F.lit(1), F.lit(0), 0).alias("b"),
        S.population_std(F.lit(6.0), F.lit(12.0), F.lit(3)).alias("c"),
        S.population_std(F.lit(0.0), F.lit(0.0), F.lit(0)).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (None, 0.0, 0.0, None)


def test_weekday_starts_on_monday(spark):
    parts = S.calendar(F.col("d"))
    row = spark.createDataFrame([(dt.date(2024, 1, 1),)], "d date").select(
        parts["dayofweek"].alias("a"), parts["target_dayofweek"].alias("b")).first()
    assert (row.a, row.b) == (0, 2)


def test_short_rows_are_counted_and_skipped(spark, tmp_path):
    text = 'event_id,channel_id,date,time,alarm_raw,sensor_value\n1,c,2024-01-01,10:00:00,1,"2,5"\n2,c,2024-01-01\n3,c,2024-01-02,10:00:00,0,\n'
    (tmp_path / "journal-2024.csv").write_text(text, encoding="utf-8")
    rows = J.read_journal(spark, str(tmp_path)).collect()
    assert [r.event_id for r in rows] == ["1", "3"] and rows[0].file_year == 2024
    bad = J.malformed_rows(spark, str(tmp_path)).first()
    assert (bad.rows, bad.malformed_rows) == (3, 1)
