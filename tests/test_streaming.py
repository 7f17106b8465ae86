import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import check_oracles
from watchgrid.operators import aggregate as A
from watchgrid.session import shared_folder
from watchgrid.sources import testtables as T
from watchgrid.sources.journal import clean_journal
from watchgrid.streaming import journal as S


def same(one, two):
    return one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_many_small_files_give_the_batch_result(spark, sf, tmp_path):
    inbox, folder = str(tmp_path / "inbox"), str(tmp_path / "days")
    raw = T.journal(spark, sf)
    parts = raw.randomSplit([1.0] * 3, 7)
    for part in parts:  # every day is dealt over all files, and every run goes on from the last
        part.coalesce(1).write.mode("append").parquet(inbox)
        stream = S.read_stream(spark, inbox, raw.schema, files_per_batch=1)
        days = S.stream_channel_daily(stream, folder)
    batch = A.channel_daily(clean_journal(raw))
    exact = [c for c in batch.columns if not c.startswith("value_sum")]
    assert same(days.select(exact), batch.select(exact))
    sums = days.agg(F.round(F.sum("value_sum"), 6)).first()[0]
    assert sums == batch.agg(F.round(F.sum("value_sum"), 6)).first()[0]
    intraday = S.stream_intraday(S.read_stream(spark, inbox, raw.schema, files_per_batch=1))
    whole = A.intraday_daily(clean_journal(raw))
    assert same(intraday.select(whole.columns), whole)
    assert S.progress(spark, folder).agg(F.sum("records")).first()[0] == raw.count()


def test_a_repeated_batch_counts_once_and_closed_days_stay(spark, sf):
    raw, folder, inbox = T.journal(spark, sf), shared_folder(spark, "t-late"), shared_folder(spark, "t-inbox")
    late = (F.col("date") < "2024-01-10") & (F.col("event_id").cast("long") % 3 == 0)
    for part in (raw.where(~late), raw.where(late)):
        part.coalesce(1).write.mode("append").parquet(inbox)
        days = S.stream_channel_daily(S.read_stream(spark, inbox, raw.schema), folder, delay_days=5)
    kept = A.channel_daily(clean_journal(raw.where(~late)))
    assert same(days.select("channel_id", "date", "events_count"), kept.select("channel_id", "date", "events_count"))
    aside = spark.read.parquet(f"{folder}/aside")
    assert aside.count() == raw.where(late).count() and {r.reason for r in aside.select("reason").distinct().collect()} == {"day closed"}
    assert S.progress(spark, folder).agg(F.sum("records"), F.sum("aside")).first()[0] == raw.count()


class Handle:
    """State of one channel in memory."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, t):
        self.timers.discard(t)

    def registerTimer(self, t):
        self.timers.add(t)

    def getCurrentProcessingTimeInMs(self):
        return 1000


def plain(days):
    """Days since the last alarm and run of every day, walked through one by one."""
    out, last, run, before = {}, None, 0, None
    for d in sorted(days):
        if days[d]:
            run = run + 1 if before is not None and d - before == dt.timedelta(1) and days[before] else 1
            last = d
        else:
            run = 0
        out[d] = (-1 if last is None else (d - last).days, run)
        before = d
    return out


@pytest.mark.parametrize("seed", range(12))
def test_any_split_and_order_of_days_answers_as_one(seed):
    rng = random.Random(seed)
    start = dt.date(2024, 1, 1)
    days = {start + dt.timedelta(i): rng.random() < 0.5 for i in range(60) if rng.random() < 0.8}
    order = sorted(days, key=lambda d: (d - start).days + rng.randint(0, 12))  # at most twelve days late
    handle, processor, answers = Handle(), S.AlarmState(keep=20, idle_ms=5 if seed % 2 else None), {}
    processor.init(handle)
    while order:
        n = rng.randint(1, 9)
        part, order = order[:n], order[n:]
        frame = pd.DataFrame({"channel_id": "c", "date": part, "alarm": [days[d] for d in part]})
        for out in processor.handleInputRows(("c",), iter([frame]), handle):
            for r in out.itertuples():
                assert r.kind in ("new", "patch") and (r.kind == "patch") == (r.date in answers)
                answers[r.date] = (r.days_since_alarm, r.alarm_streak)
    assert answers == plain(days)
    assert len(handle.value[0]) <= 21 * 8  # the rest is three numbers
    if seed % 2:
        assert handle.timers == {1005}
        list(processor.handleExpiredTimer(("c",), handle, None))
        assert handle.value[0] == b""
        after = max(days) + dt.timedelta(1)
        frame = pd.DataFrame({"channel_id": "c", "date": [after, min(days)], "alarm": [True, True]})
        out = {r.kind: r for r in next(iter(processor.handleInputRows(("c",), iter([frame]), handle))).itertuples()}
        assert (out["new"].days_since_alarm, out["new"].alarm_streak) == plain({**days, after: True})[after]
        assert out["late"].date == min(days) and pd.isna(out["late"].alarm_streak)


@pytest.mark.parametrize("name", ["stream_intraday", "stream_late_batches", "stream_late_rows", "stream_alarm_state"])
def test_streams_match_their_oracle(spark, sf, name):
    ok, text = check_oracles.compare(spark, check_oracles.connect(sf), name, sf)
    assert ok, text


def test_late_rows_are_written_by_all_tasks(spark, sf, tmp_path, monkeypatch):
    from watchgrid.catalogue import streams

    raw = T.journal(spark, sf).repartition(3).localCheckpoint()
    monkeypatch.setattr(T, "journal", lambda *_: raw)
    monkeypatch.setattr(streams, "shared_folder", lambda _, name: str(tmp_path / name))
    got = streams.stream_late_rows(spark, sf).first()
    assert got.records == raw.count() and got.kept + got.aside == got.records and got.aside > 0
    assert len(list((tmp_path / "live").glob("*.parquet"))) == 6
    assert len(list((tmp_path / "late" / "progress").glob("batch=*"))) == 2
