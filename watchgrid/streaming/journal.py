"""Live journal: daily counters, within-day picture, late deliveries, alarm state."""

from __future__ import annotations

import datetime
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from watchgrid.operators.aggregate import channel_daily, combine_daily, combine_intraday, intraday_parts
from watchgrid.session import shared_folder
from watchgrid.sources.journal import clean_journal


def read_stream(spark: SparkSession, path: str, schema: StructType, pattern: str | None = None,
                files_per_batch: int | None = None) -> DataFrame:
    """Files of a folder as they arrive."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_to_end(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Process everything available into a table and read it.

    The file sink records committed files, so a restarted query neither loses
    nor repeats rows.  Running again with the same ``folder`` goes on from the
    last committed state.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, name)
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def keep_days(raw: DataFrame, folder: str, partial: Callable[[DataFrame], DataFrame], delay_days: int | None = None) -> None:
    """Process everything available; every channel-day is there at once and grows with its records.

    Each micro-batch adds its share of the days it touches under its own number, so a repeated batch
    replaces itself.  With ``delay_days``, records of days so far behind the newest day of earlier batches
    are not added, since those days are closed; they and records without a valid day go
    to a side table.  Running again with the same ``folder`` goes on from the last batch.
    """
    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        clean = clean_journal(batch).persist()
        closed = None
        if delay_days is not None:
            newest = progress(spark, folder).where(F.col("batch") < number).agg(F.max("newest")).first()[0]
            closed = None if newest is None else newest - datetime.timedelta(days=delay_days)
        late = F.lit(False) if closed is None else F.col("date") < F.lit(closed)
        reason = F.when(F.col("date").isNull(), "no valid day").when(late, "day closed")
        told = clean.withColumn("reason", reason)
        here = f"batch={number}"
        told.where("reason IS NOT NULL").write.mode("overwrite").parquet(f"{folder}/aside/{here}")
        partial(told.where("reason IS NULL").drop("reason")).write.mode("overwrite").parquet(f"{folder}/parts/{here}")
        counts = told.agg(F.count(F.lit(1)).alias("records"), F.count("reason").alias("aside"), F.max(F.when(F.col("reason").isNull(), F.col("date"))).alias("newest"))
        counts.write.mode("overwrite").parquet(f"{folder}/progress/{here}")
        clean.unpersist()

    query = (raw.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    query.awaitTermination()


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """records, aside and newest day of every batch so far."""
    try:
        return spark.read.schema("records long, aside long, newest date, batch long").parquet(f"{folder}/progress")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "records long, aside long, newest date, batch long")


def stream_channel_daily(raw: DataFrame, folder: str | None = None, delay_days: int | None = None) -> DataFrame:
    """Channel-day counters of all days so far, the same as in batch."""
    folder = folder or shared_folder(raw.sparkSession, "stream-daily")
    keep_days(raw, folder, channel_daily, delay_days)
    return combine_daily(raw.sparkSession.read.parquet(f"{folder}/parts"))


def stream_intraday(raw: DataFrame, folder: str | None = None, delay_days: int | None = None) -> DataFrame:
    """Within-day picture of all days so far, the same as in batch; what is kept is one row per batch and channel-day."""
    folder = folder or shared_folder(raw.sparkSession, "stream-intraday")
    keep_days(raw, folder, intraday_parts, delay_days)
    return combine_intraday(raw.sparkSession.read.parquet(f"{folder}/parts"))


def stream_batches(deliveries: DataFrame, folder: str | None = None) -> DataFrame:
    """Whole-day deliveries kept as versions; exact repeats count once.

    Every delivery is stored, however late, and none waits for a watermark: repeats go
    when the versions are read.  A correction is a new version with its own time of availability.
    Versions keep the name of their delivery, so that two different ones of the same instant remain a
    conflict.  Readers choose with ``versions.visible_batches``, so issued forecasts never change.
    """
    return run_to_end(deliveries, "versions", folder).dropDuplicates()


# --- alarm age and run length per channel ---------------------------------------------

NEVER = -(1 << 30)
ALARM_STATE = "channel_id string, date date, days_since_alarm int, alarm_streak int, kind string, version long"


def alarm_answers(days: np.ndarray, alarm: np.ndarray, base: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Days since the last alarm (-1: never) and alarm run of sorted days, after what ``base`` sums up of earlier days.

    ``base``: its last day, its last alarm day and the alarm run at its end.  Two stretches put together so
    answer as one, which makes the result the same for any split.
    """
    last_day, last_alarm, run = base
    last = np.maximum(np.maximum.accumulate(np.where(alarm, days, NEVER)), last_alarm)
    follows = np.zeros(len(days), dtype=bool)
    follows[1:] = alarm[:-1] & (np.diff(days) == 1)
    begins = np.where(alarm & ~follows, days, NEVER)
    if len(days) and alarm[0] and run and days[0] == last_day + 1:
        begins[0] = days[0] - run
    start = np.maximum.accumulate(begins)
    return np.where(last == NEVER, -1, days - last), np.where(alarm, days - start + 1, 0)


class AlarmState(StatefulProcessor):
    """One channel: the last ``keep`` days as they are, all earlier ones as three numbers.

    Days within ``keep`` of the newest may come late or again: they are answered, and earlier answers
    that change are sent once more with a higher version.  Older days are reported as late.  With
    ``idle_ms`` a channel that is silent so long keeps its three numbers only.
    """

    def __init__(self, keep: int, idle_ms: int | None = None):
        self.keep, self.idle_ms = keep, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("alarm", "days binary, alarms binary, last_day int, last_alarm int, run int, version long")

    def _load(self):
        if not self.state.exists():
            return np.zeros(0, np.int64), np.zeros(0, bool), (NEVER, NEVER, 0), 0
        days, alarms, last_day, last_alarm, run, version = self.state.get()
        return np.frombuffer(days, np.int64), np.frombuffer(alarms, bool), (last_day, last_alarm, run), version

    def _store(self, days, alarms, base, version) -> None:
        self.state.update((days.tobytes(), alarms.tobytes(), int(base[0]), int(base[1]), int(base[2]), int(version)))

    @staticmethod
    def _folded(days, alarms, base, upto: int):
        """Days up to ``upto`` become part of the three numbers."""
        n = int(np.searchsorted(days, upto, side="right"))
        if n:
            since, run = alarm_answers(days[:n], alarms[:n], base)
            last = int(days[n - 1])
            base = (last, NEVER if since[-1] < 0 else last - int(since[-1]), int(run[-1]))
        return days[n:], alarms[n:], base

    def handleInputRows(self, key, rows, timer_values):
        days, alarms, base, version = self._load()
        new = pd.concat(list(rows), ignore_index=True)
        day = np.array([d.toordinal() for d in new["date"]], dtype=np.int64)
        alarm = new["alarm"].to_numpy(dtype=bool)
        known = day > base[0]
        out = [(key[0], d, None, None, "late", version + 1) for d in new["date"][~known]]
        before = dict(zip(days.tolist(), zip(*(a.tolist() for a in alarm_answers(days, alarms, base)))))
        merged = dict(zip(days.tolist(), alarms.tolist()))
        merged.update(zip(day[known].tolist(), alarm[known].tolist()))  # a day that comes again is corrected
        days = np.array(sorted(merged), dtype=np.int64)
        alarms = np.array([merged[d] for d in days.tolist()], dtype=bool)
        if len(days):
            since, run = alarm_answers(days, alarms, base)
            for d, s, r in zip(days.tolist(), since.tolist(), run.tolist()):
                if before.get(d) != (s, r):
                    out.append((key[0], datetime.date.fromordinal(d), s, r, "patch" if d in before else "new", version + 1))
            days, alarms, base = self._folded(days, alarms, base, int(days[-1]) - self.keep)
        self._store(days, alarms, base, version + 1)
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["channel_id", "date", "days_since_alarm", "alarm_streak", "kind", "version"]).astype(
            {"days_since_alarm": "Int32", "alarm_streak": "Int32"})

    def handleExpiredTimer(self, key, timer_values, expired):
        days, alarms, base, version = self._load()
        if len(days):
            self._store(*self._folded(days, alarms, base, int(days[-1])), version)
        yield pd.DataFrame([], columns=["channel_id", "date", "days_since_alarm", "alarm_streak", "kind", "version"])

    def close(self) -> None:
        pass


def alarm_state(days: DataFrame, keep: int = 60, idle_days: int | None = None) -> DataFrame:
    """Answers of every channel as its days arrive, as a stream (``ALARM_STATE``).

    Days may come in any order and again within ``keep`` days of a channel's newest day.  ``idle_days`` sets
    timers for silent channels, for a query that runs on; one that ends with its input must do without,
    as a timer in the future would keep it running.
    """
    followed = days.select("channel_id", "date", (F.col("alarm_count") > 0).alias("alarm")).groupBy("channel_id")
    processor = AlarmState(keep, None if idle_days is None else idle_days * 86_400_000)
    return followed.transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=ALARM_STATE, outputMode="Append", timeMode="None" if idle_days is None else "ProcessingTime")


def newest_answers(told: DataFrame) -> DataFrame:
    """The newest answer of every channel-day; days that only came too late have none and kind late."""
    newest = F.max_by(F.struct("days_since_alarm", "alarm_streak", "kind", "version"), F.struct(F.col("kind") != "late", F.col("version")))
    return told.groupBy("channel_id", "date").agg(newest.alias("s")).select("channel_id", "date", "s.*")


def stream_alarm_state(days: DataFrame, folder: str | None = None, keep: int = 60) -> DataFrame:
    """Days since the last alarm and alarm run of every channel-day so far, after everything available."""
    conf, name = days.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    old = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the one for such state
    try:
        return newest_answers(run_to_end(alarm_state(days, keep), "alarm-state", folder))
    finally:
        conf.set(name, old)
