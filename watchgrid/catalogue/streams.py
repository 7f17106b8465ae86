"""Streaming jobs run to the end of their input, compared with the batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid import vocab
from watchgrid.catalogue.joins import BATCH_COLUMNS, batches
from watchgrid.catalogue.registry import query, rounded
from watchgrid.operators import versions
from watchgrid.session import shared_folder
from watchgrid.sources import testtables as T
from watchgrid.streaming import journal as S

def live_journal(spark, sf):
    """The journal in four files that arrive one after the other; every channel-day is dealt over all of them."""
    raw, inbox = T.journal(spark, sf), shared_folder(spark, "live")
    raw.repartition(4, F.xxhash64("event_id")).write.parquet(inbox)
    return S.read_stream(spark, inbox, raw.schema, files_per_batch=1)


@query("stream_channel_daily", f"""
SELECT channel_id, "date", {', '.join(vocab.DAILY_COUNTERS)}, round(value_sum, 6) AS value_sum, value_min, value_max FROM cd""")
def stream_channel_daily(spark, sf):
    return rounded(S.stream_channel_daily(live_journal(spark, sf)).drop("value_sumsq"))


@query("stream_intraday", """
SELECT channel_id, "date", intra_alarm_count_last6h, intra_alarm_count_last12h, intra_events_last6h, intra_last_timestamp_ties,
 round(intra_first_event_minute, 6) AS intra_first_event_minute, CAST(intra_first_event_is_alarm AS BIGINT) AS intra_first_event_is_alarm,
 round(intra_last_event_minute, 6) AS intra_last_event_minute, CAST(intra_last_event_is_alarm AS BIGINT) AS intra_last_event_is_alarm,
 round(intra_last_alarm_minute, 6) AS intra_last_alarm_minute FROM intra""")
def stream_intraday(spark, sf):
    return rounded(S.stream_intraday(live_journal(spark, sf)))


@query("stream_late_rows", """
SELECT kept, aside, kept + aside AS records FROM (SELECT count(*) FILTER (CAST("date" AS DATE) >= DATE '2024-01-20' OR CAST(event_id AS BIGINT) % 10 <> 0) AS kept,
 count(*) FILTER (CAST("date" AS DATE) < DATE '2024-01-20' AND CAST(event_id AS BIGINT) % 10 = 0) AS aside FROM journal)""")
def stream_late_rows(spark, sf):
    # A tenth of the records arrives after all others: what is older than ten days by then is set aside, the rest is added.
    raw, inbox, folder = T.journal(spark, sf), shared_folder(spark, "live"), shared_folder(spark, "late")
    tenth = F.col("event_id").cast("long") % 10 == 0
    for part in (raw.where(~tenth), raw.where(tenth)):  # all files of a part are one batch
        part.write.mode("append").parquet(inbox)
        days = S.stream_channel_daily(S.read_stream(spark, inbox, raw.schema), folder, delay_days=10)
    kept = days.agg(F.sum("events_count").alias("kept"))
    aside = S.progress(spark, folder).agg(F.sum("aside").alias("aside"), F.sum("records").alias("records"))
    return rounded(kept.crossJoin(aside))  # one row each


@query("stream_late_batches", """
SELECT channel_id, "date", events_count, alarm_count + CASE WHEN day("date") % 5 = 0 AND "date" < DATE '2024-01-20' THEN 3 ELSE 0 END AS alarm_count
FROM cd WHERE "date" > DATE '2024-01-03' AND "date" <= DATE '2024-01-20'""")
def stream_late_batches(spark, sf):
    inbox, folder = shared_folder(spark, "inbox"), shared_folder(spark, "versions")
    # The corrections arrive when all originals are there, up to a month behind the newest.
    delivered = batches(spark, sf)
    for part in (delivered.where("batch_id <> 'c'"), delivered.where("batch_id = 'c'")):
        part.write.mode("append").parquet(inbox)
        stored = S.stream_batches(S.read_stream(spark, inbox, delivered.schema), folder)
    return versions.visible_batches(stored, T.day("2024-01-20")).select(*BATCH_COLUMNS)


@query("stream_alarm_state", """
SELECT channel_id, "date", coalesce(i - max(CASE WHEN alarm = 1 THEN i END) OVER w, -1) AS days_since_alarm,
 CASE WHEN alarm = 1 THEN i - coalesce(max(CASE WHEN alarm = 0 THEN i END) OVER w, -1) ELSE 0 END AS alarm_streak
FROM g WINDOW w AS (PARTITION BY channel_id ORDER BY "date") QUALIFY observed = 1""")
def stream_alarm_state(spark, sf):
    """Three deliveries, each goes on from the state before; the last holds days far behind that change later answers."""
    inbox, folder = shared_folder(spark, "inbox"), shared_folder(spark, "alarm-state")
    days = T.channel_days(spark, sf).select("channel_id", "date", "alarm_count")
    early, late = F.col("date") <= T.day("2024-01-12"), F.dayofmonth("date") % 5 == 3
    for part in (days.where(early & ~late), days.where(~early), days.where(early & late)):
        part.write.mode("append").parquet(inbox)
        out = S.stream_alarm_state(S.read_stream(spark, inbox, days.schema), folder)
    return rounded(out.drop("kind", "version"))
