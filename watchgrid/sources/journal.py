"""Reading journals and turning raw text into typed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchgrid import vocab
from watchgrid.functions import parsing as P

CORRUPT = "_corrupt"


def _text_schema(columns: list[str], corrupt: bool = False) -> T.StructType:
    names = columns + ([CORRUPT] if corrupt else [])
    return T.StructType([T.StructField(c, T.StringType()) for c in names])


def _reader(spark: SparkSession, schema: T.StructType, header: bool):
    # Without column pruning a short row is seen as short whatever is selected.
    return (spark.read.schema(schema).option("header", header).option("encoding", "UTF-8")
            .option("enforceSchema", True).option("columnPruning", False))


def read_journal(spark: SparkSession, paths: str | list[str], headers: list[str] | None = None,
                 header: bool = True) -> DataFrame:
    """Yearly CSV journals, every column as text; short rows are skipped.

    ``headers`` lists the file's columns; exported headers are renamed.  The
    file's name and year come along for per-file reports.
    """
    headers = headers or vocab.JOURNAL_COLUMNS
    raw = _reader(spark, _text_schema(headers), header).option("mode", "DROPMALFORMED").csv(paths)
    named = raw.select("*", F.col("_metadata.file_name").alias("file_name"))
    return named.withColumnsRenamed(vocab.JOURNAL_HEADERS).withColumn(
        "file_year", F.regexp_extract("file_name", r"(\d{4})", 1).try_cast("int"))


def malformed_rows(spark: SparkSession, paths: str | list[str], headers: list[str] | None = None,
                   header: bool = True) -> DataFrame:
    """Per file: rows, and rows whose field count differs from the header."""
    headers = headers or vocab.JOURNAL_COLUMNS
    raw = (_reader(spark, _text_schema(headers, corrupt=True), header)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(paths))
    # A CSV scan may not read the corrupt marker alone, so the flag also touches a data column.
    bad = F.col(CORRUPT).isNotNull() | (F.length(headers[0]) < 0)
    return raw.groupBy(F.col("_metadata.file_name").alias("file_name")).agg(
        F.count("*").alias("rows"), F.count_if(bad).alias("malformed_rows"))


def _parsed(raw: DataFrame) -> DataFrame:
    """Date, time and stripped texts.

    Texts that several rules read are columns of their own step, so each is
    computed once per record.
    """
    texts = raw.select(
        "event_id", "channel_id", P.parse_date("date").alias("date"), P.time_digits("time").alias("_hms"),
        P.word_of("alarm_raw").alias("_word"), P.stripped("sensor_value").alias("value_text"))
    return texts.select("event_id", "channel_id", "date", P.second_of_day("_hms").alias("second"), "_word", "value_text")


def clean_journal(raw: DataFrame) -> DataFrame:
    """Typed records in one stage; rows without a date or channel go away."""
    valued = (_parsed(raw).where("date IS NOT NULL AND channel_id IS NOT NULL")
              .withColumn("value", P.parse_value("value_text")))
    return valued.select(
        "event_id", "channel_id", "date", "second", P.alarm_flag("_word").alias("is_alarm"),
        P.alarm_status("_word").alias("alarm_status"), "value_text", "value",
        P.value_kind("value_text", "value").alias("kind"))


def invalid_counters(raw: DataFrame) -> DataFrame:
    """How many records each parsing rule rejects or flags."""
    parsed = _parsed(raw).select("channel_id", "date", "second", F.expr("try_cast(event_id AS bigint)").alias("id"),
                                 P.alarm_status("_word").alias("status"))
    return parsed.selectExpr(
        "count(*) AS input_rows",
        "count_if(date IS NULL) AS invalid_date",
        "count_if(second IS NULL) AS invalid_time",
        "count_if(date IS NULL OR second IS NULL OR channel_id IS NULL) AS invalid_datetime_or_channel",
        "count_if(id IS NULL) AS invalid_event_id",
        "count_if(status = 'invalid') AS invalid_alarm",
        "count_if(status = 'missing') AS missing_alarm")
