"""Channel-day cache: partitioned write, pruned read, rebuild decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid.operators.quality import expect_empty


def write_daily(daily: DataFrame, path: str) -> None:
    """Write channel-days by year; a rerun replaces only the years it holds.

    The commit protocol publishes files when the job ends, so readers never see
    half a year.  REBALANCE sizes the files at run time and splits a large year
    over many tasks; rows are sorted by channel inside a file for pruning.
    """
    rows = daily.withColumn("year", F.year("date"))
    (rows.hint("rebalance", F.col("year"))
     .sortWithinPartitions("year", "channel_id", "date")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("year").parquet(path))


def read_daily(spark: SparkSession, path: str, start: str, end: str, columns: list[str]) -> DataFrame:
    """Channel-days of [start, end]: prunes years, pushes the dates, reads few columns."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    return (spark.read.parquet(path)
            .where(F.col("year").between(int(start[:4]), int(end[:4])))
            .where(F.col("date").between(first, last))
            .select("channel_id", "date", *columns))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail early when a requested range holds nothing."""
    if df.isEmpty():
        raise ValueError(f"no rows for {what}")
    return df


def rows_by_key(table: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Requested rows in the requested order (``wanted``: pos + keys).

    Missing keys appear with ``found`` false; repeated keys are reported by
    ``repeated_keys``.
    """
    rows = wanted.join(table.withColumn("_hit", F.lit(True)), keys, "left")
    return rows.withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def rows_in_order(table: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Requested rows in order of ``pos``; a key that is asked for twice, missing or repeated in the table is an error."""
    expect_empty(repeated_keys(wanted, keys), "keys asked for twice")
    rows = rows_by_key(table, wanted, keys)
    expect_empty(rows.where("NOT found").select("pos", *keys), "missing keys")
    expect_empty(rows.groupBy("pos").agg(F.count("*").alias("rows")).where("rows > 1"), "repeated rows")
    return rows.drop("found").orderBy("pos")


def repeated_keys(wanted: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.groupBy(*keys).agg(F.count("*").alias("requests")).where("requests > 1")


def file_inventory(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Per file: name, size in bytes and number of rows."""
    rows = (spark.read.format(fmt).options(**options).load(path)
            .select(F.col("_metadata.file_name").alias("file_name"),
                    F.col("_metadata.file_size").alias("file_bytes")))
    return rows.groupBy("file_name", "file_bytes").agg(F.count("*").alias("rows"))


def source_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Identity of each source file from its metadata; contents are not read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("length").alias("file_bytes"),
        F.unix_micros("modificationTime").alias("modified"),
        F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"),
                           F.unix_micros("modificationTime").cast("string")), 256).alias("fingerprint"))


def day_fingerprints(clean: DataFrame) -> DataFrame:
    """date, fingerprint: order-independent identity of the records of each day, nulls included."""
    columns = [x for c in clean.columns for x in (F.col(c), F.col(c).isNull())]
    own = F.xxhash64(*columns)
    return clean.groupBy("date").agg(F.concat_ws(
        "|", F.count(F.lit(1)).cast("string"), F.sum(own.cast("decimal(38,0)")).cast("string"),
        F.bit_xor(own).cast("string")).alias("fingerprint"))


def refresh_days(clean: DataFrame, cached: DataFrame, manifest: DataFrame, build) -> DataFrame:
    """The cache brought up to the journal: days whose records changed are built again, days that are gone leave.

    ``manifest`` holds (date, fingerprint) of the cached days, ``build`` reduces records to rows with a
    date.  The result has a column ``rebuilt``.
    """
    prints = day_fingerprints(clean)
    fresh = prints.join(manifest.select("date", "fingerprint"), ["date", "fingerprint"], "left_semi").select("date")
    stale = prints.join(manifest.select("date", "fingerprint"), ["date", "fingerprint"], "left_anti").select("date")
    kept = cached.join(fresh, "date", "left_semi").withColumn("rebuilt", F.lit(0))
    return kept.unionByName(build(clean.join(stale, "date", "left_semi")).withColumn("rebuilt", F.lit(1)))


def needs_rebuild(sources: DataFrame, manifest: DataFrame, code_version: str) -> DataFrame:
    """Source files whose content, code or schema version differs from the manifest."""
    known = manifest.where(F.col("code_version") == code_version).select("file_name", "fingerprint")
    return sources.join(known, ["file_name", "fingerprint"], "left_anti")


def write_summary(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """One small report file.  Only for tables that are reports, not data."""
    writer = df.coalesce(1).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown report format {fmt}")
