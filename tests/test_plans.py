"""Physical plans: shuffles, pushdown and the absence of cross products."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entrypoint
from watchgrid.operators import features as W
from watchgrid.operators import joins as J
from watchgrid.sources import daily
from watchgrid.sources import testtables as T
from watchgrid.plans import running


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return len(re.findall(r"Exchange (?:hash|range|single)", plan(df)))


def test_channel_mart_needs_one_exchange_after_the_daily_aggregation(spark, sf):
    assert shuffles(T.channel_days(spark, sf)) == 1
    grid = J.densify(T.channel_days(spark, sf), T.channels(spark, sf), *[T.day(d) for d in T.CALENDAR])
    mart = W.channel_mart(W.with_masks(grid))
    # One for channel-days, one for the distinct dictionary channels, one by channel for all windows.
    assert shuffles(mart) <= 3


def test_memories_add_no_exchange(spark, sf):
    grid = T.grid(spark, sf)
    before = shuffles(grid)
    out = W.recurrence(W.context_memory(grid), "alarm")
    assert shuffles(out) == before


def test_daily_range_is_pruned_and_pushed_down(spark, sf, tmp_path):
    path = str(tmp_path / "daily")
    daily.write_daily(T.channel_days(spark, sf), path)
    text = plan(daily.read_daily(spark, path, "2024-01-05", "2024-01-09", ["events_count"]))
    assert re.search(r"PartitionFilters: \[.*year", text) and re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(date", text)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"channel_id", "date", "events_count"}


def test_others_move_no_empty_days_and_read_the_journal_once(spark, sf):
    text = plan(entrypoint.queries()["others_in_group"](spark, sf))
    above, _, _ = text.partition("Generate explode(")
    assert "Exchange" not in above and "Join" not in above
    assert text.count("events.parquet") <= 1


def test_topk_cuts_before_the_shuffle(spark, sf):
    text = plan(entrypoint.queries()["daily_topk"](spark, sf))
    assert "WindowGroupLimit" in text


LAZY = ["channel_daily", "intraday_daily", "calendar_grid", "object_features", "onset_features", "join_catalog", "reconcile_tables",
        "others_in_group", "asof_versions", "smoothed_frequency", "review_queue", "pr_curve", "weighted_ap", "psi", "rank_queue"]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_products(spark, sf, name):
    text = plan(entrypoint.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_rows_are_not_compared_with_all_bounds(spark):
    rows = spark.range(500).select("id", (F.col("id") % 3).alias("g"), (F.xxhash64("id") % 50).alias("x"))
    out = running.ranked(rows, ["g"], [F.col("x"), F.col("id")])
    # The coarse bounds are picked from all bounds in the subquery, whose plan is drawn behind colons.
    each_row = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "filter(" in line and "scalar-subquery" not in line]
    assert each_row and not any(f"% {running._STEP}" in line for line in each_row if ": " not in line.split("filter(")[0])
    want = {}
    for g in range(3):
        for n, r in enumerate(sorted((r.x, r.id) for r in rows.collect() if r.g == g)):
            want[r[1]] = n + 1
    assert {r.id: r["rank"] for r in out.collect()} == want


def test_memories_sort_once_for_each_context(spark, sf):
    grid = T.grid(spark, sf).select("channel_id", "date", "i", "alarm", "observed")
    added = plan(W.context_memory(grid)).count("Sort [") - plan(grid).count("Sort [")
    # By each of the three contexts, and by day again.
    assert added <= 4
