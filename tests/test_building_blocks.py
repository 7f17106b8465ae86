import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchgrid.plans import decay, running
from watchgrid.plans.calendar_fill import fill_calendar

DAY0 = dt.date(2000, 1, 1)


def days(n):
    return [DAY0 + dt.timedelta(days=i) for i in range(n)]


def test_fill_calendar(spark):
    facts = spark.createDataFrame(
        [("a", DAY0, 2, 1.5), ("a", DAY0 + dt.timedelta(days=3), 1, None), ("b", DAY0 + dt.timedelta(days=4), 7, 2.0)],
        "k string, date date, n int, v double")
    seeds = spark.createDataFrame([("a",), ("c",)], "k string")
    out = fill_calendar(facts, seeds, "k", F.lit(DAY0), F.lit(DAY0 + dt.timedelta(days=4)), ["n"]).orderBy("k", "date").collect()
    assert [(r.k, r.date) for r in out] == [(k, d) for k in "abc" for d in days(5)]
    assert [r.n for r in out] == [2, 0, 0, 1, 0, 0, 0, 0, 0, 7, 0, 0, 0, 0, 0]
    assert [r.v for r in out][:5] == [1.5, None, None, None, None]


@pytest.mark.parametrize("ratio", [0.75, 27 / 29])
def test_decayed_sums_beyond_one_block(spark, ratio):
    rng = random.Random(1)
    n = 4000
    x = [rng.random() if i < 2500 else 0.0 for i in range(n)]
    df = spark.createDataFrame([("e", d, i, v) for i, (d, v) in enumerate(zip(days(n), x))], "k string, date date, i int, x double")
    got = [r.y for r in decay.with_decayed_sums(df, "k", "date", "i", {"y": (F.col("x"), ratio)}).orderBy("i").collect()]
    want, state = [], 0.0
    for v in x:
        state = state * ratio + v
        want.append(state)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-15)


def test_fast_decay_needs_blocks():
    with pytest.raises(ValueError):
        decay.decayed_sum(F.lit, 0.75, None, None)


def test_running_totals_with_one_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.randrange(40), i, rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, score int, id int, x int")
    out = running.running_totals(df, ["g"], [-F.col("score"), F.col("id")], {"t": F.col("x"), "r": F.lit(1)}, ranges=8).collect()
    assert len(out) == len(rows)
    want = {}
    for g in {r[0] for r in rows}:
        total = 0
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            total += r[3]
            want[r[2]] = (total, n)
    assert {r.id: (r.t, r.r) for r in out} == want


def test_running_totals_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("a", 1, 5)], "g string, o int, x int")
    out = {(r.g, r.o): r.t for r in running.running_totals(df, ["g"], [F.col("o")], {"t": F.col("x")}).collect()}
    assert out == {(None, 1): 2, (None, 2): 5, ("a", 1): 5}


def test_exact_quantiles_match_numpy(spark):
    rng = random.Random(3)
    values = {g: [rng.randrange(30) / 4 for _ in range(n)] for g, n in (("a", 1), ("b", 17), ("c", 500))}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double")
    counts = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    out = running.exact_quantiles(counts, ["g"], "v", "n", probs).collect()
    assert len(out) == len(values) * len(probs)
    for r in out:
        assert r.quantile == pytest.approx(np.quantile(values[r.g], r.prob), abs=1e-12)
    for r in running.nearest_rank(counts, ["g"], "v", "n", probs).collect():
        ordered = sorted(values[r.g])
        assert r.quantile == ordered[max(int(np.ceil(r.prob * len(ordered))), 1) - 1]
