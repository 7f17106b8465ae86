"""Draws that two engines compute alike."""

import duckdb
from pyspark.sql import functions as F

from watchgrid.functions import draws
from watchgrid.operators import bootstrap as B


def python(seed, *counters):
    def mixed(x):
        for _ in range(2):
            x = ((x ^ x >> 16) * draws.MULTIPLIER) & draws.MASK
        return x ^ x >> 16

    h = mixed(seed & draws.MASK)
    for c in counters:
        h = mixed(h ^ c)
    return h


def test_both_engines_draw_alike(spark):
    counters = [(i, j) for i in (0, 1, 7, 99_999, draws.MASK) for j in (0, 3, 2**31, draws.MASK)]
    df = spark.createDataFrame(counters, "a long, b long")
    got = {(r.a, r.b): r.u for r in df.select("a", "b", draws.uniform(84, F.col("a"), F.col("b")).alias("u")).collect()}
    con = duckdb.connect()
    for a, b in counters:
        sql = con.execute(f"SELECT {draws.uniform_sql(84, 'a', 'b')} FROM (SELECT {a}::BIGINT AS a, {b}::BIGINT AS b)").fetchone()[0]
        assert got[a, b] == sql == python(84, a, b)


def test_draws_are_even(spark):
    rows = spark.range(20_000).select(draws.below(5, F.lit(10), F.col("id")).alias("x")).groupBy("x").count().collect()
    assert sorted(r.x for r in rows) == list(range(10)) and all(1800 < r["count"] < 2200 for r in rows)
    pairs = spark.range(100_000).select(draws.uniform(5, F.col("id")).alias("u")).distinct().count()
    assert pairs > 99_980  # a bijection of the counter under one seed would give all


def test_weights_are_blocks_of_days(spark):
    days = spark.sql("SELECT explode(sequence(date'2024-01-01', date'2024-01-13')) AS date")
    weights = {r.date: list(r.weights) for r in B.block_weights(days, 30, 5, 3).collect()}
    order = sorted(weights)
    for draw in range(30):
        want = [0] * 13
        for spot in range(13):
            want[(python(3, draw, spot // 5) % 13 + spot % 5) % 13] += 1
        assert [weights[d][draw] for d in order] == want
