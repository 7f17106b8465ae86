import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from watchgrid.operators import bootstrap as B
from watchgrid.operators import drift as D
from watchgrid.operators import evaluation as E
from watchgrid.operators import models as M
from watchgrid.operators import ranking as R
from watchgrid.plans.running import ranked

DAY0 = dt.date(2024, 1, 1)


def sample(n=600, levels=12, seed=4):
    rng = random.Random(seed)
    return [("m", f"o{i % 40}", DAY0 + dt.timedelta(days=i // 40), rng.randrange(2), rng.randrange(levels) / levels) for i in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(sample(), "model string, object_id string, date date, alarm_target int, score double").withColumn(
        "onset_target", F.col("alarm_target")).cache()


def brute_ap(pairs, weight=lambda d: 1):
    positives = sum(weight(d) * y for d, y, _ in pairs)
    total = 0.0
    for s in sorted({s for _, _, s in pairs}, reverse=True):
        taken = [(d, y) for d, y, x in pairs if x >= s]
        here = sum(weight(d) * y for d, y, x in pairs if x == s)
        warned = sum(weight(d) for d, _ in taken)
        if warned:
            total += here / positives * sum(weight(d) * y for d, y in taken) / warned
    return total


def test_average_precision_and_auc_with_ties(rows):
    steps = E.pr_curve(rows, ["model"], "alarm_target")
    data = [(r[2], r[3], r[4]) for r in sample()]
    assert E.average_precision(steps, ["model"]).first().average_precision == pytest.approx(brute_ap(data))
    pos, neg = [s for _, y, s in data if y], [s for _, y, s in data if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert E.roc_auc(steps, ["model"]).first().roc_auc == pytest.approx(auc)


def test_weighted_ap(rows, spark):
    counts = B.daily_score_counts(rows, "alarm_target")
    weights = counts.select("date").distinct().withColumn("weight", F.dayofmonth("date") % 3)
    data = [(r[2], r[3], r[4]) for r in sample()]
    want = brute_ap(data, lambda d: d.day % 3)
    assert B.weighted_ap(counts, weights, ["model"]).first().average_precision == pytest.approx(want)


def test_topk_breaks_ties_by_text(spark):
    df = spark.createDataFrame([("m", i, DAY0, 0.5, 0, 0) for i in ("10", "2", "1")],
                               "model string, object_id string, date date, score double, alarm_target int, onset_target int")
    assert {r.object_id for r in E.daily_rank(df, ["model"], 2).collect()} == {"1", "10"}
    queue = R.rank_queue(df.drop("model"), 2).orderBy("rank").collect()
    assert [(r.object_id, r.rank, r.warning) for r in queue] == [("1", 1, 1), ("10", 2, 1), ("2", 3, 0)]


def test_best_threshold_prefers_the_lowest(spark):
    data = [("m", 0.9, 1), ("m", 0.5, 0), ("m", 0.1, 1), ("m", 0.4, 0)]
    df = spark.createDataFrame(data, "model string, score double, y int")
    best = E.best_threshold(E.pr_curve(df, ["model"], "y"), ["model"]).first()
    assert (best.threshold, best.f1) == (0.1, pytest.approx(2 / 3))


def test_warning_partition_adds_up(rows):
    r = E.warning_partition(rows.withColumn("onset_target", (F.col("alarm_target") == 1) & (F.col("score") > 0.5)).withColumn(
        "onset_target", F.col("onset_target").cast("int")), ["model"], 5).first()
    assert r.warnings == r.onset + r.repeat_alarm + r.no_alarm == 5 * r.days


def test_identical_models_have_a_zero_interval(rows):
    both = rows.unionByName(rows.withColumn("model", F.lit("copy")))
    row = B.week_bootstrap(B.weekly_sums(both, ("m", "copy"), 5), 50, 84).first()
    assert (row.precision_low, row.precision_high, row.precision_difference) == (0.0, 0.0, 0.0) and row.few_weeks == 1
    drawn = B.block_bootstrap(B.daily_score_counts(both, "alarm_target"), "m", 20, 7, 139).first()
    assert (drawn.lower, drawn.upper, drawn.draws) == (0.0, 0.0, 20)


def test_one_week_has_no_interval(rows):
    week = rows.where((F.date_add("date", 1) >= F.lit(dt.date(2024, 1, 8))) & (F.date_add("date", 1) <= F.lit(dt.date(2024, 1, 14))))
    both = week.unionByName(week.withColumn("model", F.lit("copy")))
    row = B.week_bootstrap(B.weekly_sums(both, ("m", "copy"), 5), 20, 1).first()
    assert row.weeks == 1 and row.precision_low is None


def test_block_weights_cover_every_draw(rows):
    weights = [r.weights for r in B.block_weights(rows.select("date").distinct(), 10, 7, 5).collect()]
    assert [sum(w) for w in zip(*weights)] == [15.0] * 10


def test_stratified_sample_is_stable_and_capped(rows):
    first = R.stratified_sample(rows, "alarm_target", ["object_id", "date"], 100, 0.45, 84)
    again = R.stratified_sample(rows.repartition(3, "score"), "alarm_target", ["object_id", "date"], 100, 0.45, 84)
    key = lambda df: sorted((r.object_id, r.date) for r in df.collect())
    assert key(first) == key(again)
    assert {r.alarm_target: r["count"] for r in first.groupBy("alarm_target").count().collect()} == {0: 55, 1: 45}
    assert R.inverse_weights(first).agg(F.avg("weight")).first()[0] == pytest.approx(1)


@pytest.mark.parametrize("cap", [1, 7, 100, 700, 100_000])
def test_stratified_sample_ranks_the_edge_only(spark, monkeypatch, cap):
    rows = spark.createDataFrame([(i, i % 3 % 2 if i % 11 else None) for i in range(900)], "id long, target int")
    ranked_rows = []
    monkeypatch.setattr(R, "ranked", lambda df, *a, **k: ranked_rows.append(df.count()) or ranked(df, *a, **k))
    got = R.stratified_sample(rows, "target", ["id"], cap, 0.45, 84).collect()
    order = lambda label: sorted((hashlib.md5(f"84|{i}".encode()).hexdigest(), i) for i in range(900) if i % 11 and i % 3 % 2 == label)
    p, n = order(1), order(0)
    kp = min(len(p), max(1, int(cap * 0.45)))
    kn = min(len(n), cap - kp)
    want = [(i, 1, len(p), kp) for _, i in p[:kp]] + [(i, 0, len(n), kn) for _, i in n[:kn]]
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(ranked_rows) < 10


def test_permuted_positions_are_ranks_of_the_hash(spark):
    base = spark.range(1, 701).select(F.col("id").alias("_position"), (F.col("id") * 7).alias("k"), F.lit(0.5).alias("x"))
    copies = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(r).alias("repeat")) for f in "xy" for r in range(2)])
    out = M.shuffled_positions(base, copies, ["k"], 3)
    assert out.columns == ["feature", "repeat", "_position", "_from"]  # no features move
    hashed = base.withColumn("c", F.explode(copies)).select(
        "c.feature", "c.repeat", "_position", F.xxhash64(F.lit(3), F.col("c.feature"), F.col("c.repeat"), "k").alias("h")).collect()
    want = set()
    for copy in {(r.feature, r["repeat"]) for r in hashed}:
        order = sorted((r.h, r._position) for r in hashed if (r.feature, r["repeat"]) == copy)
        want |= {(*copy, p, n) for n, (_, p) in enumerate(order, 1)}
    assert {tuple(r) for r in out.collect()} == want


def test_psi_is_zero_for_equal_splits_and_null_without_spread(spark):
    values = [(s, float(i % 20), 1.0) for s in ("train", "valid", "test") for i in range(200)]
    df = spark.createDataFrame(values, "split string, a double, b double")
    out = {(r.feature, r.split): r.psi for r in D.psi(df, ["a", "b"]).collect()}
    assert out[("a", "valid")] == pytest.approx(0, abs=1e-12) and out[("b", "test")] is None
    assert {r.ks for r in D.ks(df, ["a"]).collect()} == {0.0}


def test_blend_weights_are_checked(spark):
    df = spark.createDataFrame([(0.2, 0.6)], "a double, b double")
    assert M.blend(df, {"a": 0.5, "b": 0.5}, "x").first().x == pytest.approx(0.4)
    with pytest.raises(ValueError):
        M.blend(df, {"a": 0.5, "b": 0.6}, "x")


def test_rare_categories_fall_to_zero(spark):
    train = spark.createDataFrame([(c,) for c in "aaabbc"] + [(None,)], "k string")
    mapping = M.rare_category_map(train, ["k"], 2)
    out = M.encode_categories(spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "k string"), mapping, ["k"])
    assert {r.k: r.k_code for r in out.collect()} == {"a": 1, "b": 2, "c": 0, "z": 0}


def test_logistic_separates_and_keeps_unknown_categories(spark):
    rows = [(float(i % 10), None if i % 7 == 0 else float(i), "u" if i % 2 else "v", int(i % 10 > 4)) for i in range(120)]
    df = spark.createDataFrame(rows, "x double, z double, k string, y int")
    model = M.fit_logistic(df, ["x", "z"], ["k"], "y")
    new = spark.createDataFrame([(9.0, None, "new", 1), (0.0, 1.0, "u", 0)], "x double, z double, k string, y int")
    high, low = [r.p for r in M.score_logistic(model, new, ["x", "z"], ["k"], "p").collect()]
    assert high > 0.8 > 0.2 > low


def test_short_days_and_improper_histories_are_refused(spark, rows):
    E.expect_full_days(rows, ["model"], 2)
    with pytest.raises(ValueError):
        E.expect_full_days(rows, ["model"], 10_000)
    from watchgrid.operators import objects as O

    good = [("a", dt.date(2024, 1, 1), 1, 1), ("a", dt.date(2024, 1, 2), 0, 0)]
    schema = "object_id string, date date, alarm_today int, observed_today int"
    assert O.checked_history(spark.createDataFrame(good, schema)).count() == 2
    for bad in (good[0], ("b", good[0][1], 1, 0), ("b", good[0][1], 2, 2), ("b", good[0][1], None, 1), (None, good[0][1], 0, 1)):
        with pytest.raises(ValueError):
            O.checked_history(spark.createDataFrame([*good, bad], schema))


def test_rows_in_order_refuses_gaps_and_repeats(spark):
    from watchgrid.sources import daily

    table = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    asked = spark.createDataFrame([(2, "a"), (1, "c")], "pos int, k string")
    assert [(r.pos, r.v) for r in daily.rows_in_order(table, asked, ["k"]).collect()] == [(1, 3), (2, 1)]
    for more in ([(3, "a")], [(3, "z")]):
        with pytest.raises(ValueError):
            daily.rows_in_order(table, asked.union(spark.createDataFrame(more, asked.schema)), ["k"])
    with pytest.raises(ValueError):
        daily.rows_in_order(table.union(table), asked, ["k"])
