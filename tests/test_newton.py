"""Many regressions at once against one at a time."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchgrid import vocab
from watchgrid.operators import labels as L
from watchgrid.operators import models as M
from watchgrid.operators import newton as N
from watchgrid.operators import objects as O
from watchgrid.session import materialize
from watchgrid.sources import testtables as T


def alone(x, y, penalty=1.0):
    """Penalised logistic regression by gradient steps with backtracking, then Newton; independent of the library."""
    x = np.column_stack([np.ones(len(x)), np.nan_to_num(np.asarray(x, float))])
    shrink = np.r_[0, np.full(x.shape[1] - 1, penalty)]
    beta = np.zeros(x.shape[1])

    def objective(b):
        z = x @ b
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * shrink @ b**2

    for _ in range(200):
        p = 1 / (1 + np.exp(-(x @ beta)))
        g = x.T @ (p - y) + shrink * beta
        d = np.linalg.lstsq(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(shrink), g, rcond=None)[0]
        rate = 1.0
        while objective(beta - rate * d) > objective(beta) and rate > 1e-6:
            rate /= 2
        beta = beta - rate * d
        if np.abs(g).max() < 1e-11 * len(x):
            break
    return beta


def made(seed=1, n=3000):
    rng = np.random.default_rng(seed)
    group = np.where(rng.random(n) < 0.4, "hot", np.char.add("g", rng.integers(0, 30, n).astype(str)))
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2]
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ [1.0, -0.4, 2.0] - 1)))).astype(int)
    day = dt.date(2020, 1, 1)
    return [(str(g), *map(float, r), int(v), day + dt.timedelta(int(d))) for g, r, v, d in zip(group, x, y, rng.integers(0, 200, n))]


SCHEMA = "sys string, a double, b double, c double, y int, date date"


def test_groups_equal_single_fits(spark):
    rows = made()
    rows += [("none", 1.0, 2.0, 0.0, 0, rows[0][-1])] * 5 + [(None, 1.0, 2.0, 0.0, 1, rows[0][-1]), ("gap", None, 3.0, 1.0, 1, rows[0][-1]), ("gap", 1.0, 3.0, 1.0, None, rows[0][-1])]
    rows += [("apart", float(i), 0.0, 0.0, int(i > 0), rows[0][-1]) for i in (-3, -2, 2, 3)]  # perfectly separable
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {r.sys: r for r in N.fit_groups(df, "sys", ["a", "b", "c"], "y", penalty=2.0).collect()}
    assert set(got) == {r[0] for r in rows if r[0]}
    for name, r in got.items():
        own = [x for x in rows if x[0] == name and x[4] is not None]
        want = alone([[0.0 if v is None else v for v in x[1:4]] for x in own], np.array([x[4] for x in own]), 2.0)
        assert r.n == len(own) and r.positives == sum(x[4] for x in own)
        if 0 < r.positives < r.n:
            assert np.allclose(r.coefficients, want, atol=1e-6) and r.gradient < 1e-6 and r.steps < 20
        else:
            assert r.coefficients is None and r.gradient is None
    assert N.fit_groups(df.where("1 = 0"), "sys", ["a"], "y").collect() == []


def test_specialists_fall_back(spark):
    rows = made(2)
    df = spark.createDataFrame(rows + [("new", 0.1, 0.2, 0.3, None, rows[0][-1]), (None, 0.1, 0.2, 0.3, None, rows[0][-1])], SCHEMA)
    out = N.specialists(df, F.col("date") < F.lit(dt.date(2020, 5, 1)), "sys", ["a", "b", "c"], "y", positives=200).collect()
    train = [r for r in rows if r[-1] < dt.date(2020, 5, 1)]
    fit = {None: train, "hot": [r for r in train if r[0] == "hot"]}
    beta = {k: alone([r[1:4] for r in v], np.array([r[4] for r in v])) for k, v in fit.items()}
    assert len(out) == len(rows) + 2 and {r.sys for r in out if r.specialist} == {"hot"}
    for r in out:
        b = beta["hot" if r.sys == "hot" else None]
        assert r.score == pytest.approx(1 / (1 + np.exp(-(b[0] + b[1:] @ [r.a, r.b, r.c]))), abs=1e-7)


def test_periods_equal_separate_refits(spark):
    rows = made(3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    starts = [dt.date(2020, 1, 1), dt.date(2020, 1, 2), dt.date(2020, 1, 15), dt.date(2020, 3, 1), dt.date(2020, 7, 1), dt.date(2020, 9, 1)]
    fits = {r.period: r for r in N.fit_periods(df, starts, ["a", "b", "c"], "y").collect()}
    assert set(fits) == set(starts[2:])  # nothing is known two days before the first two
    for start, r in fits.items():
        own = [x for x in rows if x[-1] <= start - dt.timedelta(2)]
        assert r.n == len(own)
        assert np.allclose(r.coefficients, alone([x[1:4] for x in own], np.array([x[4] for x in own])), atol=1e-6)
    # Later rows change nothing.
    changed = df.withColumn("y", F.when(F.col("date") > F.lit(dt.date(2020, 2, 28)), 1 - F.col("y")).otherwise(F.col("y")))
    again = {r.period: r.coefficients for r in N.fit_periods(changed, starts, ["a", "b", "c"], "y").collect()}
    assert np.allclose(again[starts[3]], fits[starts[3]].coefficients, atol=1e-12) and not np.allclose(again[starts[4]], fits[starts[4]].coefficients)
    scored = N.refit_scores(df, starts, ["a", "b", "c"], "y")
    assert scored.count() == sum(x[-1] >= starts[2] for x in rows)
    assert scored.where("train_end <> date_sub(period, 2) OR date < period").isEmpty()


def test_full_object_design_and_its_certificate(spark, sf):
    """All object features with their flags, and kind, parent and object as categories."""
    mart = materialize(L.label_onset(O.with_signals(T.object_mart(spark, sf))), "full-mart")
    numeric = [c for c in mart.columns if c not in ("object_id", "date", "object_kind", "parent_id") and not c.endswith(("_target", "_intermediate"))]
    assert len([c for c in numeric if c not in vocab.MODEL_COUNTERS]) >= 50
    train = mart.where(F.col("date") <= T.day(T.TRAIN_END))
    standard = N.Standard(train, numeric, ["object_kind", "parent_id", "object_id"])
    ready = materialize(standard.apply(train), "full-design")
    fits = materialize(N.fit_labels(ready, standard.columns, {"alarm": F.col("alarm_target"), "onset": F.col("onset_target")}), "full-fits")
    known = ready.where("alarm_target IS NOT NULL").toPandas()
    for c, name in zip(standard.columns, standard.names):
        if "=" not in name:
            values = ready.select(F.avg(c), F.stddev_pop(c)).first()
            assert abs(values[0]) < 1e-9 and (abs(values[1] - 1) < 1e-9 or values[1] < 1e-9), name
    got = {r.label: r for r in fits.collect()}
    want = alone(known[standard.columns].to_numpy(), known["alarm_target"].to_numpy())
    assert np.allclose(got["alarm"].coefficients, want, atol=1e-5)
    rows = N.certificate(ready, fits, standard.columns, standard.names, "alarm", F.col("alarm_target")).collect()
    assert [r.feature for r in rows] == ["intercept", *standard.names] and max(abs(r.gradient) for r in rows) < 1e-6
    unseen = mart.limit(3).withColumn("object_kind", F.lit("never seen"))
    assert N.score_labels(standard.apply(unseen), fits, standard.columns, ["alarm"]).where("p_alarm BETWEEN 0 AND 1").count() == 3


def test_improper_scores_are_refused(spark):
    good = spark.createDataFrame([(1, 0.2), (2, 0.9)], "id int, score double")
    assert [r.warning for r in M.score_batch(good, ["id"], 0.5).orderBy("id").collect()] == [0, 1]
    for bad in ([(1, None)], [(1, float("nan"))], [(1, 1.5)], [(1, -0.1)], [(1, 0.2), (1, 0.2)]):
        with pytest.raises(ValueError):
            M.score_batch(spark.createDataFrame(bad, "id int, score double"), ["id"], 0.5)


def test_boosted_trees_with_very_many_categories(spark):
    rng = np.random.default_rng(5)
    kinds = np.r_[np.repeat(["hot", "cold"], 1500), [f"k{i}" for i in range(2000)]]
    rows = [(str(k), float(rng.normal()), int(rng.random() < (0.8 if k == "hot" else 0.2)), i % 3) for i, k in enumerate(kinds)]
    df = spark.createDataFrame(rows, "kind string, x double, y int, part int")
    model = M.fit_boosted(df.where("part < 2").drop("part"), df.where("part = 2").drop("part"), ["x"], ["kind"], "y", iterations=5, most=40)
    asked = spark.createDataFrame([("hot", 0.0, 0), ("cold", 0.0, 0), ("k7", 0.0, 0), ("never seen", 0.0, 0)], "kind string, x double, y int")
    got = {r.kind: r.score for r in M.score_boosted(model, asked, ["x"], ["kind"], "score").collect()}
    assert got["hot"] > 0.5 > got["cold"] and got["never seen"] < 0.5


def test_equal_rows_are_counted_before_the_steps(spark, monkeypatch):
    rows = [("s" if i % 3 else None, float(i % 2), float(i % 5 == 0), i % 7 % 2, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "sys string, a double, b double, y int, i int")
    read, fit = [], N.fit_groups
    monkeypatch.setattr(N, "fit_groups", lambda tagged, *a, **k: read.append(tagged.count()) or fit(tagged, *a, **k))
    out = N.specialists(df, F.col("i") < 1900, "sys", ["a", "b"], "y", positives=10)
    plain = {r.g: r for r in fit(df.where("i < 1900").withColumn("g", F.explode(F.array(F.coalesce("sys", F.lit("?")), F.lit("*")))), "g", ["a", "b"], "y").collect()}
    assert read[0] <= 3 * 2 * 2 * 2 and out.count() == len(rows)
    for r in out.collect():
        b = plain["s" if r.sys else "*"].coefficients
        assert r.score == pytest.approx(1 / (1 + np.exp(-(b[0] + b[1] * r.a + b[2] * r.b))), abs=1e-9)
    counted = df.where("i < 1900").groupBy("sys", "a", "b", "y").agg(F.count("*").alias("c"))
    r = fit(counted, "sys", ["a", "b"], "y", copies="c").first()
    assert (r.n, r.positives) == (plain["s"].n, plain["s"].positives)
