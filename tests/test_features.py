import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchgrid.operators import features as W
from watchgrid.operators import labels as L
from watchgrid.operators import objects as O

DAY0 = dt.date(2024, 1, 1)
COLUMNS = ("channel_id string, date date, events_count long, alarm_count long, fault_count long, no_power_count long, "
           "numeric_count long, value_sum double, value_sumsq double")


def history(n, seed=0, channels=("a", "b")):
    rng = random.Random(seed)
    rows = []
    for c in channels:
        for i in range(n):
            events = rng.choice([0, 0, 1, 3])
            alarms = rng.choice([0, events]) if events else 0
            rows.append((c, DAY0 + dt.timedelta(days=i), events, alarms, int(events == 3), 0, events, float(events * 2), float(events * 4)))
    return rows


@pytest.fixture(scope="module")
def grid(spark):
    return W.with_masks(spark.createDataFrame(history(200), COLUMNS)).cache()


def by_channel(df, *columns):
    rows = df.orderBy("channel_id", "date").collect()
    return {c: [tuple(r[x] for x in columns) for r in rows if r.channel_id == c] for c in {r.channel_id for r in rows}}


def masks(n=200, field=3):
    rows = history(n)
    return {c: [int(r[field] > 0) for r in rows if r[0] == c] for c in ("a", "b")}


def test_streaks_and_ages_stay_inside_a_channel(grid):
    got = by_channel(W.compute(grid, W.streak_family(), W.days_since_family()), "alarm_streak", "quiet_streak", "days_since_alarm")
    for c, alarm in masks().items():
        streak = quiet = 0
        age = -1
        for i, a in enumerate(alarm):
            streak, quiet = (streak + 1, 0) if a else (0, quiet + 1)
            age = 0 if a else (age + 1 if age >= 0 else -1)
            assert got[c][i] == (streak, quiet, age)


def test_ewm_recursion(grid):
    got = by_channel(W.ewm(grid), "alarm_ewm_7", "alarm_ewm_28")
    for c, alarm in masks().items():
        for j, span in enumerate((7, 28)):
            alpha, y = 2 / (span + 1), None
            for i, a in enumerate(alarm):
                y = a if y is None else alpha * a + (1 - alpha) * y
                assert got[c][i][j] == pytest.approx(y, abs=1e-12)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_context_memory_state_table(grid, order):
    """Each channel keeps a table of decayed outcomes per context."""
    got = by_channel(W.context_memory(grid, (order,)), f"pattern{order}_alarm", f"pattern{order}_observed", f"pattern{order}_support")
    observed = masks(field=2)
    decay = 0.5 ** (1 / 90)
    for c, alarm in masks().items():
        table, context = {}, (0,) * order
        base = np.zeros(3)
        for i, (a, o) in enumerate(zip(alarm, observed[c])):
            table = {k: v * decay for k, v in table.items()}
            if i >= order:
                table[context] = table.get(context, np.zeros(3)) + np.array([a, o, 1])
            base = base * decay + np.array([a, o, 1])
            context = (2 * a + o, *context[:-1])
            yes, seen, n = table.get(context, np.zeros(3))
            p, q = (base[0] + 0.1) / (base[2] + 10), (base[1] + 1) / (base[2] + 10)
            assert got[c][i] == pytest.approx(((yes + 10 * p) / (n + 10), (seen + 10 * q) / (n + 10), n), abs=1e-9)


def test_recurrence(grid):
    got = by_channel(W.recurrence(grid, "alarm"), "alarm_age", "alarm_last_gap", "alarm_gap_ema", "alarm_gap_cv")
    for c, alarm in masks().items():
        last, gaps, ema = None, [], None
        for i, a in enumerate(alarm):
            if a and last is not None:
                gaps.append(i - last)
                ema = gaps[-1] if ema is None else 0.3 * gaps[-1] + 0.7 * ema
            last = i if a else last
            age, gap, mean, cv = got[c][i]
            assert age == (None if last is None else i - last) and gap == (gaps[-1] if gaps else None)
            assert mean == (None if ema is None else pytest.approx(ema))
            assert cv == (pytest.approx(np.std(gaps) / (np.mean(gaps) + 1e-8), abs=1e-7) if len(gaps) > 1 else None)


def test_later_days_do_not_change_earlier_features(spark):
    rows = history(60, seed=5)
    changed = [r if (r[1] - DAY0).days < 40 else (*r[:2], r[2] * 2 + 3, r[3] * 2 + 3, *r[4:]) for r in rows]
    built = [W.channel_mart(W.with_masks(with_counters(spark.createDataFrame(x, COLUMNS)))) for x in (rows, changed)]
    early = [sorted(tuple(r) for r in df.where(F.col("date") < DAY0 + dt.timedelta(days=40)).collect()) for df in built]
    assert early[0] == early[1]


def with_counters(df):
    from watchgrid import vocab
    return df.withColumns({c: F.lit(0).cast("long") for c in vocab.ROLLING_COUNTERS if c not in df.columns})


def test_leave_one_out_excludes_itself(spark):
    rows = [("a", "o", DAY0, 1, 1), ("b", "o", DAY0, 0, 1), ("c", "o", DAY0, 1, 0), ("d", "p", DAY0, 1, 1)]
    df = spark.createDataFrame(rows, "channel_id string, object_id string, date date, alarm int, observed int")
    out = {r.channel_id: (r.x_alarm_others, r.x_alarm_rate) for r in
           W.leave_one_out(df, ["object_id", "date"], ["alarm"], "x", "observed").collect()}
    assert out == {"a": (1, 0.5), "b": (2, 1.0), "c": (1, 1 / 3), "d": (0, 0.0)}


def test_others_are_told_from_days_with_records(spark, monkeypatch):
    monkeypatch.setattr(W, "WIDE", 2)  # several tasks hand out the sums of a group
    rng = random.Random(7)
    days = [DAY0 + dt.timedelta(days=i) for i in range(6)]
    groups = {f"c{n}": (rng.choice(["o", "p", "q", None]), rng.choice(["s", "t"])) for n in range(12)} | {"silent": ("o", "s"), "alone": ("r", "s")}
    facts = {(c, d): (rng.randint(0, 1), 1) for c in groups for d in days if c not in ("silent", "alone") and rng.random() < 0.4}
    schema = "channel_id string, date date, object_id string, kind string, alarm int, observed int"
    sparse = spark.createDataFrame([(c, d, *groups[c], *x) for (c, d), x in facts.items()] + [(c, None, *g, None, None) for c, g in groups.items()], schema)
    levels = {"x": (["object_id", "kind"], ["alarm"], "observed"), "y": (["object_id"], ["alarm"], "observed"), "z": (["kind"], ["observed"], None)}
    got = [tuple(r) for r in W.others_in_groups(sparse, levels, F.lit(DAY0)).collect()]
    want = {}
    for c, (o, k) in groups.items():
        for d in days:
            def others(i, same):
                return sum(x[i] for (e, f), x in facts.items() if f == d and e != c and same(*groups[e]))
            x, y = (lambda p, q: (p, q) == (o, k)), (lambda p, q: p == o)
            a, b, n = others(0, x), others(0, y), others(1, lambda p, q: q == k)
            want[c, d] = (a, a / (1 + others(1, x)), b, b / (1 + others(1, y)), n)
    assert len({r[:2] for r in got}) == len(got) and {r[0] for r in got} == set(groups)
    assert all(r[2:] == want[r[:2]] for r in got)
    assert not any(any(v) for key, v in want.items() if key not in {r[:2] for r in got})


def mart(spark, text, observed=None, start=DAY0, object_id="o"):
    rows = [(object_id, start + dt.timedelta(days=i), int(ch), int((observed or "1" * len(text))[i])) for i, ch in enumerate(text)]
    return spark.createDataFrame(rows, "object_id string, date date, alarm_today int, observed_today int")


def test_onset_labels_are_exact_days(spark):
    out = L.label_onset(mart(spark, "0010110")).orderBy("date").collect()
    assert [r.onset_target for r in out] == [1, 0, 1, 0, 0, None, None]
    assert [r.alarm_target for r in out] == [1, 0, 1, 1, 0, None, None]
    assert [r.joint_target for r in out] == [1, 2, 1, 3, 2, None, None]


def test_episode_context_with_missing_days(spark):
    df = mart(spark, "0001101", "0111101").where(F.col("date") != DAY0 + dt.timedelta(days=5))
    out = {(r.date - DAY0).days: r for r in O.episode_labels(df, 2).collect()}
    assert out[0].context_known == 0 and out[0].episode_start is None and out[0].gap_record_coverage == "unknown_context"
    assert (out[3].episode_start, out[3].repeat_alarm, out[3].gap_record_coverage) == (1, 0, "records_every_gap_day")
    assert (out[4].episode_start, out[4].repeat_alarm) == (0, 1)
    assert out[6].episode_start is None        # the day before is missing
    assert out[2].gap_record_coverage == "records_some_gap_days"


@pytest.mark.parametrize("half_life", [45, 180])
def test_markov_two_steps(spark, half_life):
    rng = random.Random(7)
    state = [rng.randrange(3) for _ in range(120)]
    df = mart(spark, "".join("1" if s == 2 else "0" for s in state), "".join("0" if s == 0 else "1" for s in state))
    cut = F.lit(DAY0 + dt.timedelta(days=60))
    prior = O.markov_prior(df, cut)
    p = np.ones((3, 3))
    for a, b in zip(state[:60], state[1:61]):
        p[a, b] += 1
    p /= p.sum(axis=1, keepdims=True)
    got = [r[f"markov_{half_life}"] for r in O.markov_forecast(df, prior, half_life).orderBy("date").collect()]
    counts = np.zeros((3, 3))
    for i, s in enumerate(state):
        counts *= 2 ** (-1 / half_life)
        if i:
            counts[state[i - 1], s] += 1
        t = (counts + 5 * p) / (counts.sum(axis=1, keepdims=True) + 5)
        assert got[i] == pytest.approx((t @ t)[s, 2], abs=1e-10)


def test_seasonal_target_weekday(spark):
    rng = random.Random(8)
    alarm = [rng.randrange(2) for _ in range(90)]
    df = mart(spark, "".join(map(str, alarm)))
    prior = O.weekday_prior(df, F.lit(DAY0 + dt.timedelta(days=30)))
    rates = [r.rate for r in prior.orderBy("weekday").collect()]
    got = [r.seasonal_90 for r in O.seasonal_forecast(df, prior, 90).orderBy("date").collect()]
    n, pos = np.zeros(7), np.zeros(7)
    for i, a in enumerate(alarm):
        n *= 2 ** (-1 / 90)
        pos *= 2 ** (-1 / 90)
        w = i % 7                              # the first day is a Monday
        n[w] += 1
        pos[w] += a
        t = (w + 2) % 7
        assert got[i] == pytest.approx((pos[t] + 10 * rates[t]) / (n[t] + 10), abs=1e-10)


def test_sequence_windows_pad_and_mark_history(spark):
    df = mart(spark, "0110").withColumns({c: F.lit(1) for c in O.SEQUENCE_COUNTS})
    out = O.sequence_windows(df, O.fit_scaler(df, F.lit(DAY0 + dt.timedelta(days=9))), 3).orderBy("date").collect()
    first = out[0].sequence
    assert [v[-1] for v in first] == [0.0, 0.0, 1.0] and [v[0] for v in out[3].sequence] == [1.0, 1.0, 0.0]
    assert all(len(v) == 8 for v in first)
