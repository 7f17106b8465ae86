"""Modelling operators that run as Spark jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid.catalogue.channel_windows import frame, run
from watchgrid.catalogue.newton_sql import newton_sql, score_sql
from watchgrid.catalogue.registry import query, rounded
from watchgrid.operators import evaluation as E
from watchgrid.operators import features as W
from watchgrid.operators import labels as L
from watchgrid.operators import models as M
from watchgrid.operators import newton as N
from watchgrid.operators import objects as O
from watchgrid.session import materialize
from watchgrid.sources import testtables as T

NUMERIC = ["alarm_today", "observed_fraction", "historical_alarm_frequency", "alarm_streak", "days_since_alarm",
           "alarm_channels_mean7", "events_count_mean7", "observed_channels_lag1", "alarm_channels_lag7"]
CATEGORICAL = ["object_kind"]


def frames(spark, sf):
    """(train, tune, test) of the object design, written once before the fits."""
    mart = L.label_onset(O.with_signals(T.object_mart(spark, sf)))
    design = materialize(mart.select(
        "object_id", "date", "parent_id", *CATEGORICAL, *[F.round(F.col(c).cast("double"), 6).alias(c) for c in NUMERIC], "alarm_target", "onset_target", "quiet_intermediate",
        "joint_target"), "design")
    d = F.col("date")
    return (design.where(d <= T.day(T.TRAIN_END)), design.where(d.between(*[T.day(x) for x in T.TUNE])),
            design.where(d.between(*[T.day(x) for x in T.TEST])))


@query("baseline_scores", """
SELECT ol.object_id, ol."date", 1.0 AS always, CAST(alarm_today AS DOUBLE) AS persistence, round(coalesce(pos / n, 0), 6) AS frequency
FROM ol LEFT JOIN rates USING (object_id)""")
def baseline_scores(spark, sf):
    return rounded(M.baseline_scores(T.labelled(spark, sf), T.day(T.TRAIN_END)).select(
        "object_id", "date", "always", "persistence", "frequency"))


@query("fit_boosted")
def fit_boosted(spark, sf):
    train, tune, test = frames(spark, sf)
    share = train.agg(F.avg("alarm_target")).scalar()
    weighted = [df.withColumn("weight", F.when(F.col("alarm_target") == 1, 1 - share).otherwise(share)) for df in (train, tune)]
    model = M.fit_boosted(*weighted, NUMERIC, CATEGORICAL, "alarm_target", weight="weight", iterations=20)
    return M.score_boosted(model, test, NUMERIC, CATEGORICAL, "score").select("object_id", "date", "alarm_target", "score")


# The same design in SQL: exact medians, flags of the two lags that have gaps, unit scale, one column per kind.
_OBJ = 'OVER (PARTITION BY object_id ORDER BY "date"'
_FLAGGED = ["observed_channels_lag1", "alarm_channels_lag7"]
_KINDS = ["k0", "k1", "k2", "unknown"]
_X = [*[f"x_{c}" for c in [*NUMERIC, *[f"{c}_missing" for c in _FLAGGED]]], *[f"k_{k}" for k in _KINDS]]
_PLAIN = [f"coalesce({c}, m_{c}) AS x_{c}" for c in NUMERIC] + [f"CAST({c} IS NULL AS INT) AS x_{c}_missing" for c in _FLAGGED]
_SCALED = [x for x in _X if x[0] == "x"]
DESIGN_SQL = f"""feats AS (SELECT object_id, "date", object_kind, onset_target, alarm_target, CAST(a1 = 0 AS BIGINT) AS quiet, CAST(alarm_today AS DOUBLE) AS alarm_today,
  round(observed_channels / catalog_channels, 6) AS observed_fraction, round(sum(alarm_today) {_OBJ}) / (i + 1), 6) AS historical_alarm_frequency,
  CAST(CASE WHEN alarm_today = 1 THEN i - coalesce(max(CASE WHEN alarm_today = 0 THEN i END) {_OBJ}), -1) ELSE 0 END AS DOUBLE) AS alarm_streak,
  CAST(coalesce(i - max(CASE WHEN alarm_today = 1 THEN i END) {_OBJ}), -1) AS DOUBLE) AS days_since_alarm,
  round(avg(alarm_channels) {_OBJ} ROWS 6 PRECEDING), 6) AS alarm_channels_mean7, round(avg(events_count) {_OBJ} ROWS 6 PRECEDING), 6) AS events_count_mean7,
  CAST(lag(observed_channels, 1) {_OBJ}) AS DOUBLE) AS observed_channels_lag1, CAST(lag(alarm_channels, 7) {_OBJ}) AS DOUBLE) AS alarm_channels_lag7
 FROM (SELECT ol.*, coalesce(o.object_kind, 'unknown') AS object_kind FROM ol LEFT JOIN objects o ON o.object_id = ol.object_id)),
 medians AS (SELECT {', '.join(f'median({c}) AS m_{c}' for c in NUMERIC)} FROM feats WHERE "date" <= DATE '2024-01-15'),
 plain AS (SELECT object_id, "date", onset_target, alarm_target, quiet, {', '.join(_PLAIN)}, {', '.join(f"CAST(object_kind = '{k}' AS DOUBLE) AS k_{k}" for k in _KINDS)} FROM feats, medians),
 moments AS (SELECT {', '.join(f'avg({x}) AS a_{x}, stddev_pop({x}) AS s_{x}' for x in _SCALED)} FROM plain WHERE "date" <= DATE '2024-01-15'),
 designed AS MATERIALIZED (SELECT object_id, "date", onset_target, alarm_target, quiet, {', '.join(f'({x} - a_{x}) / CASE WHEN s_{x} > 1e-12 THEN s_{x} ELSE 1 END AS {x}' for x in _SCALED)},
  {', '.join(f'k_{k}' for k in _KINDS)} FROM plain, moments),
 learned AS MATERIALIZED (SELECT l.label AS label, l.y AS y, {', '.join(_X)} FROM (SELECT *, unnest([{{'label': 'onset', 'y': onset_target}}, {{'label': 'alarm', 'y': alarm_target}},
  {{'label': 'quiet', 'y': quiet}}, {{'label': 'alarm_if_quiet', 'y': CASE WHEN quiet = 1 THEN alarm_target END}}]) AS l FROM designed WHERE "date" <= DATE '2024-01-15') WHERE l.y IS NOT NULL)"""
_P = score_sql(_X)


def _scores_sql(label: str) -> str:
    return f"SELECT object_id, \"date\", {_P} AS p FROM designed, (SELECT * FROM fit WHERE label = '{label}') WHERE \"date\" BETWEEN DATE '2024-01-25' AND DATE '2024-01-28'"


def _fit_sql(labels: list[str]) -> str:
    some = ", ".join(f"'{x}'" for x in labels)
    return (f"{DESIGN_SQL}, picked AS MATERIALIZED (SELECT * FROM learned WHERE label IN ({some})),\n"
            + newton_sql("fit", "picked", "label", _X, "y", steps=11))


def fitted(spark, sf, labels):
    """(design, training rows, fits, scored test days) of logistic regressions on the named labels."""
    of = {"onset": F.col("onset_target"), "alarm": F.col("alarm_target"), "quiet": F.col("quiet_intermediate"),
          "alarm_if_quiet": F.when(F.col("quiet_intermediate") == 1, F.col("alarm_target"))}
    train, _, test = frames(spark, sf)
    standard = N.Standard(train, NUMERIC, CATEGORICAL)
    train = standard.apply(train)
    fits = N.fit_labels(train, standard.columns, {n: of[n] for n in labels})
    return standard, train, fits, N.score_labels(standard.apply(test), fits, standard.columns, labels)


@query("fit_logistic", f"""
WITH {_fit_sql(['onset'])}
SELECT object_id, "date", onset_target, round(p, 6) AS score FROM ({_scores_sql('onset')}) JOIN designed USING (object_id, "date")""")
def fit_logistic(spark, sf):
    scored = fitted(spark, sf, ["onset"])[-1]
    return rounded(scored.select("object_id", "date", "onset_target", F.col("p_onset").alias("score")))


@query("fit_certificate", f"""
WITH {_fit_sql(['alarm'])}
SELECT feature, round(coefficient, 6) AS coefficient, CAST(1 AS BIGINT) AS stationary FROM (SELECT {', '.join(f'b{i} AS "{n}"' for i, n in enumerate(
    ["intercept", *NUMERIC, *[f"{c}_missing" for c in _FLAGGED], *[f"object_kind={k}" for k in _KINDS]]))} FROM fit) UNPIVOT (coefficient FOR feature IN (COLUMNS(*)))""")
def fit_certificate(spark, sf):
    # Coefficients with their penalised gradient, added up anew from the scored rows.
    standard, train, fits, _ = fitted(spark, sf, ["alarm"])
    out = N.certificate(train, fits, standard.columns, standard.names, "alarm", F.col("alarm_target"))
    return rounded(out.select("feature", "coefficient", (F.abs("gradient") < 1e-6).alias("stationary")))


def _spline_sql(c: str) -> str:
    """Quadratic B-splines from divided differences of truncated powers."""
    parts = []
    for i in range(1, 5):
        t = [f"t{j}" for j in range(i, i + 4)]
        terms = []
        for a in t:
            denominator = " * ".join(f"({b} - {a})" for b in t if b != a)
            terms.append(f"pow(greatest({a} - x, 0), 2) / ({denominator})")
        # (t[i+3] - t[i]) times the divided difference of (t - x)^2_+ is the basis.
        parts.append(f"round(({t[3]} - {t[0]}) * -1 * ({' + '.join(terms)}), 6) + 0.0 AS {c}_s{i}")
    return ", ".join(parts)


@query("spline_basis", f"""
SELECT channel_id, "date", {_spline_sql('value_sum')} FROM (
 SELECT cd.channel_id, cd."date", greatest(k[1], least(k[4], value_sum)) AS x, k[1] - 2 * (k[2] - k[1]) AS t0, k[1] - (k[2] - k[1]) AS t1,
  k[1] AS t2, k[2] AS t3, k[3] AS t4, k[4] AS t5, k[4] + (k[4] - k[3]) AS t6, k[4] + 2 * (k[4] - k[3]) AS t7
 FROM (SELECT channel_id, "date", round(value_sum, 4) AS value_sum FROM cd) cd
 CROSS JOIN (SELECT quantile_cont(round(value_sum, 4), [0.0, 0.3333333333333333, 0.6666666666666666, 1.0]) AS k FROM cd))""")
def spline_basis(spark, sf):
    rows = materialize(T.channel_days(spark, sf).select("channel_id", "date", F.round("value_sum", 4).alias("value_sum")), "rows")
    out = M.spline_basis(rows, M.spline_knots(rows, ["value_sum"]), ["value_sum"])
    return rounded(out.drop("value_sum"))


@query("rare_category_map", " UNION ALL ".join(f"""
SELECT * FROM (SELECT '{c}' AS column_name, coalesce({c}, '<MISSING>') AS value, count(*) AS n,
 row_number() OVER (ORDER BY count(*) DESC, coalesce({c}, '<MISSING>')) AS code
 FROM cd LEFT JOIN chan_cat k USING (channel_id) GROUP BY 2) WHERE code <= 20""" for c in ("object_id", "engineering_system", "parent_id")))
def rare_category_map(spark, sf):
    rows = T.channel_days(spark, sf).select("channel_id", "date").join(T.catalog(spark, sf), "channel_id", "left")
    return rounded(M.rare_category_map(rows, ["object_id", "engineering_system", "parent_id"], 20))


@query("encode_categories", """
WITH m AS (SELECT channel_id, row_number() OVER (ORDER BY count(*) DESC, channel_id) AS code FROM cd WHERE "date" <= DATE '2024-01-15' GROUP BY 1)
SELECT cd.channel_id, cd."date", CASE WHEN code <= 50 THEN code ELSE 0 END AS channel_id_code FROM cd LEFT JOIN m USING (channel_id)""")
def encode_categories(spark, sf):
    rows = T.channel_days(spark, sf).select("channel_id", "date")
    mapping = M.rare_category_map(rows.where(F.col("date") <= T.day(T.TRAIN_END)), ["channel_id"], 50)
    return rounded(M.encode_categories(rows, mapping, ["channel_id"]))


@query("hurdle_score", f"""
WITH {_fit_sql(['quiet', 'alarm_if_quiet'])}
SELECT object_id, "date", onset_target, round(q.p, 6) AS p_quiet, round(a.p, 6) AS p_alarm, round(q.p * a.p, 6) AS score
FROM ({_scores_sql('quiet')}) q JOIN ({_scores_sql('alarm_if_quiet')}) a USING (object_id, "date") JOIN designed USING (object_id, "date")""")
def hurdle_score(spark, sf):
    # P(quiet D+1) times P(alarm D+2 given quiet D+1): two regressions in one fit.
    scored = fitted(spark, sf, ["quiet", "alarm_if_quiet"])[-1].withColumnRenamed("p_alarm_if_quiet", "p_alarm")
    return rounded(scored.select("object_id", "date", "onset_target", "p_quiet", "p_alarm", (F.col("p_quiet") * F.col("p_alarm")).alias("score")))


@query("joint_score")
def joint_score(spark, sf):
    train, _, test = frames(spark, sf)
    return M.joint(train, test, NUMERIC).select("object_id", "date", "score")


@query("blend_scores", """
SELECT object_id, "date", round(0.25 * persistence + 0.75 * frequency, 6) AS quarter, round(persistence / 3 + frequency / 3 + smoothed / 3, 6) AS thirds,
 round(persistence * smoothed, 6) AS product FROM wide_scores""")
def blend_scores(spark, sf):
    wide = T.wide_scores(spark, sf)
    out = M.blend(wide, {"persistence": 0.25, "frequency": 0.75}, "quarter")
    out = M.blend(out, {m: 1 / 3 for m in ("persistence", "frequency", "smoothed")}, "thirds")
    return rounded(M.product(out, ["persistence", "smoothed"], "product").select("object_id", "date", "quarter", "thirds", "product"))


# Specialists of the engineering systems on tomorrow's alarm; positives that make a system eligible in tables of this size.
ELIGIBLE = 22
EXPERT = ["alarm", "observed", "fault", "no_power", "volume"]


@query("expert_routing", f"""
WITH e AS (SELECT channel_id, "date", alarm, observed, fault, no_power, round(ln(1 + events_count), 6) AS volume,
  CASE WHEN object_id <> 'Нет в справочнике' THEN engineering_system END AS sys, lead(alarm) OVER (PARTITION BY channel_id ORDER BY "date") AS target FROM gc),
 t AS MATERIALIZED (SELECT * REPLACE (coalesce(sys, '?') AS sys) FROM e WHERE target IS NOT NULL AND "date" <= DATE '2024-01-15'),
 tagged AS MATERIALIZED (SELECT * FROM t WHERE sys <> '?' UNION ALL SELECT * REPLACE ('*' AS sys) FROM t),
 {newton_sql('fit', 'tagged', 'sys', EXPERT, 'target')}
SELECT channel_id, "date", CAST(own.sys IS NOT NULL AS BIGINT) AS specialist,
 round(CASE WHEN own.sys IS NOT NULL THEN {score_sql(EXPERT, 'own.')} ELSE {score_sql(EXPERT, 'every.')} END, 6) AS routed
FROM e LEFT JOIN (SELECT * FROM fit WHERE positives >= {ELIGIBLE} AND n > positives AND sys <> '*') own ON own.sys = e.sys
CROSS JOIN (SELECT * FROM fit WHERE sys = '*') every""")
def expert_routing(spark, sf):
    rows = L.label_lead(T.grid(spark, sf), "channel_id", F.col("alarm"), 1).withColumn("volume", F.round(F.log1p("events_count"), 6))
    rows = rows.join(T.channels(spark, sf).select("channel_id", "engineering_system"), "channel_id", "left")
    rows = materialize(rows.select("channel_id", "date", "engineering_system", "target", *EXPERT), "expert-rows")
    out = N.specialists(rows, F.col("date") <= T.day(T.TRAIN_END), "engineering_system", EXPERT, "target", ELIGIBLE, name="routed")
    return rounded(out.select("channel_id", "date", "specialist", "routed"))


@query("select_model", """
WITH m AS (SELECT model, "date" >= DATE '2024-01-25' AS later, count(*) FILTER (r <= 10 AND alarm_target = 1) / count(*) FILTER (r <= 10) AS precision FROM (
  SELECT *, row_number() OVER (PARTITION BY model, "date" ORDER BY score DESC, object_id) AS r FROM scores
  WHERE "date" BETWEEN DATE '2024-01-18' AND DATE '2024-01-22' OR "date" BETWEEN DATE '2024-01-25' AND DATE '2024-01-28') GROUP BY ALL),
 c AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY model ORDER BY score DESC) AS pred, sum(pos) OVER (PARTITION BY model) AS p
  FROM (SELECT model, score, sum(alarm_target) AS pos, count(*) AS n FROM scores WHERE "date" BETWEEN DATE '2024-01-18' AND DATE '2024-01-22' GROUP BY ALL)),
 a AS (SELECT model, sum(pos / p * tp / pred) AS average_precision FROM c GROUP BY model),
 j AS (SELECT model, round(m.precision, 6) AS precision, round(average_precision, 6) AS average_precision FROM m JOIN a USING (model) WHERE NOT later),
 p AS (SELECT *, row_number() OVER (ORDER BY precision DESC, average_precision DESC, model) AS place FROM j),
 l AS (SELECT model, round(precision, 6) AS later_precision FROM m WHERE later)
SELECT *, CAST(place = 1 AS BIGINT) AS selected, CAST(later_precision >= (SELECT later_precision FROM l WHERE model = 'persistence') AS BIGINT) AS passes_gate FROM p JOIN l USING (model)""")
def select_model(spark, sf):
    rows = T.scores(spark, sf)
    tune, later = (rows.where(F.col("date").between(*[T.day(d) for d in days])) for days in (T.TUNE, T.TEST))
    ap = E.average_precision(E.pr_curve(tune, ["model"], "alarm_target"), ["model"])
    best = E.budget_metrics(tune, ["model"], "alarm_target", (10,)).select("model", "precision")
    after = E.budget_metrics(later, ["model"], "alarm_target", (10,)).select("model", "precision")
    return rounded(M.select_model(rounded(best.join(ap, "model")), rounded(after), "persistence"))


@query("score_batch", f"""
WITH {_fit_sql(['alarm'])}
SELECT object_id, "date", round(p, 6) AS score, CAST(p >= 0.3 AS BIGINT) AS warning FROM ({_scores_sql('alarm')})""")
def score_batch(spark, sf):
    scored = fitted(spark, sf, ["alarm"])[-1].withColumnRenamed("p_alarm", "score")
    return rounded(M.score_batch(materialize(scored, "scored"), ["object_id", "date"], 0.3))


MONTHLY = ["alarm", "alarm_trend_7_28", "events_trend_1_7", "seq_alarm_rate_14d", "seq_alarm_rate_60d"]


# A refit before every month of the long history, on labels complete two days before.
@query("rolling_refit", f"""
WITH r AS (SELECT channel_id, "date", alarm, {run('lead(alarm, 1)')} AS target,
  round({frame('sum(alarm)', 7)} / least(i + 1, 7) - {frame('sum(alarm)', 28)} / least(i + 1, 28), 6) AS alarm_trend_7_28,
  round(events_count / (1 + {frame('sum(events_count)', 7)} / 7), 6) AS events_trend_1_7,
  round({frame('sum(alarm)', 14)} / least(i + 1, 14), 6) AS seq_alarm_rate_14d,
  round({frame('sum(alarm)', 60)} / least(i + 1, 60), 6) AS seq_alarm_rate_60d FROM lg),
 months AS (SELECT CAST(unnest(generate_series(date_trunc('month', min("date")) + INTERVAL 1 MONTH, max("date"), INTERVAL 1 MONTH)) AS DATE) AS period FROM lg),
 known AS MATERIALIZED (SELECT period, r.* FROM months JOIN r ON r."date" <= period - 2 WHERE target IS NOT NULL),
 {newton_sql('fit', 'known', 'period', MONTHLY, 'target', steps=12)}
SELECT period, CAST(period - 2 AS DATE) AS train_end, channel_id, "date", target, round({score_sql(MONTHLY)}, 6) AS score
FROM r JOIN fit ON period = CAST(date_trunc('month', "date") AS DATE)""")
def rolling_refit(spark, sf):
    rows = W.compute(T.long_grid(spark, sf), W.trend_family(), W.window_rate_family((14, 60)))
    labelled = L.label_lead(rows, "channel_id", F.col("alarm"), 1)
    rows = materialize(labelled.select("channel_id", "date", "target", *[F.round(c, 6).alias(c) for c in MONTHLY]), "design")
    first, last = rows.agg(F.date_add(F.last_day(F.min("date")), 1), F.max("date")).first()
    starts = [r[0] for r in spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("INTERVAL 1 MONTH")))).collect()]
    return rounded(N.refit_scores(rows, starts, MONTHLY, "target").select("period", "train_end", "channel_id", "date", "target", "score"))


@query("permutation_importance")
def permutation_importance(spark, sf):
    train, tune, test = frames(spark, sf)
    model = M.fit_logistic(train, NUMERIC, [], "alarm_target")
    rows = materialize(tune.unionByName(test).where("alarm_target IS NOT NULL"), "rows")
    return M.permutation_importance(rows, lambda df: M.score_logistic(model, df, NUMERIC, [], "score"),
                                    NUMERIC, ["object_id", "date"], "alarm_target")
