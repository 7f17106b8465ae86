"""Many logistic regressions at once, by Newton steps over sums that tasks make in part.

One step is one aggregation: every task adds up the loss, its gradient and its second derivatives for all
regressions that its rows belong to, Spark adds up the tasks, and each regression moves by its own
small linear system.  Rows are never gathered by regression, so one with a third of all rows is no
bottleneck.  The penalty is ``penalty / 2`` times the squared coefficients without the intercept, added to the
summed loss, so each solution is the only one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchgrid.plans.running import exact_quantiles
from watchgrid.session import materialize

#: A fit is done when no part of its penalised gradient exceeds this share of its weight.
TOLERANCE = 1e-10
STEPS = 50
#: Regressions whose sums a task holds before it passes them on.
HELD = 2000


def design(rows: DataFrame, features: list[str], label: str, *keep: str, weight: str | None = None,
           copies: str | None = None) -> DataFrame:
    """``keep``, _x (1 and the features), _y and _w of the rows with a label; unknown features count as 0.

    With ``copies`` a row stands for so many equal ones, _n.
    """
    count = F.col(copies).cast("long") if copies else F.lit(1).cast("long")
    x = F.array(F.lit(1.0), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    return rows.where(F.col(label).isNotNull()).select(
        *keep, x.alias("_x"), F.col(label).cast("double").alias("_y"), ((F.col(weight).cast("double") if weight else F.lit(1.0)) * count).alias("_w"), count.alias("_n"))


def losses(x: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, residual and curvature of each row under each row of ``beta``."""
    z = x @ beta.T
    p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
    loss = np.logaddexp(0.0, z) - y[:, None] * z
    return loss * w[:, None], (p - y[:, None]) * w[:, None], p * (1.0 - p) * w[:, None]


def products(x: np.ndarray) -> np.ndarray:
    """Products of every two of a row's values, each pair once."""
    i, j = np.triu_indices(x.shape[1])
    return x[:, i] * x[:, j]


def step(beta: np.ndarray, before: np.ndarray, least: float, sums: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, float, float, bool]:
    """Next coefficients, the best so far, its objective, the gradient's largest part, and whether the fit is done.

    ``sums``: loss, weight, gradient, second derivatives.  A step that made the objective larger is halved.
    """
    size = len(beta)
    shrink = penalty * np.r_[0.0, np.ones(size - 1)]
    objective = sums[0] + 0.5 * float(shrink @ beta**2)
    gradient = sums[2:2 + size] + shrink * beta
    worst = float(np.abs(gradient).max())
    if not objective <= least + 1e-9 * max(1.0, abs(least)):
        return (beta + before) / 2, before, least, worst, bool(np.abs(beta - before).max() < 1e-12)
    if worst <= TOLERANCE * max(1.0, sums[1]):
        return beta, beta, objective, worst, True
    curve = np.zeros((size, size))
    curve[np.triu_indices(size)] = sums[2 + size:]
    curve = curve + np.triu(curve, 1).T + np.diag(shrink + 1e-12)
    return beta - np.linalg.solve(curve, gradient), beta, objective, worst, False


def _summed(parts: DataFrame, by: list[str]) -> DataFrame:
    added = parts.select(*by, array_to_vector("v").alias("v")).groupBy(*by).agg(Summarizer.sum(F.col("v")).alias("v"))
    return added.select(*by, vector_to_array("v").alias("v"))


# --- one regression for each group ----------------------------------------------------

def fit_groups(rows: DataFrame, by: str, features: list[str], label: str, penalty: float = 1.0, weight: str | None = None,
               copies: str | None = None) -> DataFrame:
    """``by``, n, positives, coefficients (intercept first), gradient and steps: one regression for every value of ``by``.

    ``gradient`` is the largest part of the penalised gradient at the coefficients, the certificate of the
    fit.  Rows without a label or without a group take no part; groups may be very many and of any
    size.  Where only one outcome occurs there is no solution: the coefficients are NULL.  Regressions that
    are done are left out of later steps.  With ``copies`` a row stands for so many equal ones.
    """
    spark = rows.sparkSession
    ready = materialize(design(rows.where(F.col(by).isNotNull()).withColumn("_g", F.col(by).cast("string")), features, label, "_g", weight=weight, copies=copies), "designs")
    size = len(features) + 1
    zeros = F.array_repeat(F.lit(0.0), size)
    both = F.col("positives").between(1, F.col("n") - 1)
    state = ready.groupBy("_g").agg(F.sum("_n").alias("n"), F.sum(F.col("_y") * F.col("_n")).cast("long").alias("positives")).select(
        "_g", "n", "positives", zeros.alias("beta"), F.when(both, zeros).alias("before"), F.lit(float("inf")).alias("least"),
        F.when(both, float("inf")).alias("gradient"), F.lit(0).alias("steps"), (~both).alias("done"))
    state = materialize(state, "fits")

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}

        def told():
            out = pd.DataFrame({"_g": list(held), "v": list(held.values())})
            held.clear()
            return out

        for batch in batches:
            if not len(batch):
                continue
            codes, names = pd.factorize(batch["_g"], sort=False)
            order = np.argsort(codes, kind="stable")
            x, y, w = np.stack(batch["_x"].to_numpy()), batch["_y"].to_numpy(), batch["_w"].to_numpy()
            ends = np.cumsum(np.bincount(codes))
            for code, (a, b) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
                own = order[a:b]
                beta = np.asarray(batch["beta"].iloc[own[0]], dtype=float)[None, :]
                loss, residual, curve = losses(x[own], y[own], w[own], beta)
                v = np.r_[loss.sum(), w[own].sum(), (residual.T @ x[own])[0], (curve.T @ products(x[own]))[0]]
                name = names[code]
                held[name] = held[name] + v if name in held else v
            if len(held) > HELD:
                yield told()
        yield told()

    schema = state.schema

    def moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                beta, before, least, gradient, done = step(np.asarray(r.beta), np.asarray(r.before), r.least, np.asarray(r.v), penalty)
                out.append((r[0], r.n, r.positives, beta.tolist(), before.tolist(), least, gradient, r.steps + 1, done))
            yield pd.DataFrame(out, columns=schema.names)

    for _ in range(STEPS):
        open_ = state.where("NOT done")
        sums = _summed(ready.join(open_.select("_g", "beta"), "_g").mapInPandas(parts, "_g string, v array<double>"), ["_g"])
        # The first column goes by position: names that begin with _ have none in a row's tuple.
        new = open_.join(sums, "_g").select(*schema.names, "v").mapInPandas(moved, schema)
        state = materialize(state.where("done").unionByName(new), "fits")
        if state.where("NOT done").isEmpty():
            break
    kind = rows.schema[by].dataType
    return state.select(F.col("_g").cast(kind).alias(by), "n", "positives", F.col("before").alias("coefficients"), "gradient", "steps")


def probability(features: list[str], coefficients: Column) -> Column:
    """Probability of a row under an array of coefficients; unknown features count as 0."""
    z = coefficients[0]
    for i, c in enumerate(features):
        z = z + coefficients[i + 1] * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def specialists(rows: DataFrame, train: Column, by: str, features: list[str], label: str, positives: int = 300,
                penalty: float = 1.0, name: str = "score") -> DataFrame:
    """Rows with the score of their group's own regression, or of the one over all groups where it is not eligible.

    Fitted on the rows for which ``train`` holds, all regressions in one fit; rows that agree in group, features
    and label are counted first, so that each step reads only different ones.  A group is eligible with
    so many positives and at least one negative.  ``specialist`` tells which score a row has.  Rows
    without a group get the common score.
    """
    everything = "\x00"  # no group's name
    known = rows.where(train & F.col(label).isNotNull())
    different = known.groupBy(*dict.fromkeys([by, *features, label])).agg(F.count(F.lit(1)).alias("_copies"))
    tagged = different.withColumn("_group", F.explode(F.array_compact(F.array(F.col(by).cast("string"), F.lit(everything)))))
    fits = fit_groups(tagged, "_group", features, label, penalty, copies="_copies")
    common = fits.where(F.col("_group") == everything).select("coefficients").agg(F.first("coefficients")).scalar()
    own = fits.where((F.col("_group") != everything) & (F.col("positives") >= positives) & (F.col("n") > F.col("positives")))
    out = rows.join(own.select("_group", F.col("coefficients").alias("_own")), F.col(by).cast("string") == F.col("_group"), "left")
    out = out.withColumn("_used", F.coalesce("_own", common))
    return out.select(*rows.columns, F.col("_own").isNotNull().cast("int").alias("specialist"), probability(features, F.col("_used")).alias(name))


# --- a design learned from the training rows --------------------------------------------

class Standard:
    """Medians for unknown numbers with flags where the training rows had any, unit scale, one column per category.

    What it holds is a few numbers for each feature and at most ``most`` categories of each column, the
    most frequent ones; others, and those first seen later, have no column set.
    """

    def __init__(self, train: DataFrame, numeric: list[str], categorical: list[str] = (), most: int = 512):
        self.numeric, self.categorical = list(numeric), list(categorical)
        values = train.select(*[F.col(c).cast("double").alias(c) for c in self.numeric])
        total, *known = values.agg(F.count(F.lit(1)), *[F.count(c) for c in self.numeric]).first()
        self.flags = [c for c, n in zip(self.numeric, known) if 0 < n < total]
        self.usable = [c for c, n in zip(self.numeric, known) if n > 0]
        counts = values.unpivot([], self.numeric, "feature", "value").where("value IS NOT NULL").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
        self.median = {r.feature: r.quantile for r in exact_quantiles(counts, ["feature"], "value", "n", [0.5]).collect()}
        plain = [self._filled(c) for c in self.usable] + [self._flag(c) for c in self.flags]
        moments = train.agg(*[f(x) for x in plain for f in (F.avg, F.stddev_pop)]).first() if plain else []
        self.scale = [(moments[2 * i], moments[2 * i + 1] if moments[2 * i + 1] > 1e-12 else 1.0) for i in range(len(plain))]
        self.categories = []
        for c in self.categorical:
            top = train.groupBy(self._text(c).alias("v")).count().orderBy(F.desc("count"), "v").limit(most)
            self.categories += [(c, r.v) for r in top.collect()]
        self.categories.sort()
        #: What each column of the design stands for.
        self.names = [*self.usable, *[f"{c}_missing" for c in self.flags], *[f"{c}={v}" for c, v in self.categories]]
        self.columns = [f"_f{i}" for i in range(len(self.names))]

    def _filled(self, c: str) -> Column:
        return F.coalesce(F.col(c).cast("double"), F.lit(self.median[c]))

    @staticmethod
    def _flag(c: str) -> Column:
        return F.col(c).isNull().cast("double")

    @staticmethod
    def _text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("__MISSING__"))

    def apply(self, rows: DataFrame) -> DataFrame:
        """The rows with the design's columns."""
        plain = [self._filled(c) for c in self.usable] + [self._flag(c) for c in self.flags]
        shown = [(x - mean) / std for x, (mean, std) in zip(plain, self.scale)]
        shown += [(self._text(c) == v).cast("double") for c, v in self.categories]
        return rows.select("*", *[x.alias(n) for x, n in zip(shown, self.columns)])


def fit_labels(train: DataFrame, features: list[str], labels: dict[str, Column], penalty: float = 1.0) -> DataFrame:
    """label, n, positives, coefficients, gradient and steps: one regression for each named label, in one fit.

    A label that is NULL leaves its row out of that regression only.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), c.cast("double").alias("y")) for n, c in labels.items()]))
    return fit_groups(train.withColumn("_l", each).select("*", "_l.label", "_l.y"), "label", features, "y", penalty)


def score_labels(rows: DataFrame, fits: DataFrame, features: list[str], names: list[str]) -> DataFrame:
    """The rows with the probability of each named label as a column; the coefficients are one row for each label."""
    out = rows
    for n in names:
        out = out.withColumn(f"_c_{n}", fits.where(F.col("label") == n).agg(F.first("coefficients")).scalar())
    return out.select(*rows.columns, *[probability(features, F.col(f"_c_{n}")).alias(f"p_{n}") for n in names])


def certificate(train: DataFrame, fits: DataFrame, features: list[str], names: list[str], label: str, target: Column, penalty: float = 1.0) -> DataFrame:
    """feature, coefficient, gradient: the penalised gradient of one fit, added up anew from scored rows."""
    scored = score_labels(train.where(target.isNotNull()), fits, features, [label])
    left = F.col(f"p_{label}") - target.cast("double")
    sums = scored.agg(F.array(F.sum(left), *[F.sum(left * F.coalesce(F.col(c), F.lit(0.0))) for c in features]).alias("g"))
    both = fits.where(F.col("label") == label).select("coefficients").crossJoin(sums)  # one row each
    shown = F.transform(F.arrays_zip("coefficients", "g"), lambda s, i: F.struct(
        F.element_at(F.array(F.lit("intercept"), *[F.lit(n) for n in names]), i + 1).alias("feature"), s["coefficients"].alias("coefficient"),
        (s["g"] + F.when(i > 0, penalty * s["coefficients"]).otherwise(0.0)).alias("gradient")))
    return both.select(F.explode(shown).alias("s")).select("s.*")


# --- one regression for each period, on everything before it ----------------------------

def fit_periods(rows: DataFrame, starts: list, features: list[str], label: str, embargo: int = 2, penalty: float = 1.0) -> DataFrame:
    """period (its first day), n, positives, coefficients, gradient and steps: for every period a regression on all
    rows up to ``embargo`` days before its start.

    A row takes part in the regressions of all periods from the first that may know its label.  At the common
    start one set of sums for each period's new rows is enough: they run on through the periods.  From there
    all periods take their steps together, one reading of the rows for each step.  ``starts`` is a
    list of days in order, one for each refit: their coefficients go to every task.
    """
    spark = rows.sparkSession
    days = F.array(*[F.lit(s).cast("date") for s in starts])
    # The first period that starts late enough; rows too late for any take no part.
    since = F.array_position(F.transform(days, lambda s: F.date_sub(s, embargo) >= F.col("date")), True) - 1
    ready = materialize(design(rows.withColumn("_since", since.cast("int")).where("_since >= 0"), features, label, "_since"), "designs")
    periods, size = len(starts), len(features) + 1
    width = 2 + size + size * (size + 1) // 2

    def first_sums() -> dict[int, np.ndarray]:
        def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros((periods, width))
            for batch in batches:
                if len(batch):
                    x, y, w = np.stack(batch["_x"].to_numpy()), batch["_y"].to_numpy(), batch["_w"].to_numpy()
                    loss, residual, curve = losses(x, y, w, np.zeros((1, size)))
                    np.add.at(out, batch["_since"].to_numpy(), np.hstack([loss, w[:, None], residual * x, curve * products(x)]))
            some = np.flatnonzero(out.any(1))
            yield pd.DataFrame({"period": some, "v": list(out[some])})

        new = np.zeros((periods, width))
        for r in _summed(ready.mapInPandas(parts, "period long, v array<double>"), ["period"]).collect():
            new[r.period] = r.v
        return dict(enumerate(np.cumsum(new, axis=0)))

    def sums_at(beta: np.ndarray, some: np.ndarray) -> dict[int, np.ndarray]:
        def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros((len(some), width))
            for batch in batches:
                for lo in range(0, len(batch), 4096):
                    part = batch.iloc[lo:lo + 4096]
                    x, y, w = np.stack(part["_x"].to_numpy()), part["_y"].to_numpy(), part["_w"].to_numpy()
                    known = part["_since"].to_numpy()[:, None] <= some[None, :]
                    loss, residual, curve = (v * known for v in losses(x, y, w, beta))
                    out[:, 0] += loss.sum(0)
                    out[:, 1] += w @ known
                    out[:, 2:2 + size] += residual.T @ x
                    out[:, 2 + size:] += curve.T @ products(x)
            yield pd.DataFrame({"period": some, "v": list(out)})

        return {r.period: np.asarray(r.v) for r in _summed(ready.mapInPandas(parts, "period long, v array<double>"), ["period"]).collect()}

    counts = {r[0]: (r[1], r[2]) for r in ready.groupBy("_since").agg(F.count(F.lit(1)), F.sum("_y").cast("long")).collect()}
    n, positives = (np.cumsum([counts.get(i, (0, 0))[k] for i in range(periods)]) for k in (0, 1))
    beta, before = np.zeros((periods, size)), np.zeros((periods, size))
    least, gradient, steps = np.full(periods, np.inf), np.full(periods, np.inf), np.zeros(periods, dtype=int)
    solvable = (positives > 0) & (positives < n)
    open_ = np.flatnonzero(solvable)
    for at in range(STEPS):
        if not len(open_):
            break
        sums = sums_at(beta[open_], open_) if at else first_sums()
        left = []
        for i in open_.tolist():
            beta[i], before[i], least[i], gradient[i], done = step(beta[i], before[i], least[i], sums[i], penalty)
            steps[i] += 1
            if not done:
                left.append(i)
        open_ = np.array(left, dtype=int)
    found = [(starts[i], int(n[i]), int(positives[i]), before[i].tolist(), float(gradient[i]), int(steps[i])) for i in range(periods) if solvable[i]]
    schema = "period string, n long, positives long, coefficients array<double>, gradient double, steps int"
    return spark.createDataFrame([(str(f[0]), *f[1:]) for f in found], schema).withColumn("period", F.to_date("period"))


def refit_scores(rows: DataFrame, starts: list, features: list[str], label: str, embargo: int = 2, penalty: float = 1.0,
                 name: str = "score") -> DataFrame:
    """Rows of every period with the score of its own refit, the period and the last day it could learn from.

    A period runs to the next one's start.  Rows before the first period, or of a period that had not seen both
    outcomes, are left out.
    """
    fits = fit_periods(rows, starts, features, label, embargo, penalty)
    days = F.array(*[F.lit(s).cast("date") for s in starts])
    own = F.element_at(F.filter(days, lambda s: s <= F.col("date")), -1)
    dated = rows.where(F.col("date") >= F.lit(starts[0]).cast("date")).withColumn("period", own)
    out = dated.join(fits.select("period", "coefficients"), "period")
    return out.select(*rows.columns, "period", F.date_sub("period", embargo).alias("train_end"), probability(features, F.col("coefficients")).alias(name))
