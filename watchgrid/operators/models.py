"""Model fits on spark.ml, and the scoring logic around them.

Fits are distributed jobs over materialized designs.  Scores differ from other
boosting libraries; the data flow (time splits, weights, conditional stages,
blends, refits) is the subject here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchgrid.operators.evaluation import average_precision, pr_curve
from watchgrid.operators.features import sanitize
from watchgrid.operators.quality import expect_empty, require_columns
from watchgrid.plans.running import exact_quantiles, ranked
from watchgrid.session import materialize

SEED = 84


def class_probability(scored: DataFrame, name: str, index: int = 1) -> DataFrame:
    """Probability of one class as a plain column."""
    inner = {"features", "rawPrediction", "probability", "prediction"}
    keep = [c for c in scored.columns if c not in inner and not c.startswith("_ml_")]
    return scored.select(*keep, vector_to_array("probability")[index].alias(name))


def baseline_scores(labelled: DataFrame, cutoff: Column) -> DataFrame:
    """Always positive, today's alarm, and the frozen training frequency."""
    from watchgrid.operators.objects import frozen_frequency

    rated = frozen_frequency(labelled, cutoff)
    return rated.withColumns({"always": F.lit(1.0), "persistence": F.col("alarm_today").cast("double"),
                              "frequency": F.coalesce("frequency", F.lit(0.0))})


# --- encodings ----------------------------------------------------------------------

def rare_category_map(train: DataFrame, columns: list[str], limit: int = 512) -> DataFrame:
    """Codes 1.. for the most frequent categories of each column.

    Counts are long form; the limit per column is applied before the shuffle.
    """
    values = train.select(*[F.coalesce(F.col(c).cast("string"), F.lit("<MISSING>")).alias(c) for c in columns])
    counted = values.unpivot([], columns, "column_name", "value").groupBy("column_name", "value").agg(
        F.count("*").alias("n"))
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return counted.withColumn("code", F.row_number().over(w)).where(F.col("code") <= limit)


def encode_categories(rows: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """Replace categories by codes, 0 for rare and unseen ones."""
    for c in columns:
        codes = mapping.where(F.col("column_name") == c).select(F.col("value").alias("_v"), F.col("code").alias("_code"))
        text = F.coalesce(F.col(c).cast("string"), F.lit("<MISSING>"))
        rows = (rows.withColumn("_t", text).join(codes, F.col("_t") == F.col("_v"), "left")
                .withColumn(f"{c}_code", F.coalesce("_code", F.lit(0))).drop("_v", "_t", "_code"))
    return rows


def spline_knots(train: DataFrame, columns: list[str], knots: int = 4) -> DataFrame:
    """Quantile knots per column as (feature, knots)."""
    values = train.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "feature", "value").where("value IS NOT NULL")
    counts = values.groupBy("feature", "value").agg(F.count("*").alias("n"))
    probs = [i / (knots - 1) for i in range(knots)]
    q = exact_quantiles(counts, ["feature"], "value", "n", probs)
    return q.groupBy("feature").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("prob", "quantile"))), lambda s: s["quantile"]).alias("knots"))


def spline_basis(rows: DataFrame, knots: DataFrame, columns: list[str], count: int = 4, degree: int = 2) -> DataFrame:
    """B-spline columns ``{c}_s{i}`` with constant continuation outside the knots.

    The boundary intervals are repeated outwards; the first basis is left out.
    """
    table = knots.agg(F.map_from_entries(F.collect_list(F.struct("feature", "knots"))).alias("m")).scalar()
    rows = rows.withColumn("_knots", table)
    for c in columns:
        rows = rows.withColumn("_k", F.col("_knots")[c])
        k = [F.col("_k")[i] for i in range(count)]
        first, last = k[1] - k[0], k[-1] - k[-2]
        t = [k[0] - first * n for n in range(degree, 0, -1)] + k + [k[-1] + last * n for n in range(1, degree + 1)]
        # A touch below the last knot, where the polynomials are continuous.
        x = F.greatest(k[0], F.least(k[-1], F.col(c).cast("double")))

        def basis(i: int, d: int) -> Column:
            if d == 0:
                return F.when((x >= t[i]) & (x < t[i + 1]), 1.0).otherwise(0.0)
            left = F.coalesce(F.try_divide(x - t[i], t[i + d] - t[i]), F.lit(0.0)) * basis(i, d - 1)
            right = F.coalesce(F.try_divide(t[i + d + 1] - x, t[i + d + 1] - t[i + 1]), F.lit(0.0)) * basis(i + 1, d - 1)
            return left + right

        rows = rows.withColumns({f"{c}_s{i}": F.when(F.col(c).isNotNull(), basis(i, degree))
                                 for i in range(1, count + degree - 1)}).drop("_k")
    return rows.drop("_knots")


# --- fits -----------------------------------------------------------------------------

def fit_boosted(train: DataFrame, tune: DataFrame, numeric: list[str], categorical: list[str], label: str,
                weight: str | None = None, iterations: int = 40, depth: int = 4, most: int = 500) -> PipelineModel:
    """Weighted boosted trees that stop when the tuning period no longer improves.

    The ``most`` frequent training categories of each column have their own bin; rarer and unseen ones
    share one.
    """
    rows = train.withColumn("_tune", F.lit(False)).unionByName(tune.withColumn("_tune", F.lit(True)))
    rows = rows.where(F.col(label).isNotNull())
    keep = [label, "_tune", *([weight] if weight else [])]
    clean = sanitize(rows.select(*keep, *numeric, *categorical), numeric, categorical)
    clean = clean.withColumn(label, F.col(label).cast("double"))
    own = {c: [] for c in categorical}
    if categorical:
        for r in rare_category_map(clean.where("NOT _tune"), categorical, most).orderBy("code").collect():
            own[r.column_name].append(r.value)
    indexers = [StringIndexerModel.from_labels(own[c] or [""], inputCol=c, outputCol=f"_ml_{c}", handleInvalid="keep") for c in categorical]
    assembler = VectorAssembler(inputCols=[*numeric, *[f"_ml_{c}" for c in categorical]], outputCol="features")
    trees = GBTClassifier(labelCol=label, maxIter=iterations, maxDepth=depth, stepSize=0.1, subsamplingRate=0.85,
                          validationIndicatorCol="_tune", validationTol=0.001, maxBins=max(32, most + 2), seed=SEED,
                          checkpointInterval=10)
    if weight:
        trees.setWeightCol(weight)
    return Pipeline(stages=[*indexers, assembler, trees]).fit(clean)


def score_boosted(model: PipelineModel, rows: DataFrame, numeric: list[str], categorical: list[str], name: str) -> DataFrame:
    return class_probability(model.transform(sanitize(rows, numeric, categorical)), name)


def with_missing_flags(rows: DataFrame, numeric: list[str]) -> DataFrame:
    return rows.select("*", *[F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in numeric])


def fit_logistic(train: DataFrame, numeric: list[str], categorical: list[str], label: str,
                 c: float = 1.0, family: str = "binomial") -> PipelineModel:
    """Median imputation with missing flags, scaling, one-hot and L2 logistic regression."""
    rows = with_missing_flags(train.where(F.col(label).isNotNull()), numeric).withColumn(
        label, F.col(label).cast("double"))
    known = rows.agg(F.count("*").alias("n"), *[F.count(x).alias(x) for x in numeric]).first()
    usable = [x for x in numeric if known[x] > 0]
    rows = rows.select(label, *[F.col(x).cast("double").alias(x) for x in usable],
                       *[f"{x}_missing" for x in numeric],
                       *[F.coalesce(F.col(k).cast("string"), F.lit("__MISSING__")).alias(k) for k in categorical])
    stages = [
        Imputer(strategy="median", inputCols=usable, outputCols=[f"_ml_{x}" for x in usable]),
        VectorAssembler(inputCols=[f"_ml_{x}" for x in usable] + [f"{x}_missing" for x in numeric], outputCol="_ml_numbers"),
        StandardScaler(inputCol="_ml_numbers", outputCol="_ml_scaled", withMean=True, withStd=True),
    ]
    parts = ["_ml_scaled"]
    if categorical:
        index = [f"_ml_{k}_index" for k in categorical]
        hot = [f"_ml_{k}_hot" for k in categorical]
        stages += [StringIndexer(inputCols=categorical, outputCols=index, handleInvalid="keep"),
                   OneHotEncoder(inputCols=index, outputCols=hot, handleInvalid="keep", dropLast=False)]
        parts += hot
    stages += [VectorAssembler(inputCols=parts, outputCol="features"),
               LogisticRegression(labelCol=label, regParam=1.0 / (c * max(known["n"], 1)), elasticNetParam=0.0,
                                  standardization=False, maxIter=100, tol=1e-5, family=family)]
    return Pipeline(stages=stages).fit(rows)


def score_logistic(model: PipelineModel, rows: DataFrame, numeric: list[str], categorical: list[str],
                   name: str, index: int = 1) -> DataFrame:
    # Categories are rendered as in the fit; unknown ones fall to the spare index.
    shown = with_missing_flags(rows, numeric)
    shown = shown.withColumns({x: F.col(x).cast("double") for x in numeric})
    shown = shown.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("__MISSING__")) for k in categorical})
    scored = class_probability(model.transform(shown), name, index)
    return scored.drop(*[f"{x}_missing" for x in numeric])


def hurdle(train: DataFrame, rows: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """P(quiet D+1) times P(alarm D+2 given quiet D+1), two separate fits."""
    quiet = fit_logistic(train, numeric, categorical, "quiet_intermediate")
    alarm = fit_logistic(train.where("quiet_intermediate = 1"), numeric, categorical, "alarm_target")
    scored = score_logistic(quiet, rows, numeric, categorical, "p_quiet")
    scored = score_logistic(alarm, scored, numeric, categorical, "p_alarm")
    return scored.withColumn("score", F.col("p_quiet") * F.col("p_alarm"))


def joint(train: DataFrame, rows: DataFrame, numeric: list[str], label: str = "joint_target") -> DataFrame:
    """Four classes of the next two days; the score is the class quiet-then-alarm."""
    known = sanitize(train.where(F.col(label).isNotNull()).select(label, *numeric), numeric, [])
    known = known.withColumn(label, F.col(label).cast("double"))
    forest = RandomForestClassifier(labelCol=label, numTrees=40, maxDepth=6, seed=SEED, featureSubsetStrategy="sqrt")
    model = Pipeline(stages=[VectorAssembler(inputCols=numeric, outputCol="features"), forest]).fit(known)
    return class_probability(model.transform(sanitize(rows, numeric, [])), "score", 1)


# --- combining and selecting ------------------------------------------------------------

def blend(scores: DataFrame, parts: dict[str, float], name: str) -> DataFrame:
    """Convex combination of aligned score columns."""
    if abs(sum(parts.values()) - 1) > 1e-9 or any(w < 0 for w in parts.values()):
        raise ValueError("blend weights must be non-negative and sum to one")
    require_columns(scores, list(parts), "scores")
    terms = [F.col(c) * w for c, w in parts.items()]
    return scores.withColumn(name, reduce(lambda a, b: a + b, terms))


def product(scores: DataFrame, parts: list[str], name: str) -> DataFrame:
    return scores.withColumn(name, reduce(lambda a, b: a * b, [F.col(c) for c in parts]))


def route_experts(scores: DataFrame, experts: DataFrame, keys: list[str], fallback: str, name: str) -> DataFrame:
    """Score of the specialist of each row's system, else the fallback score."""
    own = experts.select(*keys, F.col("score").alias("_expert"))
    return scores.join(own, keys, "left").withColumn(name, F.coalesce("_expert", fallback)).drop("_expert")


def select_model(tuning: DataFrame, later: DataFrame, control: str) -> DataFrame:
    """Candidates in order of their precision, AP and name on the tuning period, and the gate on a later one.

    The gate holds the later precision against the control's of the same days, so no day both chooses and
    admits a model.
    """
    order = [F.desc("precision"), F.desc("average_precision"), "model"]
    # One row per candidate model: a list for the driver, not data.
    ranked_rows = tuning.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))
    bar = later.where(F.col("model") == control).agg(F.max("precision")).scalar()
    gate = later.select("model", F.col("precision").alias("later_precision"), (F.col("precision") >= bar).cast("int").alias("passes_gate"))
    return ranked_rows.join(gate, "model", "left").withColumns({
        "selected": (F.col("place") == 1).cast("int"), "passes_gate": F.coalesce("passes_gate", F.lit(0))})


def score_batch(scored: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Frozen scoring output: score and warning; missing, infinite or improper scores and repeated keys are refused."""
    score = F.col("score")
    valid = score.isNotNull() & ~F.isnan(score) & score.between(0.0, 1.0)
    expect_empty(scored.where(~F.coalesce(valid, F.lit(False))).select(*keys, "score"), "scores outside of 0 to 1")
    expect_empty(scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "rows scored twice")
    return scored.select(*keys, "score", (score >= threshold).cast("int").alias("warning"))


def shuffled_positions(base: DataFrame, copies: Column, keys: list[str], seed: int) -> DataFrame:
    """feature, repeat, _position, _from: the rank of every row in the order of each copy's hash.

    Hashes are even, so their first byte cuts each copy into 256 like parts: ranks count within
    a part and go on from the parts before.  Only positions and hashes move, no features.
    """
    exploded = base.select("_position", *keys, F.explode(copies).alias("_c")).select(
        "_position", F.col("_c.feature").alias("feature"), F.col("_c.repeat").alias("repeat"), *keys)
    drawn = exploded.withColumn("_h", F.xxhash64(F.lit(seed), "feature", "repeat", *keys))
    drawn = drawn.select("feature", "repeat", "_position", "_h", F.shiftright("_h", 56).alias("_part"))
    part = ["feature", "repeat", "_part"]
    earlier = Window.partitionBy("feature", "repeat").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = drawn.groupBy(*part).agg(F.count("*").alias("_n")).select(*part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*part).orderBy("_h", "_position"))
    numbered = drawn.withColumn("_in", inside).join(materialize(sizes, "parts"), part)
    return numbered.select("feature", "repeat", "_position", (F.col("_in") + F.col("_before")).alias("_from"))


def permutation_importance(rows: DataFrame, score, features: list[str], keys: list[str], label: str,
                           repeats: int = 5, seed: int = SEED) -> DataFrame:
    """Loss of average precision when one feature is shuffled.

    All (feature, repeat) copies are scored in one job: each copy takes the
    feature from the row at its shuffled position.  ``score`` maps a table of
    features to one with a ``score`` column.
    """
    order = [F.col(k) for k in keys]
    base = materialize(ranked(rows.select(*keys, label, *features), [], order, "_position"), "positions")
    copies = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(r).alias("repeat"))
                       for f in features for r in range(repeats)])
    shuffled = shuffled_positions(base, copies, keys, seed)
    value = reduce(lambda c, f: c.when(F.col("feature") == f, F.col(f)), features[1:], F.when(F.col("feature") == features[0], F.col(features[0])))
    donors = base.select(F.col("_position").alias("_from"), *features)
    drawn = shuffled.join(donors, "_from").select("_position", "feature", "repeat", value.alias("_value"))
    swapped = drawn.join(base, "_position").select(
        *keys, label, "feature", "repeat",
        *[F.when(F.col("feature") == f, F.col("_value").cast(base.schema[f].dataType)).otherwise(F.col(f)).alias(f) for f in features])
    plain = base.select(*keys, label, F.lit("").alias("feature"), F.lit(0).alias("repeat"), *features)
    by = ["feature", "repeat"]
    ap = average_precision(pr_curve(score(swapped.unionByName(plain)), by, label), by)
    whole = ap.where("feature = ''").agg(F.max("average_precision")).scalar()
    drops = ap.where("feature <> ''").withColumn("drop", whole - F.col("average_precision"))
    return drops.groupBy("feature").agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("spread"),
                                        F.count("*").alias("repeats"))
