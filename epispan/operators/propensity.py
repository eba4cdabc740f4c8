"""Propensity scores: classifiers of exposure, cross-fitted calibration and the choice between them."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispan.functions.hashing import stable_hash
from epispan.functions.stats import clipped, logit
from epispan.operators import isotonic
from epispan.operators.matching import balanced_weights
from epispan.operators.sampling import in_training
from epispan.session import FITS_AT_ONCE, cut, fit_together

# Grid of the boosted classifier and its settings without a search.
GRID_DEPTH = (3, 4, 5)
GRID_RATE = (0.01, 0.1, 0.2)
GRID_ITERATIONS = (50, 100, 200)
BASE_DEPTH, BASE_RATE, BASE_ITERATIONS = 6, 0.01, 100
METHODS = ("uncalibrated", "isotonic", "sigmoid")
MAX_TREE_DEPTH = 30


def numeric_features(frame: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Cast features to double and add a missing flag for every column that has nulls."""
    cast = frame.withColumns({c: F.col(f"`{c}`").cast("double") for c in columns})
    holes = cast.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns]).first()
    flagged = [c for c in columns if holes[c]]
    flags = {f"{c}_missing": F.col(f"`{c}`").isNull().cast("double") for c in flagged}
    return cast.withColumns(flags), flagged


def feature_stages(columns: Sequence[str], flagged: Sequence[str]) -> list[Estimator | Transformer]:
    """Impute flagged columns by their mean and assemble one feature vector."""
    filled = {c: f"{c}_filled" for c in flagged}
    inputs = [filled.get(c, c) for c in columns] + [f"{c}_missing" for c in flagged]
    stages: list[Estimator | Transformer] = []
    if flagged:
        stages.append(
            Imputer(inputCols=list(flagged), outputCols=list(filled.values()), strategy="mean")
        )
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error"))
    return stages


def classifier(learner: str, label: str, weight: str | None = None, seed: int = 0, **settings) -> Estimator:
    """A probabilistic classifier of Spark ML."""
    common = {"labelCol": label, "featuresCol": "features"}
    if weight:
        common["weightCol"] = weight
    if learner == "logistic":
        return LogisticRegression(**common, regParam=1e-4, maxIter=50, **settings)
    if learner == "gbt":
        depth = {"maxDepth": BASE_DEPTH, "stepSize": BASE_RATE, "maxIter": BASE_ITERATIONS}
        return GBTClassifier(**common, seed=seed, **{**depth, **settings})
    if learner == "forest":
        return RandomForestClassifier(**common, seed=seed, **{"numTrees": 100, **settings})
    raise ValueError(f"Unknown learner: {learner}")


@dataclass(frozen=True)
class ScoredFrame:
    """A frame with features and label, ready for repeated fits."""

    frame: DataFrame
    columns: tuple[str, ...]
    flagged: tuple[str, ...]
    label: str

    def fit(self, rows: DataFrame, learner: str, weight: str | None = None, **settings) -> PipelineModel:
        stages = feature_stages(self.columns, self.flagged)
        estimator = classifier(learner, self.label, weight, **settings)
        return Pipeline(stages=[*stages, estimator]).fit(rows)


def prepare(frame: DataFrame, treated: str, columns: Sequence[str]) -> ScoredFrame:
    cast, flagged = numeric_features(frame, columns)
    labelled = cast.withColumn("label", F.col(treated).cast("double"))
    return ScoredFrame(labelled, tuple(columns), tuple(flagged), "label")


MODEL_COLUMNS = ("features", "rawPrediction", "probability", "prediction")


def with_score(model: PipelineModel, frame: DataFrame, out: str) -> DataFrame:
    """Add the predicted probability of the label and drop the model's working columns."""
    scored = model.transform(frame).withColumn(out, vector_to_array("probability")[1])
    keep = set(frame.columns)
    return scored.drop(*[c for c in scored.columns if c != out and c not in keep])


def grid_search(
    data: ScoredFrame,
    rows: DataFrame,
    fold: str,
    folds: int,
    depths: Sequence[int] = GRID_DEPTH,
    rates: Sequence[float] = GRID_RATE,
    iterations: Sequence[int] = GRID_ITERATIONS,
    at_once: int = FITS_AT_ONCE,
) -> list[dict]:
    """Mean accuracy of every grid point over given folds; all fits run side by side."""
    rows = cut(rows, "grid", by=(fold,))
    grid = list(itertools.product(depths, rates, iterations))
    judge = MulticlassClassificationEvaluator(labelCol=data.label, metricName="accuracy")

    def accuracy(task) -> float:
        (depth, rate, rounds), k = task
        settings = {"maxDepth": depth, "stepSize": rate, "maxIter": rounds}
        model = data.fit(rows.where(F.col(fold) != k), "gbt", **settings)
        return judge.evaluate(model.transform(rows.where(F.col(fold) == k)))

    tasks = list(itertools.product(grid, range(folds)))
    found = fit_together(rows.sparkSession, accuracy, tasks, at_once)
    names = ("max_depth", "learning_rate", "max_iter")
    return [
        {**dict(zip(names, point)), "accuracy": sum(found[i * folds : (i + 1) * folds]) / folds}
        for i, point in enumerate(grid)
    ]


def hash_fold(id_col: str, seed: int, k: int):
    return F.pmod(stable_hash(seed, F.lit("calibrate"), id_col), F.lit(k)).cast("int")


def calibrated_scores(
    data: ScoredFrame,
    training: DataFrame,
    target: DataFrame,
    id_col: str,
    seed: int,
    learner: str,
    folds: int = 5,
    **settings,
) -> DataFrame:
    """Add isotonic and sigmoid scores: per fold a model on the others, calibrated on the fold.

    The scores of the folds are averaged.  The fold models use no class weights.
    """
    numbered = training.withColumn("_fold", hash_fold(id_col, seed, folds))
    sums = {m: F.lit(0.0) for m in ("isotonic", "sigmoid")}

    def fit(k: int):
        model = data.fit(numbered.where(F.col("_fold") != k), learner, **settings)
        raw, edge = f"_raw_{k}", f"_logit_{k}"
        held = with_score(model, numbered.where(F.col("_fold") == k), raw)
        held = held.withColumn(edge, logit(clipped(F.col(raw)))).select(raw, edge, data.label)
        steps = isotonic.fit(held, raw, data.label)
        platt = Pipeline(
            stages=[
                VectorAssembler(inputCols=[edge], outputCol="_edge"),
                LogisticRegression(
                    featuresCol="_edge", labelCol=data.label, probabilityCol="_p", rawPredictionCol="_rp", predictionCol="_pr"
                ),
            ]
        ).fit(held)
        return model, steps, platt

    out = target
    for k, (model, steps, platt) in enumerate(fit_together(training.sparkSession, fit, range(folds))):
        raw, edge = f"_raw_{k}", f"_logit_{k}"
        out = with_score(model, out, raw).withColumn(edge, logit(clipped(F.col(raw))))
        out = out.withColumn(f"_iso_{k}", steps.value(F.col(raw)))
        out = platt.transform(out).withColumn(f"_sig_{k}", vector_to_array("_p")[1])
        out = out.drop("_edge", "_p", "_rp", "_pr")
        sums["isotonic"] = sums["isotonic"] + F.col(f"_iso_{k}")
        sums["sigmoid"] = sums["sigmoid"] + F.col(f"_sig_{k}")
    out = out.withColumns({f"propensity_{m}": total / folds for m, total in sums.items()})
    return out.drop(*[c for c in out.columns if c.startswith(("_raw_", "_logit_", "_iso_", "_sig_"))])


def brier_scores(frame: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Mean squared error of several probability columns, in one pass."""
    y = F.col(label).cast("double")
    return frame.agg(*[F.avg((y - F.col(c)) * (y - F.col(c))).alias(c) for c in columns])


def pick_calibration(frame: DataFrame, label: str, columns: Sequence[str]) -> tuple[str, DataFrame]:
    """Use the column with the smallest Brier score, clipped away from 0 and 1."""
    row = brier_scores(frame, label, columns).first()
    best = min(columns, key=lambda c: row[c])
    return best, frame.withColumn("propensity_score", clipped(F.col(best)))


def propensity_scores(
    frame: DataFrame,
    id_col: str,
    treated: str,
    columns: Sequence[str],
    seed: int,
    learner: str = "gbt",
    calibrate: bool = False,
    grid: bool = False,
    folds: int = 5,
    **settings,
) -> DataFrame:
    """Propensity score and logit of every row from a class-balanced model on a training share."""
    data = prepare(frame, treated, columns)
    training = data.frame.where(in_training(id_col, seed))
    if grid:
        if learner != "gbt":
            raise ValueError("the grid search tunes the boosted classifier")
        numbered = training.withColumn("_fold", hash_fold(id_col, seed, folds))
        points = grid_search(data, numbered, "_fold", folds)
        best = max(points, key=lambda p: p["accuracy"])
        settings = {
            "maxDepth": best["max_depth"],
            "stepSize": best["learning_rate"],
            "maxIter": best["max_iter"],
        }
    weighted = balanced_weights(training, data.label)
    model = data.fit(weighted, learner, weight="weight", **settings)
    scored = with_score(model, data.frame, "propensity_uncalibrated")
    if calibrate:
        scored = calibrated_scores(
            data, training, scored, id_col, seed, learner, folds, **settings
        )
        _, scored = pick_calibration(scored, data.label, [f"propensity_{m}" for m in METHODS])
    else:
        scored = scored.withColumn("propensity_score", F.col("propensity_uncalibrated"))
    return scored.withColumn("propensity_logit", logit(F.col("propensity_score"))).select(
        id_col,
        treated,
        *[c for c in scored.columns if c.startswith("propensity_")],
        "propensity_logit",
    )


def stacked_propensity(
    frame: DataFrame,
    id_col: str,
    treated: str,
    columns: Sequence[str],
    seed: int,
    folds: int = 3,
    learners: Sequence[str] = ("forest", "gbt"),
    settings: dict[str, dict] | None = None,
    calibration: str | None = None,
) -> DataFrame:
    """Cross-fitted ensemble score for weighting: learners stacked by a logistic regression.

    ``calibration`` ('isotonic' or 'sigmoid') recalibrates the cross-fitted score.
    """
    settings = settings or {}
    data = prepare(frame, treated, columns)
    numbered = data.frame.withColumn("_fold", hash_fold(id_col, seed, folds))

    def fit(task: tuple[int, str]) -> PipelineModel:
        k, learner = task
        return data.fit(numbered.where(F.col("_fold") != k), learner, **settings.get(learner, {}))

    tasks = [(k, learner) for k in range(folds) for learner in learners]
    models = dict(zip(tasks, fit_together(frame.sparkSession, fit, tasks)))
    parts = []
    for k in range(folds):
        held = numbered.where(F.col("_fold") == k)
        for learner in learners:
            held = with_score(models[k, learner], held, f"_{learner}")
        parts.append(held)
    crossed = parts[0]
    for part in parts[1:]:
        crossed = crossed.unionByName(part)
    edges = [f"_{learner}_logit" for learner in learners]
    crossed = crossed.withColumns(
        {e: logit(clipped(F.col(e.removesuffix("_logit")), 1e-3)) for e in edges}
    )
    crossed = cut(crossed.select(id_col, treated, data.label, *edges), "stack")
    stack = Pipeline(
        stages=[
            VectorAssembler(inputCols=edges, outputCol="features"),
            LogisticRegression(featuresCol="features", labelCol=data.label, regParam=1e-4),
        ]
    ).fit(crossed)
    scored = with_score(stack, crossed, "propensity")
    if calibration == "isotonic":
        steps = isotonic.fit(scored, "propensity", data.label)
        scored = scored.withColumn("propensity", steps.value(F.col("propensity")))
    elif calibration == "sigmoid":
        edge = scored.withColumn("_edge", logit(clipped(F.col("propensity"))))
        fitted = Pipeline(
            stages=[
                VectorAssembler(inputCols=["_edge"], outputCol="features"),
                LogisticRegression(featuresCol="features", labelCol=data.label),
            ]
        ).fit(edge)
        scored = with_score(fitted, edge.drop("propensity"), "propensity")
    elif calibration is not None:
        raise ValueError(f"Unknown calibration: {calibration}")
    return scored.select(id_col, treated, "propensity")
