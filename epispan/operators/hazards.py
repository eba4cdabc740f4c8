"""Discrete-time hazards of competing events and of censoring, cross-fitted, for both arms.

The logistic and the boosted model are fitted on one row per person, ``gbt`` on person-period rows with Spark ML.  Predictions stay one row per person with one array
per arm, so later steps need no shuffle over time.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from epispan.operators import metrics as E
from epispan.operators import boosting, multinomial
from epispan.operators.blocks import Blocks, lists, matrix
from epispan.operators.curves import censoring_curve
from epispan.operators.propensity import MAX_TREE_DEPTH, feature_stages, numeric_features
from epispan.operators.sampling import stratified_folds
from epispan.operators.search import search
from epispan.functions.stats import risk_score
from epispan.params import HazardParams
from epispan.session import FITS_AT_ONCE, at_least_parallel, cut, cuts_discarded, fit_together, spread

ARMS = (0, 1)
MAX_TOTAL_HAZARD = 0.999
PERIOD_ROWS_PER_TASK = 5_000_000
PERSONS_PER_TASK = 50_000
CURVE_ROWS = 8192
ENDPOINTS = ("0", "1", "2", "all")
METRIC_FAMILIES = ("c_harrel", "c_uno", "c_antolini", "auc_mean", "ibs")


def haz_name(cause: int, arm: int) -> str:
    return f"haz_{cause}_{arm}"


def cens_name(arm: int) -> str:
    return f"cens_{arm}"


def curve_columns(causes: Sequence[int]) -> list[str]:
    return [haz_name(c, a) for a in ARMS for c in causes] + [cens_name(a) for a in ARMS]


def grid_index(time: str | Column, grid: Sequence[float]) -> Column:
    """Index of the last grid time not after the value; 0 before the grid."""
    time = F.col(time) if isinstance(time, str) else time
    reached = F.size(F.filter(F.array(*[F.lit(float(t)) for t in grid]), lambda t: t <= time))
    return F.greatest(reached - 1, F.lit(0))


def person_periods(frame: DataFrame, time: str, event: str, grid: Sequence[float]) -> DataFrame:
    """One row per person and grid time at risk: event label, censoring label, censoring risk flag."""
    own = frame.withColumn("_own", grid_index(time, grid))
    rows = own.withColumn("t_idx", F.explode(F.sequence(F.lit(0), F.col("_own"))))
    last = F.col("t_idx") == F.col("_own")
    return rows.withColumns(
        {
            "event_label": F.when(last, F.col(event)).otherwise(0).cast("double"),
            "cens_label": (last & (F.col(event) == 0)).cast("double"),
            "cens_risk": ~(last & (F.col(event) > 0)),
        }
    ).drop("_own")


def survival_from_hazard(hazard: np.ndarray) -> np.ndarray:
    return np.cumprod(1.0 - hazard, axis=-1)


def before(curve: np.ndarray) -> np.ndarray:
    """Value just before each time, 1 at the start."""
    return np.concatenate([np.ones_like(curve[..., :1]), curve[..., :-1]], axis=-1)


def incidence(hazards: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Event-free survival and cumulative incidence from hazards with causes on the axis before time."""
    surv = survival_from_hazard(hazards.sum(axis=-2))
    cif = np.cumsum(before(surv)[..., None, :] * hazards, axis=-1)
    return surv, cif


def bounded(hazards: np.ndarray) -> np.ndarray:
    """Scale hazards of all causes down where their sum exceeds the limit."""
    total = hazards.sum(axis=-2, keepdims=True)
    if not (total > MAX_TOTAL_HAZARD).any():
        return hazards
    return hazards * np.where(total > MAX_TOTAL_HAZARD, MAX_TOTAL_HAZARD / np.maximum(total, 1e-300), 1.0)


def bounded_hazards(x: np.ndarray, by_feature: np.ndarray, by_time: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hazards ``(persons, causes, times)`` and the hazard of leaving, from classes staying, each cause, and censoring."""
    eta = (x @ by_feature.T)[:, :, None] + by_time[None]
    share = np.exp(eta - eta.max(axis=1, keepdims=True))
    haz = bounded((share / share.sum(axis=1, keepdims=True))[:, 1:-1, :])
    return haz, share[:, -1] / (share[:, 0] + share[:, -1])


@dataclass(frozen=True)
class LogisticHazards:
    """One multinomial model of staying, each cause, and censoring, with one effect per grid time.

    Censoring is only possible without an event, so its hazard is its share among the event free.
    """

    features: PipelineModel
    treated_at: int
    causes: tuple[int, ...]
    by_feature: np.ndarray  # classes x features
    by_time: np.ndarray  # classes x times

    def shares(self, arm: float) -> np.ndarray:
        """Chances ``(classes, times)`` of a person of the arm whose other features are all zero."""
        eta = self.by_time + arm * self.by_feature[:, self.treated_at][:, None]
        share = np.exp(eta - eta.max(axis=0))
        return share / share.sum(axis=0)

    def predict(self, frame: DataFrame, keep: Sequence[str]) -> DataFrame:
        rows = self.features.transform(frame).select(*keep, vector_to_array("features").alias("_x"))
        names = curve_columns(self.causes)
        fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields if f.name != "_x"}
        schema = ", ".join([f"{c} {t}" for c, t in fields.items()] + [f"{c} array<double>" for c in names])
        by_feature, by_time = self.by_feature, self.by_time
        treated_at, causes, kept = self.treated_at, self.causes, list(keep)

        def work(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch.column("_x")).copy()
                curves = []
                for arm in ARMS:
                    x[:, treated_at] = arm
                    haz, leave = bounded_hazards(x, by_feature, by_time)
                    curves.append(([lists(haz[:, k]) for k in range(len(causes))], lists(survival_from_hazard(leave))))
                columns = [c for haz, _ in curves for c in haz] + [staying for _, staying in curves]
                yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *columns], names=[*kept, *names])

        return rows.mapInArrow(work, schema)


@dataclass(frozen=True)
class TreeHazards:
    """Boosted trees per cause and for censoring, with the grid time as a feature."""

    features: PipelineModel
    models: tuple[tuple[str, GBTClassifier], ...]
    treated: str
    causes: tuple[int, ...]
    grid: tuple[float, ...]

    def predict(self, frame: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Rows of one person stay in one partition, so collecting the arrays needs one shuffle."""
        id_col = keep[0]
        times = F.array(*[F.struct(F.lit(i).alias("t_idx"), F.lit(float(t)).alias("grid_t")) for i, t in enumerate(self.grid)])
        rows = frame.repartition(F.col(id_col)).withColumn("_shown", F.col(self.treated))
        rows = rows.withColumn("_arm", F.explode(F.array(*[F.lit(a) for a in ARMS])))
        rows = rows.withColumn(self.treated, F.col("_arm").cast("double")).select("*", F.inline(times))
        rows = self.features.transform(rows).select(id_col, "_arm", "t_idx", "features")
        for name, model in self.models:
            rows = model.transform(rows).withColumn(f"_p_{name}", vector_to_array("probability")[1])
            rows = rows.select(id_col, "_arm", "t_idx", "features", *[c for c in rows.columns if c.startswith("_p_")])
        values = [f"_p_{name}" for name, _ in self.models]
        lists = []
        for arm in ARMS:
            entry = F.when(F.col("_arm") == arm, F.struct("t_idx", *values))
            lists.append(F.array_sort(F.collect_list(entry)).alias(f"_a{arm}"))
        packed = rows.groupBy(id_col).agg(*lists)
        arrays = []
        for arm in ARMS:
            haz = [F.col(f"_a{arm}._p_{c}") for c in self.causes]
            total = F.zip_with(haz[0], haz[0], lambda a, _: F.lit(0.0))
            for h in haz:
                total = F.zip_with(total, h, lambda a, b: a + b)
            scale = F.transform(total, lambda s: F.least(F.lit(1.0), F.lit(MAX_TOTAL_HAZARD) / s))
            for cause, h in zip(self.causes, haz):
                arrays.append(F.zip_with(h, scale, lambda a, b: a * b).alias(haz_name(cause, arm)))
            arrays.append(F.col(f"_a{arm}._p_cens").alias(f"_leave_{arm}"))
        packed = packed.select(id_col, *arrays)
        packed = packed.withColumns({cens_name(a): keep_product(F.col(f"_leave_{a}")) for a in ARMS})
        return frame.select(*keep).join(packed.drop(*[f"_leave_{a}" for a in ARMS]), id_col)


@dataclass(frozen=True)
class BoostedHazards:
    """Boosted incidences, turned into hazards of the grid periods."""

    columns: tuple[str, ...]
    treated_at: int
    causes: tuple[int, ...]
    model: boosting.Boosted

    def predict(self, frame: DataFrame, keep: Sequence[str]) -> DataFrame:
        rows = frame.select(*keep, F.array(*[F.col(f"`{c}`") for c in self.columns]).alias("_x"))
        names, kept = curve_columns(self.causes), list(keep)

        def work(batches):
            for pdf in batches:
                for start in range(0, len(pdf), CURVE_ROWS):
                    part = pdf.iloc[start : start + CURVE_ROWS]
                    out = part[kept].copy()
                    for name, curves in self.both_arms(part["_x"]).items():
                        out[name] = curves
                    yield out[[*kept, *names]]

        return rows.mapInPandas(work, curve_schema(rows, names))

    def both_arms(self, features: pd.Series) -> dict[str, list[np.ndarray]]:
        x = np.array([[np.nan if v is None else v for v in row] for row in features], float)
        out = {}
        for arm in ARMS:
            x[:, self.treated_at] = arm
            cif, staying = self.model.curves(x)
            earlier = before(1.0 - cif.sum(axis=1))
            step = np.diff(cif, axis=2, prepend=0.0)
            haz = bounded(step / np.maximum(earlier, 1e-12)[:, None, :])
            for k, cause in enumerate(self.causes):
                out[haz_name(cause, arm)] = list(haz[:, k, :])
            out[cens_name(arm)] = list(staying)
        return out


def curve_schema(rows: DataFrame, names: Sequence[str]) -> str:
    """The schema of rows whose features ``_x`` give way to curves."""
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields if f.name != "_x"}
    return ", ".join([f"{c} {t}" for c, t in fields.items()] + [f"{c} array<double>" for c in names])


def predict_runs(models: Sequence[Sequence[BoostedHazards]], dealt: DataFrame, persons: int, treated: str, keep: Sequence[str]) -> DataFrame:
    """Curves of ``models[run][fold]`` for the persons of every fold: one row per run and person, tasks of one model each."""
    any_model, folds = models[0][0], len(models[0])
    names, kept = curve_columns(any_model.causes), ["run", *keep]
    chunks = max(1, math.ceil(persons / folds / PERSONS_PER_TASK))
    features = F.array(*[F.col(f"`{c}`").cast("double") for c in any_model.columns]).alias("_x")
    rows = dealt.select(*keep, features, F.explode(F.array(*[F.lit(k) for k in range(len(models))])).alias("run"))
    chunk = F.pmod(F.xxhash64(keep[0]), F.lit(chunks)).cast("int")
    place = (F.col("run") * folds + F.col("fold")) * chunks + chunk
    rows = rows.select(*kept, "_x").repartitionById(len(models) * folds * chunks, place)
    packed = {(run, k): pickle.dumps(model) for run, own in enumerate(models) for k, model in enumerate(own)}

    def work(batches):
        known: dict = {}
        for pdf in batches:
            for at, same in pdf.groupby(["run", "fold"], sort=False):
                if at not in known:
                    known = {at: pickle.loads(packed[at])}
                for start in range(0, len(same), CURVE_ROWS):
                    part = same.iloc[start : start + CURVE_ROWS]
                    out = part[kept].copy()
                    for name, curves in known[at].both_arms(part["_x"]).items():
                        out[name] = curves
                    yield out[[*kept, *names]]

    return rows.mapInPandas(work, curve_schema(rows, names))


@F.pandas_udf(ArrayType(DoubleType()))
def keep_product(leave: pd.Series) -> pd.Series:
    """Survival curve of a hazard curve."""
    return pd.Series(list(survival_from_hazard(np.stack(leave.to_numpy())))) if len(leave) else leave


def fit_hazards(
    frame: DataFrame,
    columns: Sequence[str],
    treated: str,
    time: str,
    event: str,
    grid: Sequence[float],
    causes: Sequence[int] = (1, 2),
    params: HazardParams = HazardParams(),
    seed: int = 0,
    id_col: str | None = None,
) -> LogisticHazards | TreeHazards | BoostedHazards:
    """Fit hazards of the causes and of censoring on all rows of the frame.

    The boosted learner draws a time per person and round by ``id_col``, so that a repeated fit is the same.
    """
    if params.learner == "gbt" and params.max_depth > MAX_TREE_DEPTH:
        raise ValueError(f"max_depth {params.max_depth} is above the learner's limit of {MAX_TREE_DEPTH}")
    names = [*columns, treated]
    if params.learner == "boosted":
        written = boosted_training(frame, columns, treated, time, event, grid, causes, seed, id_col)
        return BoostedHazards(tuple(names), len(names) - 1, tuple(causes), written.fitted(params))
    if params.learner == "logistic":
        return logistic_training(frame, columns, treated, time, event, grid, causes).fitted(params)
    cast, flagged = numeric_features(frame, names)
    # a person stands for up to one period per grid time, so tasks take few persons each
    spread_rows = spread(cast, frame.count(), max(1, PERIOD_ROWS_PER_TASK // len(grid)))
    if params.learner == "gbt":
        periods = person_periods(spread_rows, time, event, grid)
        timed = periods.withColumn("grid_t", F.get(F.array(*[F.lit(float(t)) for t in grid]), F.col("t_idx")))
        features = Pipeline(stages=feature_stages([*names, "grid_t"], flagged)).fit(timed)
        rows = features.transform(timed).select("features", "event_label", "cens_label", "cens_risk").persist()
        settings = {
            "maxIter": params.n_iter,
            "stepSize": params.learning_rate,
            "maxDepth": params.max_depth,
            "minInstancesPerNode": params.min_samples_leaf,
            "seed": seed,
            "featuresCol": "features",
            "labelCol": "_y",
        }
        models = [
            (str(c), GBTClassifier(**settings).fit(rows.withColumn("_y", (F.col("event_label") == c).cast("double"))))
            for c in causes
        ]
        cens_rows = rows.where("cens_risk").withColumn("_y", F.col("cens_label"))
        models.append(("cens", GBTClassifier(**settings).fit(cens_rows)))
        rows.unpersist()
        return TreeHazards(features, tuple(models), treated, tuple(causes), tuple(float(t) for t in grid))
    raise ValueError(f"Unknown learner: {params.learner}")


def boosted_training(
    frame: DataFrame, columns: Sequence[str], treated: str, time: str, event: str, grid: Sequence[float],
    causes: Sequence[int] = (1, 2), seed: int = 0, id_col: str | None = None,
) -> boosting.Training:
    """The rows of ``fit_hazards`` with the boosted learner; missing values have a bin of their own."""
    names = [*columns, treated]
    codes = F.create_map(*[F.lit(v) for k, c in enumerate(causes) for v in (c, k + 1)])
    cast = frame.withColumns({c: F.col(f"`{c}`").cast("double") for c in names})
    cast = cast.withColumn("_state", F.coalesce(codes[F.col(event)], F.lit(0)))
    rows = spread(cast, frame.count(), PERSONS_PER_TASK)
    return boosting.training(rows, id_col or F.monotonically_increasing_id(), names, time, "_state", grid, len(causes), seed)


@dataclass(frozen=True)
class LogisticTraining:
    """Rows of one training part, written once for fits of any settings."""

    features: PipelineModel
    rows: Blocks
    width: int
    treated_at: int
    times: int
    causes: tuple[int, ...]

    def fitted(self, params: HazardParams) -> LogisticHazards:
        found = multinomial.fit(
            self.rows, self.width, self.times, len(self.causes) + 2, params.reg_param, params.logistic_iter, params.logistic_tol
        )
        return LogisticHazards(self.features, self.treated_at, self.causes, found.by_feature, found.by_time)


def logistic_training(
    frame: DataFrame, columns: Sequence[str], treated: str, time: str, event: str, grid: Sequence[float], causes: Sequence[int] = (1, 2)
) -> LogisticTraining:
    """The rows of ``fit_hazards`` with the logistic learner."""
    names = [*columns, treated]
    cast, flagged = numeric_features(frame, names)
    spread_rows = spread(cast, frame.count(), max(1, PERIOD_ROWS_PER_TASK // len(grid)))
    features, rows = logistic_rows(cast, spread_rows, names, flagged, time, event, grid, causes)
    return LogisticTraining(features, rows, len(names) + len(flagged), len(names) - 1, len(grid), tuple(causes))


def logistic_rows(
    cast: DataFrame, spread_rows: DataFrame, names: Sequence[str], flagged: Sequence[str],
    time: str, event: str, grid: Sequence[float], causes: Sequence[int],
) -> tuple[PipelineModel, Blocks]:
    """The feature pipeline and one row of numbers per person: last period, class then, features."""
    features = Pipeline(stages=feature_stages(names, flagged)).fit(cast)
    leaving = F.when(F.col(event) == 0, F.lit(len(causes) + 1))
    for k, cause in enumerate(causes):
        leaving = leaving.when(F.col(event) == cause, F.lit(k + 1))
    row = F.concat(F.array(grid_index(time, grid).cast("double"), leaving.cast("double")), vector_to_array("features"))
    return features, Blocks.written(features.transform(spread_rows).select(row.alias("row")), "row")


def fit_hazards_without(
    frame: DataFrame,
    columns: Sequence[str],
    treated: str,
    time: str,
    event: str,
    grid: Sequence[float],
    left_out: Sequence[Sequence[str]],
    causes: Sequence[int] = (1, 2),
    params: HazardParams = HazardParams(),
) -> list[LogisticHazards]:
    """The logistic hazards on all columns, then one model for each group of columns left out.

    All models share the rows, which are written once, and the passes over them.
    """
    if params.learner != "logistic":
        raise ValueError("columns are left out of the logistic hazards only")
    names = [*columns, treated]
    cast, flagged = numeric_features(frame, names)
    spread_rows = spread(cast, frame.count(), max(1, PERIOD_ROWS_PER_TASK // len(grid)))
    features, rows = logistic_rows(cast, spread_rows, names, flagged, time, event, grid, causes)
    vector = [*names, *flagged]  # a column's missing flag goes with it
    places = [[k for k, c in enumerate(vector) if c in group] for group in left_out]
    fits = multinomial.fit_without(
        rows, len(vector), len(grid), len(causes) + 2, params.reg_param, places, params.logistic_iter, params.logistic_tol
    )
    return [LogisticHazards(features, len(names) - 1, tuple(causes), f.by_feature, f.by_time) for f in fits]


def predict_hazards(
    model: LogisticHazards | TreeHazards | BoostedHazards,
    frame: DataFrame,
    columns: Sequence[str],
    treated: str,
    keep: Sequence[str],
) -> DataFrame:
    """Hazard and censoring curves of both arms for new rows, one row per person."""
    flags = [
        c.removesuffix("_missing")
        for stage in (() if isinstance(model, BoostedHazards) else model.features.stages)
        for c in (stage.getInputCols() if stage.hasParam("inputCols") else [])
        if c.endswith("_missing")
    ]
    shown = frame.withColumn("_treated", F.col(treated))
    cast = shown.withColumns({c: F.col(f"`{c}`").cast("double") for c in [*columns, treated]})
    cast = cast.withColumns({f"{c}_missing": F.col(f"`{c}`").isNull().cast("double") for c in flags})
    shown_keep = ["_treated" if c == treated else c for c in keep]
    return model.predict(cast, shown_keep).withColumnRenamed("_treated", treated)


def cross_fit(
    frame: DataFrame,
    id_col: str,
    columns: Sequence[str],
    treated: str,
    time: str,
    event: str,
    grid: Sequence[float],
    folds: int = 5,
    causes: Sequence[int] = (1, 2),
    params: HazardParams = HazardParams(),
    seed: int = 0,
    choose: Callable[[DataFrame, int], HazardParams] | None = None,
) -> DataFrame:
    """Curves of both arms for every person from models that never saw the person's fold.

    ``choose`` may pick the settings of a fold from its training rows.
    """
    dealt = cut(stratified_folds(frame, id_col, event, folds, seed), "folds", by=("fold",))

    def model(k: int) -> LogisticHazards | TreeHazards | BoostedHazards:
        train = dealt.where(F.col("fold") != k)
        settings = choose(train, k) if choose else params
        return fit_hazards(train, columns, treated, time, event, grid, causes, settings, seed, id_col)

    # tuning inside a fold already runs its own fits side by side
    return held_curves(dealt, dealt.count(), [id_col, "fold", treated, time, event], columns, treated, folds, model, 1 if choose else FITS_AT_ONCE)


def held_curves(
    dealt: DataFrame, persons: int, keep: Sequence[str], columns: Sequence[str], treated: str, folds: int, model: Callable, at_once: int = FITS_AT_ONCE
) -> DataFrame:
    """Curves of every fold's persons from ``model(fold)``."""

    def predicted(k: int) -> DataFrame:
        own = model(k)
        held = at_least_parallel(dealt.where(F.col("fold") == k), persons // folds, PERSONS_PER_TASK)
        return predict_hazards(own, held, columns, treated, keep)

    parts = fit_together(dealt.sparkSession, predicted, range(folds), at_once)
    return cut(reduce(DataFrame.unionByName, parts), "crossfit")


def cross_fit_without(
    frame: DataFrame,
    id_col: str,
    columns: Sequence[str],
    treated: str,
    time: str,
    event: str,
    grid: Sequence[float],
    left_out: Sequence[Sequence[str]],
    folds: int = 5,
    causes: Sequence[int] = (1, 2),
    params: HazardParams = HazardParams(),
    seed: int = 0,
) -> list[DataFrame]:
    """Cross-fitted curves on all columns, then for each group of columns left out; folds and passes are shared."""
    dealt = cut(stratified_folds(frame, id_col, event, folds, seed), "folds", by=("fold",))
    persons = dealt.count()
    keep = [id_col, "fold", treated, time, event]

    def fit(k: int) -> list[LogisticHazards]:
        train = dealt.where(F.col("fold") != k)
        return fit_hazards_without(train, columns, treated, time, event, grid, left_out, causes, params)

    models = fit_together(frame.sparkSession, fit, range(folds))

    def predicted(run: int) -> DataFrame:
        parts = []
        for k in range(folds):
            held = at_least_parallel(dealt.where(F.col("fold") == k), persons // folds, PERSONS_PER_TASK)
            parts.append(predict_hazards(models[k][run], held, columns, treated, keep))
        return cut(reduce(DataFrame.unionByName, parts), "crossfit")

    return fit_together(frame.sparkSession, predicted, range(1 + len(left_out)))


def tune(
    frame: DataFrame,
    id_col: str,
    columns: Sequence[str],
    treated: str,
    time: str,
    event: str,
    grid: Sequence[float],
    base: HazardParams,
    metric: str,
    n_trials: int = 100,
    folds: int = 3,
    seed: int = 0,
    study: str = "study",
    path: str | None = None,
    at_once: int = 4,
) -> tuple[HazardParams, DataFrame]:
    """The settings with the best mean metric over inner folds, and the table of all trials.

    Proposals learn from the finished trials of earlier waves; ``at_once`` trials are a wave. With a ``path`` the table is kept there, and a study found in it goes on where it ended.
    The inner folds, and the rows of their logistic or boosted fits, are written once for all trials.
    """
    spark = frame.sparkSession
    dealt = cut(stratified_folds(frame, id_col, event, folds, seed), "folds", by=("fold",))
    persons, keep = dealt.count(), [id_col, "fold", treated, time, event]
    names = (columns, treated, time, event, grid)
    trains = [dealt.where(F.col("fold") != k) for k in range(folds)]
    written = []
    if base.learner == "logistic":
        written = fit_together(spark, lambda t: logistic_training(t, *names), trains)
    elif base.learner == "boosted":
        written = fit_together(spark, lambda t: boosted_training(t, *names, seed=seed, id_col=id_col), trains)

    def evaluate(params: HazardParams) -> list[float | None]:
        """The metric of every inner fold for one choice of settings."""

        def model(k: int) -> LogisticHazards | TreeHazards | BoostedHazards:
            return written[k].fitted(params) if written else fit_hazards(trains[k], *names, params=params, seed=seed, id_col=id_col)

        crossed = held_curves(dealt, persons, keep, columns, treated, folds, model)
        panel = metric_panel(crossed, treated, time, event, grid, only=metric)
        return [r["value"] for r in panel.orderBy("fold").collect()]

    def evaluate_boosted(settings: Sequence[HazardParams]) -> list[list[float | None]]:
        """The same for every choice of a wave: fits side by side, curves and metrics of all in one plan."""
        own, runs = (*columns, treated), range(len(settings))
        fits = boosting.fit_many(written, [(k, params) for params in settings for k in range(folds)])
        models = [[BoostedHazards(own, len(own) - 1, (1, 2), fits[run * folds + k]) for k in range(folds)] for run in runs]
        with cuts_discarded(spark):
            crossed = predict_runs(models, dealt, persons, treated, keep)
            known = dealt.select(*keep, F.explode(F.array(*[F.lit(run) for run in runs])).alias("run"))
            panel = metric_panel(crossed, treated, time, event, grid, only=metric, runs=("run",), known=known)
            values = panel.orderBy("run", "fold").collect()
        return [[r["value"] for r in values if r["run"] == run] for run in runs]

    larger = not metric.startswith("ibs")
    if base.learner == "boosted":
        one = lambda params: evaluate_boosted([params])[0]
        return search(spark, one, base, n_trials, study, seed, larger, path, at_once=at_once, together=evaluate_boosted)
    return search(spark, evaluate, base, n_trials, study, seed, larger, path, at_once=at_once)


def factual_curves(crossed: DataFrame, treated: str, keep: Sequence[str], causes: Sequence[int] = (1, 2)) -> DataFrame:
    """Curves under each person's own exposure: event free, staying, and free of each cause."""
    names = ["pred_all", "pred_0", *[f"pred_{c}" for c in causes]]
    fields = {f.name: f.dataType.simpleString() for f in crossed.schema.fields}
    schema = ", ".join([f"{c} {fields[c]}" for c in keep] + [f"{c} array<double>" for c in names])
    own = {
        f"_h{c}": F.when(F.col(treated), F.col(haz_name(c, 1))).otherwise(F.col(haz_name(c, 0)))
        for c in causes
    }
    own["_g"] = F.when(F.col(treated), F.col(cens_name(1))).otherwise(F.col(cens_name(0)))
    rows = crossed.withColumns(own).select(*keep, *own)
    kept, codes = list(keep), list(causes)

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            haz = np.stack([matrix(batch.column(f"_h{c}")) for c in codes], axis=1)
            surv, cif = incidence(haz)
            curves = [lists(surv), batch.column("_g"), *[lists(1.0 - cif[:, k, :]) for k in range(len(codes))]]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *curves], names=[*kept, *names])

    return rows.mapInArrow(work, schema)


def _training_counts(frame: DataFrame, folds: Sequence[int], runs: Sequence[str] = ()) -> DataFrame:
    """Daily counts of each fold's training part, from counts per fold and day."""
    daily = frame.groupBy(*runs, "fold", "endpoint", "t", "hit").agg(F.count(F.lit(1)).alias("n"))
    others = F.filter(F.array(*[F.lit(f) for f in folds]), lambda f: f != F.col("fold"))
    spread = daily.select(*runs, F.explode(others).alias("fold"), "endpoint", "t", "hit", "n")
    return spread.groupBy(*runs, "fold", "endpoint", "t", "hit").agg(F.sum("n").alias("n"))


def _panel_rows(crossed, treated, time, event, grid, causes, only, runs=(), known=None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Persons per endpoint that the metrics are about, training censoring at their times and as a curve, and evaluation times."""
    keep = [*runs, "fold", treated, time, event]
    curves = factual_curves(crossed, treated, keep, causes)
    endpoints = [e for e in ENDPOINTS if only is None or e == only]
    flags = {"0": F.col(event) == 0, "all": F.col(event) > 0}
    flags |= {str(c): F.col(event) == c for c in causes}
    specs = F.array(
        *[
            F.struct(F.lit(e).alias("endpoint"), flags[e].alias("hit"), F.col(f"pred_{e}").alias("curve"))
            for e in endpoints
        ]
    )
    rows = curves.select(*runs, "fold", F.col(time).alias("t"), F.inline(specs))
    rows = rows.withColumn("score", risk_score(F.col("curve")))
    by = [*runs, "fold", "endpoint"]

    known = crossed if known is None else known
    folds = [r["fold"] for r in known.select("fold").distinct().collect()]
    outcomes = known.select(*runs, "fold", F.col(time).alias("t"), F.inline(F.array(*[F.struct(F.lit(e).alias("endpoint"), flags[e].alias("hit")) for e in endpoints])))
    # counts per day, read by every metric: without the cut, each of them would work out all curves again
    train = cut(_training_counts(outcomes, folds, runs), "training-counts")
    longest = train.groupBy(*by).agg(F.max("t").alias("_longest"))
    rows = rows.join(F.broadcast(longest), by).where(F.col("t") < F.col("_longest")).drop("_longest")
    rows = cut(rows, "panel")
    curve = weighted_censoring(train, by)
    own = E.censoring_at_own_time(rows, curve, "t", by)
    span = rows.groupBy(*by).agg(F.min("t").alias("_first"), F.max("t").alias("_last"))
    times = F.array(*[F.lit(float(t)) for t in grid])
    inside = F.filter(times, lambda t: (t > F.col("_first")) & (t < F.col("_last")))
    span = span.withColumn("_times", inside)
    return rows, own, curve, span


def auc_curves(
    crossed: DataFrame, treated: str, time: str, event: str, grid: Sequence[float], causes: Sequence[int] = (1, 2)
) -> DataFrame:
    """``(fold, endpoint, t, auc)``: the AUC of every fold and endpoint at each grid time inside the fold's follow-up."""
    rows, own, _, span = _panel_rows(crossed, treated, time, event, grid, causes, None)
    return _panel_auc(rows, ["fold", "endpoint"], grid, own, span)[0]


def metric_panel(
    crossed: DataFrame,
    treated: str,
    time: str,
    event: str,
    grid: Sequence[float],
    only: str | None = None,
    causes: Sequence[int] = (1, 2),
    families: Sequence[str] = METRIC_FAMILIES,
    runs: Sequence[str] = (),
    known: DataFrame | None = None,
) -> DataFrame:
    """Fold metrics ``(fold, metric, endpoint, value)`` for censoring, both events and overall survival.

    Persons followed beyond the training part of their fold are left out; AUC and the inverse
    weights use grid times strictly inside the fold's follow-up.  ``only`` names one metric with
    its endpoint suffix, e.g. ``c_antolini_all``; ``families`` limits the metrics of a full panel.  Columns named in ``runs``
    tell cross-fits apart, each of which has its own metrics.  ``known`` has the rows without curves, so that curves which are
    not written yet are worked out once.
    """
    wanted = None if only is None else only.rsplit("_", 1)
    if wanted and (wanted[0] not in METRIC_FAMILIES or wanted[1] not in ENDPOINTS):
        raise ValueError(f"Unknown metric: {only}")
    rows, own, curve, span = _panel_rows(crossed, treated, time, event, grid, causes, wanted and wanted[1], runs, known)
    by = [*runs, "fold", "endpoint"]
    tau = span.select(*by, F.array_max("_times").alias("_tau"))

    out = []
    score = F.col("score")

    def add(name: str, frame: DataFrame, value: str) -> None:
        out.append(frame.select(*runs, "fold", F.lit(name).alias("metric"), "endpoint", F.col(value).alias("value")))

    def needed(name: str) -> bool:
        return name in families if wanted is None else wanted[0] == name

    if needed("c_harrel"):
        add("c_harrel", E.concordance(rows, by, score, "t", "hit"), "c_index")
    if needed("c_uno"):
        weights = E.uno_weights(own.join(F.broadcast(tau), by), F.col("_tau"))
        add("c_uno", E.concordance(rows, by, score, "t", "hit", weights), "c_index")
    if needed("c_antolini"):
        add("c_antolini", E.antolini_concordance(rows, by, "curve", "t", "hit", grid), "c_index")
    if needed("auc_mean"):
        add("auc_mean", E.mean_auc(*_panel_auc(rows, by, grid, own, span), by), "auc_mean")
    if needed("ibs"):
        add("ibs", E.integrated_brier(E.brier_over_time(rows, by, "curve", "t", "hit", grid, curve), by), "ibs")
    panel = out[0]
    for part in out[1:]:
        panel = panel.unionByName(part)
    return panel


def _panel_auc(rows, by, grid, own, span) -> tuple[DataFrame, DataFrame]:
    auc = E.auc_over_time(rows, by, F.col("score"), "t", "hit", grid, own)
    auc = auc.join(F.broadcast(span), by).where(
        (F.col("t") > F.col("_first")) & (F.col("t") < F.col("_last"))
    ).select(*by, "t", "auc")
    coded = rows.withColumn("hit", F.col("hit").cast("int"))
    return auc, E.kaplan_meier(coded, "t", "hit", by).select(*by, "t", "surv")


def weighted_censoring(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Censoring survival per group from daily counts ``(by, t, hit, n)``."""
    daily = counts.groupBy(*by, "t").agg(
        F.sum("n").alias("leaving"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("n_events")
    )
    return censoring_curve(daily, by)
