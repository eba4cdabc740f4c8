"""Search for settings: Parzen-estimator proposals over a trial table in Parquet that survives a restart.

Trials run in waves. The first waves draw at random; later ones split the finished trials into the better quarter and the rest,
estimate the density of every setting in both, and take the candidate that is likeliest among the better. A proposal depends on the
seed, its number and the trials of earlier waves alone, so a search that was stopped goes on as if it had not been.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epispan.params import HazardParams
from epispan.session import fit_together, scratch_path

STATES = ("complete", "failed")
FAILURES = (Py4JJavaError, ValueError, ArithmeticError)
TRIAL_DDL = (
    "study string, wave int, trial int, state string, value double, folds array<double>, "
    "learner string, n_iter int, learning_rate double, max_depth int, min_samples_leaf int, reg_param double, error string"
)
SETTINGS = ("n_iter", "learning_rate", "max_depth", "min_samples_leaf", "reg_param")
#: Share of the finished trials that count as good, candidates per proposal, and least kernel width as a share of the range.
GOOD_SHARE = 0.25
CANDIDATES = 24
LEAST_WIDTH = 0.05


@dataclass(frozen=True)
class Range:
    """A setting between two ends, both included, on a linear or logarithmic scale."""

    low: float
    high: float
    whole: bool = False
    log: bool = False

    def place(self, value: float) -> float:
        """Position in the range, 0 to 1."""
        low, high, value = (math.log(v) if self.log else v for v in (self.low, self.high, value))
        return (value - low) / (high - low)

    def value(self, place: float) -> float:
        place = min(max(place, 0.0), 1.0)
        if self.whole:
            return min(int(self.high), int(self.low + place * (self.high - self.low + 1)))
        if self.log:
            return min(max(self.low * math.exp(place * math.log(self.high / self.low)), self.low), self.high)
        return self.low + place * (self.high - self.low)


#: The ranges of the boosting settings; a logistic model has only its penalty.
BOOSTING = {
    "n_iter": Range(50, 250, whole=True),
    "learning_rate": Range(0.01, 0.1, log=True),
    "max_depth": Range(2, 100, whole=True),
    "min_samples_leaf": Range(1, 60, whole=True),
}
LOGISTIC = {"reg_param": Range(1e-5, 1e-1, log=True)}


def space_of(learner: str) -> dict[str, Range]:
    """The settings that the learner listens to."""
    if learner == "logistic":
        return LOGISTIC
    from epispan.operators.propensity import MAX_TREE_DEPTH

    return BOOSTING if learner == "boosted" else BOOSTING | {"max_depth": Range(2, MAX_TREE_DEPTH, whole=True)}


def log_density(place: float, known: Sequence[float]) -> float:
    """Parzen estimate on [0, 1]: a normal kernel around every known place and one broad kernel for the whole range."""
    centres = np.r_[0.5, known]
    width = max(LEAST_WIDTH, 1.0 / (1 + len(known)))
    widths = np.r_[1.0, np.full(len(known), width)]
    kernels = np.exp(-0.5 * ((place - centres) / widths) ** 2) / widths
    return math.log(kernels.mean() + 1e-300)


def propose(space: dict[str, Range], done: Sequence[tuple[dict, float]], draw: random.Random) -> dict[str, float]:
    """Settings of the next trial from finished ones, given with a value that is better the larger it is."""
    ranked = sorted(done, key=lambda d: -d[1])
    n_good = math.ceil(GOOD_SHARE * len(ranked))
    out = {}
    for name, own in space.items():
        good, rest = ([own.place(s[name]) for s, _ in part] for part in (ranked[:n_good], ranked[n_good:]))
        width = max(LEAST_WIDTH, 1.0 / (1 + len(good)))
        places = []
        for _ in range(CANDIDATES):
            centre = draw.choice([None, *good])
            places.append(draw.random() if centre is None else min(max(draw.gauss(centre, width), 0.0), 1.0))
        out[name] = own.value(max(places, key=lambda p: log_density(p, good) - log_density(p, rest)))
    return out


class Trials:
    """The trial table: one Parquet file per wave below ``path``, for any number of studies."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def frame(self) -> DataFrame:
        """All trials; a wave that was written twice counts once."""
        try:
            return self.spark.read.schema(TRIAL_DDL).parquet(f"{self.path}/*/*").dropDuplicates(["study", "trial"])
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], TRIAL_DDL)

    def of(self, study: str) -> list:
        return self.frame().where(F.col("study") == study).orderBy("trial").collect()

    def add(self, study: str, wave: int, rows: list[tuple]) -> None:
        """A wave is a folder of its own, so a repeated write replaces it."""
        self.spark.createDataFrame(rows, TRIAL_DDL).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{study}/wave-{wave:05d}")


def search(
    spark: SparkSession,
    evaluate: Callable[[HazardParams], Sequence[float | None]],
    base: HazardParams,
    n_trials: int,
    study: str,
    seed: int = 0,
    larger_is_better: bool = True,
    path: str | None = None,
    space: dict[str, Range] | None = None,
    n_random: int = 10,
    at_once: int = 4,
    together: Callable[[Sequence[HazardParams]], Sequence[Sequence[float | None]]] | None = None,
) -> tuple[HazardParams, DataFrame]:
    """The best settings of a study and its trials; ``evaluate`` gives the metric of every fold.

    Trials already in the table below ``path`` are not run again. A trial whose evaluation fails is kept with its error; when all
    fail, the last error is raised. Trials without any value never win. ``together`` evaluates the trials of a wave at once; if it
    fails, they are evaluated one by one.
    """
    space = space_of(base.learner) if space is None else space
    table = Trials(spark, path or scratch_path(spark, "trials"))
    known = {r.trial: r for r in table.of(study)}
    sign = 1.0 if larger_is_better else -1.0

    def finished(before: int) -> list[tuple[dict, float]]:
        rows = [known[k] for k in sorted(known) if k < before and known[k].value is not None]
        return [({s: r[s] for s in SETTINGS}, sign * r.value) for r in rows]

    def settings(number: int, wave_start: int) -> HazardParams:
        draw = random.Random(f"{seed}:{study}:{number}")
        done = finished(wave_start)
        if number < n_random or len(done) < 2:
            return replace(base, **{name: own.value(draw.random()) for name, own in space.items()})
        return replace(base, **propose(space, done, draw))

    def fixed(params: HazardParams) -> tuple:
        return (params.learner, *(getattr(params, s) for s in SETTINGS))

    def complete(item: tuple[int, HazardParams], found: Sequence[float | None]) -> tuple:
        number, params = item
        folds = [None if v is None else float(v) for v in found]
        values = [v for v in folds if v is not None]
        mean = sum(values) / len(values) if values else None
        return (study, number // at_once, number, STATES[0], mean, folds, *fixed(params), None)

    def run(item: tuple[int, HazardParams]) -> tuple:
        number, params = item
        try:
            return complete(item, evaluate(params))
        except FAILURES as error:
            return (study, number // at_once, number, STATES[1], None, None, *fixed(params), str(error)[:2000])

    def wave(todo: list[tuple[int, HazardParams]]) -> list[tuple]:
        if together and len(todo) > 1:
            try:
                found = together([params for _, params in todo])
            except FAILURES:  # by one of them or more
                pass
            else:
                return [complete(*pair) for pair in zip(todo, found, strict=True)]
        return fit_together(spark, run, todo, at_once)

    for start in range(0, n_trials, at_once):
        numbers = range(start, min(start + at_once, n_trials))
        todo = [(k, settings(k, start)) for k in numbers if k not in known]
        if todo:
            rows = wave(todo)
            kept = [tuple(known[k]) for k in numbers if k in known]
            table.add(study, start // at_once, kept + rows)
            known |= {r.trial: r for r in table.of(study)}
    chosen = [r for k, r in sorted(known.items()) if k < n_trials]
    with_value = [r for r in chosen if r.value is not None]
    if not with_value:
        raise RuntimeError(f"no trial of {study} has a value: {[r.error for r in chosen if r.error][-1:]}")
    best = max(with_value, key=lambda r: (sign * r.value, -r.trial))
    names = SETTINGS if base.learner != "logistic" else ("reg_param",)
    return replace(base, **{s: best[s] for s in names}), table.frame().where(F.col("study") == study)
