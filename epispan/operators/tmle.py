"""Targeted estimates of counterfactual risks with competing events.

Each person is one row with the hazard and censoring curves of both arms.  A targeting step moves
the hazards along the efficient influence direction; whether it helps is read off sums of the
influence values, so every iteration is one pass over the persons that returns a few numbers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispan.functions import stats
from epispan.operators.blocks import lists, matrix, nullable
from epispan.operators.hazards import (
    ARMS,
    PERSONS_PER_TASK,
    before,
    bounded,
    cens_name,
    curve_columns,
    grid_index,
    haz_name,
    incidence,
)
from epispan.session import at_least_parallel, cut

Z_95 = 1.959963984540054
LADDER = (1.0, 0.5, 0.25, 0.1, 0.02)
CUT_EVERY = 5
RIDGE = 1e-9
MIN_SURVIVAL = 1e-8


@dataclass(frozen=True)
class Target:
    """Column names, time grid and target times of one targeting problem."""

    id_col: str
    treated: str
    event: str
    propensity: str
    grid: tuple[float, ...]
    times: tuple[float, ...]
    causes: tuple[int, ...] = (1, 2)
    bound: float = 0.02

    @property
    def at(self) -> list[int]:
        """Grid positions of the target times."""
        return [self.grid.index(t) for t in self.times]

    @property
    def shape(self) -> tuple[int, int, int]:
        return (len(ARMS), len(self.causes), len(self.times))


def targeting_frame(crossed: DataFrame, propensity: DataFrame, target: Target, time: str) -> DataFrame:
    """Curves of both arms joined with the propensity, and each person's own grid position."""
    keep = [target.id_col, target.treated, target.event]
    curves = crossed.select(
        *keep, grid_index(time, target.grid).alias("own"), *curve_columns(target.causes)
    )
    joined = curves.join(propensity.select(target.id_col, target.propensity), target.id_col)
    return at_least_parallel(joined, crossed.count(), PERSONS_PER_TASK)


class Block:
    """Arrays of one batch of persons: axes person, arm, cause, time."""

    def __init__(self, batch: pa.RecordBatch | pd.DataFrame, target: Target):
        if isinstance(batch, pd.DataFrame):
            batch = pa.RecordBatch.from_pandas(batch, preserve_index=False)

        def numbers(name: str) -> np.ndarray:
            return batch.column(name).to_numpy(zero_copy_only=False)

        self.target = target
        per_arm = [np.stack([matrix(batch.column(haz_name(c, a))) for c in target.causes], axis=1) for a in ARMS]
        self.haz = np.stack(per_arm, axis=1)
        cens = np.stack([matrix(batch.column(cens_name(a))) for a in ARMS], axis=1)
        p = numbers(target.propensity).astype("float64")
        floor = target.bound
        propensity = np.stack([1 - p, p], axis=1)
        self.weight = 1.0 / (
            np.maximum(propensity, floor)[:, :, None] * np.maximum(before(cens), floor)
        )
        exposed = numbers(target.treated).astype(bool)
        self.factual = np.stack([~exposed, exposed], axis=1)
        own = numbers("own")
        steps = np.arange(self.haz.shape[-1])
        at_risk = steps[None, :] <= own[:, None]
        code = numbers(target.event)
        jump = np.stack(
            [(steps[None, :] == own[:, None]) & (code == c)[:, None] for c in target.causes], axis=1
        )
        weight = self.weight * self.factual[:, :, None]
        self.jump = jump[:, None] * weight[:, :, None, :]
        self.at_risk = (at_risk[:, None] * weight)[:, :, None, :]
        self.until = (steps[:, None] <= np.array(target.at)).astype("float64")

    def slope(self, direction: np.ndarray) -> np.ndarray:
        """Rate at which the logarithms of the hazards move along the influence direction."""
        surv, cif = incidence(self.haz)
        alive = np.maximum(surv, MIN_SURVIVAL)
        reach = np.zeros((*direction.shape[:2], self.haz.shape[-1]))
        reach[:, :, self.target.at] = direction
        # sums over target times not before s, of the direction and of direction times incidence
        later = np.cumsum(reach[:, :, ::-1], axis=-1)[:, :, ::-1]
        later_cif = np.cumsum((reach[None] * cif)[..., ::-1], axis=-1)[..., ::-1]
        drain = ((later_cif - cif * later[None]) / alive[:, :, None, :]).sum(axis=2, keepdims=True)
        return self.weight[:, :, None, :] * (later[None] - drain)

    def moved(self, direction: np.ndarray, size: float) -> np.ndarray:
        """Hazards after a step of the given size along the influence direction."""
        return self.along(self.slope(direction), size)

    def along(self, slope: np.ndarray, size: float) -> np.ndarray:
        return bounded(self.haz * np.exp(np.clip(size * slope, -20, 20)))

    def influence(self, haz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Martingale part and incidence at the target times: axes person, arm, cause, target."""
        surv, cif = incidence(haz)
        alive = np.maximum(surv, MIN_SURVIVAL)
        gap = self.jump - self.at_risk * haz
        total = (gap.sum(axis=2) / alive)[:, :, None, :]
        now = cif[..., self.target.at]
        return self.summed(gap) - now * self.summed(total) + self.summed(cif * total), now

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Sums up to every target time."""
        sums = values.reshape(-1, values.shape[-1]) @ self.until
        return sums.reshape(*values.shape[:-1], -1)


def _blocks(batches, target: Target, steps: Sequence[tuple[np.ndarray, float]]):
    for batch in batches:
        if not batch.num_rows:
            continue
        block = Block(batch, target)
        for direction, size in steps:
            block.haz = block.moved(direction, size)
        yield batch, block


@dataclass(frozen=True)
class Score:
    """Mean of the influence values' martingale part, spread, plug-in risks, and second moments."""

    mean: np.ndarray
    sd: np.ndarray
    risk: np.ndarray
    moments: np.ndarray  # per arm, the mean outer product of the martingale parts
    n: float

    @property
    def size(self) -> float:
        """Length of the mean influence values in units of their spread."""
        return float(np.sqrt(((self.mean / np.maximum(self.sd, 1e-300)) ** 2).sum()))

    def solved(self, tolerance: float | None = None) -> bool:
        """Whether the mean influence values are small against their standard errors, or at most ``tolerance`` spreads."""
        limit = self.sd / (math.sqrt(self.n) * max(math.log(self.n), 1.0)) if tolerance is None else tolerance * self.sd
        return bool((np.abs(self.mean) <= limit).all())

    def direction(self) -> np.ndarray:
        """Step that cancels the mean influence values to first order.

        Along a direction the means fall at the rate of the second moments of the martingale
        parts, which do not mix the arms.
        """
        out = np.zeros_like(self.mean)
        for arm, block in enumerate(self.moments):
            ridge = RIDGE * np.trace(block) / len(block) * np.eye(len(block))
            out[arm] = np.linalg.lstsq(block + ridge, self.mean[arm].ravel(), rcond=1e-10)[0].reshape(
                self.mean[arm].shape
            )
        return out


def scores(
    frame: DataFrame,
    target: Target,
    steps: Sequence[tuple[np.ndarray, float]],
    direction: np.ndarray | None = None,
    sizes: Sequence[float] = (0.0,),
) -> list[Score]:
    """Score of every candidate step size, in one pass; each partition returns only sums."""
    flat = int(np.prod(target.shape))
    arms, each = target.shape[0], flat // target.shape[0]
    width = 4 * flat + arms * each * each

    def sums(batches):
        total = np.zeros((len(sizes), width))
        n = 0
        for batch, block in _blocks(batches, target, steps):
            persons = batch.num_rows
            n += persons
            slope = None if direction is None else block.slope(direction)
            for k, size in enumerate(sizes):
                haz = block.haz if slope is None else block.along(slope, size)
                m, f = block.influence(haz)
                u = m + f
                parts = [x.reshape(persons, flat).sum(axis=0) for x in (m, f, u, u * u)]
                by_arm = m.reshape(persons, arms, each)
                parts += [(by_arm[:, a].T @ by_arm[:, a]).ravel() for a in range(arms)]
                total[k] += np.concatenate(parts)
        if n:
            for k in range(len(sizes)):
                columns = [np.full(width, k, np.int32), np.full(width, float(n)), np.arange(width, dtype=np.int32), total[k]]
                yield pa.RecordBatch.from_arrays([*map(nullable, columns)], names=["candidate", "n", "slot", "value"])

    rows = frame.mapInArrow(sums, "candidate int, n double, slot int, value double")
    table = rows.groupBy("candidate", "slot").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    found = table.toPandas().sort_values(["candidate", "slot"])
    out = []
    for k in range(len(sizes)):
        mine = found[found["candidate"] == k]
        n, values = float(mine["n"].iloc[0]), mine["value"].to_numpy()
        m, f, u, uu = (values[i * flat : (i + 1) * flat].reshape(target.shape) for i in range(4))
        spread = np.sqrt(np.maximum(uu / n - (u / n) ** 2, 0.0) * n / max(n - 1, 1))
        moments = values[4 * flat :].reshape(arms, each, each) / n
        out.append(Score(m / n, spread, f / n, moments, n))
    return out


def moved_frame(frame: DataFrame, target: Target, steps: Sequence[tuple[np.ndarray, float]]) -> DataFrame:
    """Frame with the hazards after all steps."""
    names = frame.columns

    def work(batches):
        for batch, block in _blocks(batches, target, steps):
            moved = {haz_name(c, a): lists(block.haz[:, a, k]) for a in ARMS for k, c in enumerate(target.causes)}
            yield pa.RecordBatch.from_arrays([moved[c] if c in moved else batch.column(c) for c in names], names=names)

    return frame.mapInArrow(work, frame.schema)


@dataclass(frozen=True)
class Targeted:
    """Result of the targeting: updated curves, the final and the initial score, passes used."""

    frame: DataFrame
    score: Score
    initial: Score
    updates: int
    solved: bool


def tmle_update(frame: DataFrame, target: Target, max_updates: int = 500, tolerance: float | None = None) -> Targeted:
    """Move the hazards until every mean influence value is small against its standard error, or as ``tolerance`` asks.

    Each pass tries a ladder of step lengths along the first-order solution and keeps the one that
    shrinks the scores most, so few passes are needed; every few steps the moved curves are
    written out so that no pass repeats a long history.
    """
    current, steps = frame, []
    score = initial = scores(frame, target, [])[0]
    used = 0
    while used < max_updates and not score.solved(tolerance):
        direction = score.direction()
        tried = scores(current, target, steps, direction, LADDER)
        best = min(range(len(LADDER)), key=lambda k: tried[k].size)
        used += 1
        if tried[best].size >= score.size:
            break
        steps = [*steps, (direction, LADDER[best])]
        score = tried[best]
        if len(steps) >= CUT_EVERY:
            current, steps = cut(moved_frame(current, target, steps), "tmle"), []
    if steps:
        current = moved_frame(current, target, steps)
    return Targeted(current, score, initial, used, score.solved(tolerance))


def influence_rows(frame: DataFrame, target: Target) -> DataFrame:
    """Per person, cause and target time: risk under both arms and uncentred influence values."""
    schema = f"{target.id_col} {dict(frame.dtypes)[target.id_col]}, event int, target_time double, f1 double, f0 double, u1 double, u0 double"

    def work(batches):
        for batch, block in _blocks(batches, target, []):
            m, f = block.influence(block.haz)
            u = m + f
            for k, cause in enumerate(target.causes):
                for j, t in enumerate(target.times):
                    keys = [np.full(batch.num_rows, cause, np.int32), np.full(batch.num_rows, float(t))]
                    values = [x[:, arm, k, j] for x in (f, u) for arm in (1, 0)]
                    columns = [batch.column(target.id_col), *map(nullable, keys + values)]
                    yield pa.RecordBatch.from_arrays(columns, names=[target.id_col, "event", "target_time", "f1", "f0", "u1", "u0"])

    return frame.mapInArrow(work, schema)


def estimates(rows: DataFrame) -> DataFrame:
    """Risks, ratio and difference with standard errors and 95 % limits from influence rows."""
    moments = rows.groupBy("event", "target_time").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("f1").alias("p1"),
        F.avg("f0").alias("p0"),
        F.var_samp("u1").alias("v1"),
        F.var_samp("u0").alias("v0"),
        F.covar_samp("u1", "u0").alias("c"),
    )
    n, p1, p0 = F.col("n"), F.col("p1"), F.col("p0")
    v1, v0, c = F.col("v1"), F.col("v0"), F.col("c")
    ratio = F.when((p0 > 0) & (p1 > 0), p1 / p0)
    log_var = v1 / (p1 * p1) + v0 / (p0 * p0) - 2 * c / (p1 * p0)
    log_se = F.when((p0 > 0) & (p1 > 0), F.sqrt(F.greatest(log_var, F.lit(0.0)) / n))
    difference_se = F.sqrt(F.greatest(v1 + v0 - 2 * c, F.lit(0.0)) / n)

    def plain(kind: str, arm, value: Column, se: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("type"),
            F.lit(arm).cast("int").alias("arm"),
            value.alias("estimate"),
            se.alias("se"),
            (value - Z_95 * se).alias("lo"),
            (value + Z_95 * se).alias("hi"),
        )

    relative = F.struct(
        F.lit("rr").alias("type"),
        F.lit(None).cast("int").alias("arm"),
        ratio.alias("estimate"),
        (ratio * log_se).alias("se"),
        (ratio * F.exp(-Z_95 * log_se)).alias("lo"),
        (ratio * F.exp(Z_95 * log_se)).alias("hi"),
    )
    results = F.array(
        plain("risks", 1, p1, F.sqrt(v1 / n)),
        plain("risks", 0, p0, F.sqrt(v0 / n)),
        relative,
        plain("rd", None, p1 - p0, difference_se),
    )
    return moments.select("event", "target_time", F.inline(results))


def plug_in_estimates(rows: DataFrame) -> DataFrame:
    """Risks, ratio and difference of the untargeted curves (g-computation), without limits."""
    full = estimates(rows)
    empty = F.lit(None).cast("double")
    return full.withColumns({"se": empty, "lo": empty, "hi": empty})


def all_estimates(targeted: DataFrame, initial: DataFrame, target: Target) -> DataFrame:
    """Targeted and g-computation estimates in one table."""
    main = estimates(influence_rows(targeted, target)).withColumn("g_comp", F.lit(False))
    plug_in = plug_in_estimates(influence_rows(initial, target)).withColumn("g_comp", F.lit(True))
    return main.unionByName(plug_in)


def g_computation(curves: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean curves per arm and time from long curves."""
    return curves.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])


def effect_rows(frame: DataFrame, target: Target, cause: int = 1) -> DataFrame:
    """Per person and target time: difference of the risk between the arms."""
    rows = influence_rows(frame, target).where(F.col("event") == cause)
    return rows.select(target.id_col, "target_time", (F.col("f1") - F.col("f0")).alias("hte"))


def e_values(ratios: DataFrame, estimate: str = "estimate", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """E-value of a ratio and of the confidence limit nearest to 1 (1 when the interval holds it)."""
    near = F.when(F.col(estimate) >= 1, F.col(lo)).otherwise(F.col(hi))
    crossed = (F.col(lo) <= 1) & (F.col(hi) >= 1)
    return ratios.withColumns(
        {
            "e_value": stats.e_value(F.col(estimate)),
            "e_value_limit": F.when(crossed, F.lit(1.0)).otherwise(stats.e_value(near)),
        }
    )


def e_value_contours(
    ratios: DataFrame, strengths: Sequence[float], estimate: str = "estimate"
) -> DataFrame:
    """Ratio left after confounding of every pair of strengths, moved towards 1."""
    levels = F.array(*[F.lit(float(s)) for s in strengths])
    grid = ratios.withColumn("rr_exposure", F.explode(levels)).withColumn("rr_outcome", F.explode(levels))
    factor = stats.bias_factor(F.col("rr_exposure"), F.col("rr_outcome"))
    adjusted = F.when(F.col(estimate) >= 1, F.col(estimate) / factor).otherwise(F.col(estimate) * factor)
    return grid.withColumn("bias_factor", factor).withColumn("adjusted", adjusted)


def difference_moments(estimates: DataFrame) -> DataFrame:
    """Risks of both arms with the variances and the covariance of their errors, from the table of estimates."""

    def of(kind: str, column: str, arm: int | None = None) -> Column:
        wanted = F.col("type") == kind
        return F.max(F.when(wanted if arm is None else wanted & (F.col("arm") == arm), F.col(column)))

    rows = estimates.groupBy("event", "target_time").agg(
        of("risks", "estimate", 1).alias("p1"),
        of("risks", "estimate", 0).alias("p0"),
        F.pow(of("risks", "se", 1), 2).alias("var1"),
        F.pow(of("risks", "se", 0), 2).alias("var0"),
        F.pow(of("rd", "se"), 2).alias("_var"),
        *[of("rd", c).alias(c) for c in ("estimate", "lo", "hi")],
    )
    return rows.withColumn("cov", (F.col("var1") + F.col("var0") - F.col("_var")) / 2).drop("_var")


def difference_e_values(estimates: DataFrame) -> DataFrame:
    """E-values on the difference scale, of the difference and of its confidence limit nearest to 0.

    Confounding of bias factor ``B`` may divide the higher risk by ``B``, so a difference vanishes at the ratio of the risks. The
    limit reaches 0 where ``high - B low`` equals its own error times the normal quantile: the smaller root above 1 of a quadratic.
    An interval that holds 0 gives 1; without a risk in the lower arm there is no value.
    """
    up = F.col("p1") >= F.col("p0")
    high, low = F.greatest("p1", "p0"), F.least("p1", "p0")
    z2, cov = Z_95**2, F.col("cov")
    first = high * high - z2 * F.when(up, F.col("var1")).otherwise(F.col("var0"))
    last = low * low - z2 * F.when(up, F.col("var0")).otherwise(F.col("var1"))
    middle = high * low - z2 * cov
    root = first / (middle + F.sqrt(F.greatest(middle * middle - first * last, F.lit(0.0))))
    crossed = (F.col("lo") <= 0) & (F.col("hi") >= 0)
    limit = F.when(low > 0, F.when(crossed, F.lit(1.0)).otherwise(stats.e_value(root)))
    return difference_moments(estimates).select(
        "event", "target_time", "estimate", "lo", "hi",
        F.when(low > 0, stats.e_value(high / low)).alias("e_value"),
        limit.alias("e_value_limit"),
    )


def difference_contours(estimates: DataFrame, strengths: Sequence[float]) -> DataFrame:
    """Difference left after confounding of every pair of strengths: the higher risk over the bias factor."""
    levels = F.array(*[F.lit(float(s)) for s in strengths])
    moments = difference_moments(estimates)
    grid = moments.withColumn("rr_exposure", F.explode(levels)).withColumn("rr_outcome", F.explode(levels))
    factor = stats.bias_factor(F.col("rr_exposure"), F.col("rr_outcome"))
    p1, p0 = F.col("p1"), F.col("p0")
    adjusted = F.when(p1 >= p0, p1 / factor - p0).otherwise(p1 - p0 / factor)
    return grid.select(
        "event", "target_time", "estimate", "rr_exposure", "rr_outcome", factor.alias("bias_factor"), adjusted.alias("adjusted")
    )


def both_contours(estimates: DataFrame, strengths: Sequence[float]) -> DataFrame:
    """Contours of ratios and differences in one table, by ``type``."""
    shown = ("event", "target_time", "estimate", "rr_exposure", "rr_outcome", "bias_factor", "adjusted")
    ratios = e_value_contours(estimates.where(F.col("type") == "rr"), strengths).select(F.lit("rr").alias("type"), *shown)
    return ratios.unionByName(difference_contours(estimates, strengths).withColumn("type", F.lit("rd")))


def both_e_values(estimates: DataFrame) -> DataFrame:
    """E-values of ratios and differences in one table, by ``type``."""
    shown = ("event", "target_time", "estimate", "lo", "hi", "e_value", "e_value_limit")
    ratios = e_values(estimates.where(F.col("type") == "rr")).select(F.lit("rr").alias("type"), *shown)
    return ratios.unionByName(difference_e_values(estimates).withColumn("type", F.lit("rd")))


def nuisance_weights(frame: DataFrame, target: Target) -> DataFrame:
    """Inverse of propensity times censoring survival under the own arm, per person and target time."""
    names = [target.id_col, target.treated]
    schema = f"{target.id_col} {dict(frame.dtypes)[target.id_col]}, {target.treated} boolean, target_time double, weight double"

    def work(batches):
        for batch, block in _blocks(batches, target, []):
            own = np.where(block.factual[:, 1, None], block.weight[:, 1], block.weight[:, 0])
            for t, at in zip(target.times, target.at):
                columns = [*map(batch.column, names), nullable(np.full(len(own), float(t))), nullable(own[:, at])]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "target_time", "weight"])

    return frame.mapInArrow(work, schema)
