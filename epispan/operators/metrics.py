"""Model quality for time-to-event predictions: concordance, AUC over time and Brier scores.

No pair of persons is ever formed.  Persons are reduced to counts per (score, time, event); score
cells are counted on their own, and pairs from different cells follow from counts per cell and
day.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from epispan.operators.curves import kaplan_meier
from epispan.operators.ranking import SKETCH_CELLS, inner_edges
from epispan.session import cut

CELL_ROWS = 50_000


def step_values(points: DataFrame, steps: DataFrame, by: Sequence[str], value: str, start: float) -> DataFrame:
    """Value of a right-continuous step function at given days, per group.

    Both sides hold at most one row per group and day.
    """
    known = steps.select(*by, "t", F.col(value).alias("_v"), F.lit(0).alias("_asked"))
    asked = points.select(*by, "t", F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_asked"))
    upto = Window.partitionBy(*by).orderBy("t", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.coalesce(F.last("_v", True).over(upto), F.lit(start))
    return known.unionByName(asked).withColumn(value, latest).where("_asked = 1").drop("_v", "_asked")


def censoring_survival(train: DataFrame, time: str, event: str, by: Sequence[str]) -> DataFrame:
    """Survival of the censoring time per group; ``event`` is boolean."""
    coded = train.withColumn("_e", F.col(event).cast("int"))
    return kaplan_meier(coded, time, "_e", by).select(*by, "t", "cens_surv")


def censoring_at_own_time(
    test: DataFrame, train_curve: DataFrame, time: str, by: Sequence[str]
) -> DataFrame:
    """Training censoring survival at every distinct test day: one row per group and day."""
    days = test.select(*by, F.col(time).alias("t")).distinct()
    return step_values(days, train_curve, by, "cens_surv", 1.0)


def score_counts(
    frame: DataFrame, by: Sequence[str], score: Column, time: str, event: str
) -> DataFrame:
    """Persons per group, score, day and event flag."""
    return frame.groupBy(
        *by, score.cast("double").alias("score"), F.col(time).alias("t"), F.col(event).alias("event")
    ).agg(F.count(F.lit(1)).alias("n"))


def _celled(counts: DataFrame, by: Sequence[str], cell_rows: int) -> tuple[DataFrame, int]:
    """Score cells of about ``cell_rows`` rows of one group, and the largest number of cells of a group.

    Every group has edges of its own: edges of all groups together would leave each group a few rows in most cells, and rows of the
    tree over the cells that no day shares. The counts are read several times, so they are written out.
    """
    counts = cut(counts, "score-counts")
    sizes = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    cells = math.ceil((sizes.agg(F.max("_n")).first()[0] or 0) / cell_rows)
    if cells <= 1:
        return counts.withColumn("cell", F.lit(0)), 1
    rows = counts.withColumn("score", F.when(F.isnan("score") | F.col("score").isNull(), F.raise_error(F.lit("a score is missing"))).otherwise(F.col("score")))
    probs = F.array(*[F.lit(k / cells) for k in range(1, cells)])
    sketch = F.percentile_approx("score", probs, 20 * min(cells, SKETCH_CELLS)).alias("_edges")
    found = rows.groupBy(*by).agg(sketch)
    # one short array of edges per group
    splits = [(*row[:-1], inner_edges(row["_edges"])) for row in found.collect()]
    names = {c: f"_of_{c}" for c in by}
    schema = StructType([StructField(names.get(f.name, f.name), f.dataType) for f in found.schema.fields])
    edges = F.broadcast(counts.sparkSession.createDataFrame(splits, schema))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(names[c])) for c in by], F.lit(True))
    cell = F.size(F.filter("_edges", lambda e: e <= F.col("score")))
    return rows.join(edges, same).withColumn("cell", cell).drop("_edges", *names.values()), max(len(s[-1]) for s in splits) + 1


def dominated(
    rank: np.ndarray, day: np.ndarray, case: np.ndarray, any_n: np.ndarray, cens_n: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """For every case row: longer-lived persons of lower rank, and of the same rank.

    A person lives longer with a later day, or censored on the same day.  Rows whose ranks first
    differ in one binary digit meet exactly at that digit, so each digit is one sorted lookup.
    """
    days = int(day.max()) + 2 if len(day) else 1

    def longer(group: np.ndarray, source: np.ndarray, target: np.ndarray) -> np.ndarray:
        key = group[source].astype("int64") * days + day[source]
        order = np.argsort(key, kind="stable")
        key = key[order]
        any_sum = np.concatenate([[0], np.cumsum(any_n[source][order])])
        cens_sum = np.concatenate([[0], np.cumsum(cens_n[source][order])])
        own = group[target].astype("int64") * days + day[target]
        at = np.searchsorted(key, own, "left")
        past = np.searchsorted(key, own, "right")
        end = np.searchsorted(key, group[target].astype("int64") * days + days - 1, "right")
        return any_sum[end] - any_sum[past] + cens_sum[past] - cens_sum[at]

    lower = np.zeros(len(rank))
    digits = int(rank.max()).bit_length() if len(rank) else 0
    for digit in range(digits):
        high = (rank >> digit) & 1 == 1
        targets = np.flatnonzero(high & case)
        if len(targets):
            lower[targets] += longer(rank >> (digit + 1), np.flatnonzero(~high), targets)
    same = np.zeros(len(rank))
    targets = np.flatnonzero(case)
    if len(targets):
        same[targets] = longer(rank, np.arange(len(rank)), targets)
    return lower, same


def concordance(
    frame: DataFrame,
    by: Sequence[str],
    score: Column,
    time: str,
    event: str,
    weights: DataFrame | None = None,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Concordance of a risk score per group; ties in the score count half.

    A pair is comparable when one person has the event and the other lives longer, or is censored
    on the same day.  ``weights`` (by, t, weight) weighs each event by its day.
    """
    by = list(by)
    counts = score_counts(frame, by, score, time, event)
    if weights is None:
        counts = counts.withColumn("weight", F.lit(1.0))
    else:
        # one weight per group and day
        counts = counts.join(F.broadcast(weights.select(*by, "t", "weight")), [*by, "t"], "left")
    counts = counts.withColumn("weight", F.when(F.col("event"), F.coalesce("weight", F.lit(0.0))).otherwise(0.0))
    cells, n_cells = _celled(counts, by, cell_rows)

    types = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    head = "".join(f"{c} {types[c]}, " for c in by)
    schema = f"{head}concordant double, tied double, comparable double"

    def inside(key, pdf):
        rank = np.unique(pdf["score"].to_numpy(), return_inverse=True)[1].astype("int64")
        day = pdf["t"].to_numpy().astype("int64")
        day = day - day.min()
        n, hit = pdf["n"].to_numpy().astype("float64"), pdf["event"].to_numpy(dtype=bool)
        w = pdf["weight"].to_numpy() * n
        cens = np.where(hit, 0.0, n)
        lower, same = dominated(rank, day, hit, n, cens)
        higher, _ = dominated(rank.max() - rank, day, hit, n, cens)
        sums = [(w * lower).sum(), (w * same).sum(), (w * (lower + same + higher)).sum()]
        return pd.DataFrame([[*key[:-1], *sums]], columns=[*by, "concordant", "tied", "comparable"])

    parts = cells.groupBy(*by, "cell").applyInPandas(inside, schema)
    if n_cells > 1:
        parts = parts.unionByName(_across_cells(cells, by, n_cells))
    total = parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("concordant", "tied", "comparable")])
    index = (F.col("concordant") + 0.5 * F.col("tied")) / F.col("comparable")
    return total.withColumn("c_index", F.when(F.col("comparable") > 0, index))


def cell_tree(daily: DataFrame, by: Sequence[str], n_cells: int) -> DataFrame:
    """Counts per node of a binary tree over the cells and day, the lower and the upper half of the node side by side.

    Every row goes once to each level, and rows of one node and day are added up, so at most as many rows are written as there
    are levels times rows of ``daily``; a day that a cell does not have costs nothing.
    """
    levels = max(1, (n_cells - 1).bit_length())
    rows = daily.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in range(levels)])))
    rows = rows.withColumn("_node", F.expr("shiftright(cell, _level + 1)")).withColumn("_half", F.expr("shiftright(cell, _level) & 1"))
    sums = [
        F.sum(F.when(F.col("_half") == half, F.col(c)).otherwise(0)).alias(f"{c}_{half}")
        for c in ("any_n", "cens_n", "case_w")
        for half in (0, 1)
    ]
    return rows.groupBy(*by, "_level", "_node", "t").agg(*sums)


def _across_cells(cells: DataFrame, by: Sequence[str], n_cells: int) -> DataFrame:
    """Pairs whose scores lie in different cells: each pair meets in the one node that parts its cells."""
    daily = cells.groupBy(*by, "cell", "t").agg(
        F.sum("n").alias("any_n"),
        F.sum(F.when(~F.col("event"), F.col("n")).otherwise(0)).alias("cens_n"),
        F.sum(F.col("weight") * F.col("n")).alias("case_w"),
    )
    later = Window.partitionBy(*by, "_level", "_node").orderBy("t").rowsBetween(1, Window.unboundedFollowing)
    nodes = cell_tree(daily, by, n_cells)
    for half in (0, 1):  # persons of a half who live longer than a case of this day
        after = F.coalesce(F.sum(f"any_n_{half}").over(later), F.lit(0))
        nodes = nodes.withColumn(f"_longer_{half}", after + F.col(f"cens_n_{half}"))
    lower = F.col("case_w_1") * F.col("_longer_0")
    higher = F.col("case_w_0") * F.col("_longer_1")
    return nodes.groupBy(*by).agg(
        F.sum(lower).cast("double").alias("concordant"),
        F.lit(0.0).alias("tied"),
        F.sum(lower + higher).cast("double").alias("comparable"),
    )


def uno_weights(at_own_time: DataFrame, tau: float | Column | None = None) -> DataFrame:
    """Squared inverse censoring survival per group and day, zero from ``tau`` on."""
    inverse = 1 / (F.col("cens_surv") * F.col("cens_surv"))
    inverse = F.when(F.col("cens_surv") > 0, inverse).otherwise(0.0)
    if tau is not None:
        inverse = F.when(F.col("t") < tau, inverse).otherwise(0.0)
    return at_own_time.withColumn("weight", inverse)


def antolini_rows(
    frame: DataFrame, keep: Sequence[str], curve: str, time: str, event: str, grid: Sequence[float]
) -> DataFrame:
    """Rows for the time-dependent concordance: every person at each grid time not after their own.

    The score is the predicted risk at that grid time; only a person's last grid time carries the
    event.
    """
    own = F.greatest(F.size(F.filter(F.array(*[F.lit(t) for t in grid]), lambda t: t <= F.col(time))) - 1, F.lit(0))
    rows = frame.withColumn("_own", own)
    rows = rows.withColumn("t_idx", F.explode(F.sequence(F.lit(0), F.col("_own"))))
    return rows.select(
        *keep,
        time,
        "t_idx",
        (-F.get(F.col(curve), F.col("t_idx"))).alias("risk"),
        (F.col(event) & (F.col("t_idx") == F.col("_own"))).alias("hit"),
    )


def antolini_concordance(
    frame: DataFrame,
    by: Sequence[str],
    curve: str,
    time: str,
    event: str,
    grid: Sequence[float],
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Concordance of predicted curves, compared at each event time."""
    rows = antolini_rows(frame, by, curve, time, event, grid)
    per_time = concordance(rows, [*by, "t_idx"], F.col("risk"), time, "hit", cell_rows=cell_rows)
    sums = [F.sum(c).alias(c) for c in ("concordant", "tied", "comparable")]
    total = per_time.groupBy(*by).agg(*sums) if by else per_time.agg(*sums)
    index = (F.col("concordant") + 0.5 * F.col("tied")) / F.col("comparable")
    return total.withColumn("c_index", F.when(F.col("comparable") > 0, index))


def auc_over_time(
    frame: DataFrame,
    by: Sequence[str],
    score: Column,
    time: str,
    event: str,
    times: Sequence[float],
    at_own_time: DataFrame,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Cumulative/dynamic AUC per group and time with inverse-censoring weights on the cases."""
    by = list(by)
    counts = score_counts(frame, by, score, time, event)
    counts = counts.join(F.broadcast(at_own_time), [*by, "t"], "left")  # one row per group and day
    inverse = F.when(F.col("event") & (F.col("cens_surv") > 0), F.col("n") / F.col("cens_surv"))
    counts = counts.withColumn("weight", F.coalesce(inverse, F.lit(0.0)))
    cells, _ = _celled(counts, by, cell_rows)
    at = np.asarray(times, dtype="float64")
    types = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    head = "".join(f"{c} {types[c]}, " for c in by)
    schema = f"{head}cell int, t double, inner_sum double, cases double, controls double"

    def inside(key, pdf):
        pdf = pdf.sort_values("score")
        _, rank = np.unique(pdf["score"].to_numpy(), return_inverse=True)
        day, n = pdf["t"].to_numpy(dtype="float64"), pdf["n"].to_numpy(dtype="float64")
        w = pdf["weight"].to_numpy()
        inner, cases, controls = np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at))
        for k, t in enumerate(at):
            control = np.bincount(rank, weights=np.where(day > t, n, 0.0))
            case = np.bincount(rank, weights=np.where(day <= t, w, 0.0))
            below = np.cumsum(control) - control
            inner[k] = (case * (below + 0.5 * control)).sum()
            cases[k], controls[k] = case.sum(), control.sum()
        out = pd.DataFrame({"t": at, "inner_sum": inner, "cases": cases, "controls": controls})
        for name, value in zip([*by, "cell"], key):
            out[name] = value
        return out[[*by, "cell", "t", "inner_sum", "cases", "controls"]]

    parts = cells.groupBy(*by, "cell").applyInPandas(inside, schema)
    below = Window.partitionBy(*by, "t").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    lower = F.coalesce(F.sum("controls").over(below), F.lit(0.0))
    parts = parts.withColumn("_cross", F.col("cases") * lower)
    total = parts.groupBy(*by, "t").agg(
        F.sum(F.col("inner_sum") + F.col("_cross")).alias("_hit"),
        (F.sum("cases") * F.sum("controls")).alias("_all"),
    )
    return total.select(*by, "t", F.when(F.col("_all") > 0, F.col("_hit") / F.col("_all")).alias("auc"))


def mean_auc(auc: DataFrame, survival: DataFrame, by: Sequence[str]) -> DataFrame:
    """AUC averaged over time by the drop of the survival curve between the evaluation times."""
    at = step_values(auc.select(*by, "t"), survival, by, "surv", 1.0)
    ordered = Window.partitionBy(*by).orderBy("t")
    joined = auc.join(at, [*by, "t"])
    drops = joined.withColumn("_drop", F.lag("surv", 1, 1.0).over(ordered) - F.col("surv"))
    last = F.min("surv")
    total = F.sum(F.col("auc") * F.col("_drop")) / (1 - last)
    rows = drops.groupBy(*by) if by else drops
    return rows.agg(F.when(last < 1, total).alias("auc_mean"))


def brier_over_time(
    frame: DataFrame,
    by: Sequence[str],
    curve: str,
    time: str,
    event: str,
    grid: Sequence[float],
    train_curve: DataFrame,
) -> DataFrame:
    """Brier score per group and grid time with inverse-censoring weights.

    Each batch of persons is reduced to sums per grid time before anything is shuffled.
    """
    by = list(by)
    own = censoring_at_own_time(frame, train_curve, time, by).withColumnRenamed("cens_surv", "_g_own")
    spark = frame.sparkSession
    times = spark.createDataFrame([(float(t),) for t in grid], "t double")
    groups = train_curve.select(*by).distinct()
    asked = groups.withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in grid])))
    if not by:
        asked = times
    at_grid = step_values(asked, train_curve.withColumn("t", F.col("t").cast("double")), by, "cens_surv", 1.0)
    # one row per group and day; many persons may share the last day
    rows = frame.join(F.broadcast(own.withColumnRenamed("t", time)), [*by, time])
    at = np.asarray(grid, dtype="float64")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    head = "".join(f"{c} {types[c]}, " for c in by)

    def sums(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            for key, part in pdf.groupby(by) if by else [((), pdf)]:
                s = np.stack(part[curve].to_numpy())
                day = part[time].to_numpy(dtype="float64")[:, None]
                hit = part[event].to_numpy(dtype=bool)[:, None]
                g = part["_g_own"].to_numpy()[:, None]
                done = np.where((day <= at) & hit & (g > 0), s * s / np.where(g > 0, g, 1.0), 0.0)
                alive = np.where(day > at, (1 - s) ** 2, 0.0)
                out = pd.DataFrame(
                    {"t": at, "done": done.sum(0), "alive": alive.sum(0), "n": float(len(part))}
                )
                for name, value in zip(by, key):
                    out[name] = value
                yield out[[*by, "t", "done", "alive", "n"]]

    narrow = rows.select(*by, time, event, "_g_own", curve)
    parts = narrow.mapInPandas(sums, f"{head}t double, done double, alive double, n double")
    total = parts.groupBy(*by, "t").agg(*[F.sum(c).alias(c) for c in ("done", "alive", "n")])
    still = F.when(F.col("cens_surv") > 0, F.col("alive") / F.col("cens_surv")).otherwise(0.0)
    return total.join(at_grid, [*by, "t"]).select(*by, "t", ((F.col("done") + still) / F.col("n")).alias("brier"))


def integrated_brier(brier: DataFrame, by: Sequence[str]) -> DataFrame:
    """Trapezoid mean of the Brier score over the time span."""
    ordered = Window.partitionBy(*by).orderBy("t")
    step = (F.col("t") - F.lag("t").over(ordered)) * (F.col("brier") + F.lag("brier").over(ordered)) / 2
    areas = brier.withColumn("_area", step)
    span = F.max("t") - F.min("t")
    rows = areas.groupBy(*by) if by else areas
    return rows.agg((F.sum("_area") / span).alias("ibs"))
