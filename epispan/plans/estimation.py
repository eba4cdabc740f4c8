"""Estimation stage: filter, match, cross-fit, target, and report."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from epispan.functions.stats import e_value
from epispan.operators import curves as K
from epispan.operators import hazards as H
from epispan.operators import matching as X
from epispan.operators import propensity as Q
from epispan.operators import sampling as P
from epispan.operators import summaries as M
from epispan.operators import tmle as T
from epispan.operators.ranking import exact_quantiles
from epispan.params import FitParams
from epispan.session import cut, fit_together
from epispan.sources.sinks import write_estimates, write_metrics

logger = logging.getLogger(__name__)
OUTCOMES = ("event_time", "event_indicator")
Score = Callable[[DataFrame, Sequence[str]], DataFrame]


@dataclass(frozen=True)
class Estimated:
    """All result tables of one estimation run."""

    estimates: DataFrame
    metrics: DataFrame
    auc_curves: DataFrame
    aalen_johansen: DataFrame
    e_values: DataFrame
    difference_e_values: DataFrame
    contours: DataFrame
    nuisance_weights: DataFrame
    propensity_calibration: DataFrame
    effects_continuous: DataFrame | None
    effects_binary: DataFrame | None
    balance: DataFrame | None
    updates: int
    solved: bool


def counted(frame: DataFrame, label: str) -> DataFrame:
    """Write a frame out and log its size, which the written files' footers hold."""
    kept = cut(frame, label)
    logger.info("%s: %d rows", label, kept.count())
    return kept


def select_rows(frame: DataFrame, params: FitParams, id_col: str, treated: str) -> DataFrame:
    """Apply the subset condition and the control subsampling."""
    if params.subset_condition:
        frame = counted(frame.filter(F.expr(params.subset_condition)), "subset")
    if params.control_subsample_factor is not None:
        sampled = P.subsample_controls(
            frame, id_col, treated, params.control_subsample_factor, params.seed
        )
        frame = counted(sampled, "subsample")
    return frame


def match_rows(
    frame: DataFrame, params: FitParams, id_col: str, treated: str, columns: Sequence[str], learner: str
) -> tuple[DataFrame, DataFrame]:
    """Matched rows and the standardised differences before and after matching."""
    scored = Q.propensity_scores(
        frame, id_col, treated, columns, params.seed, learner=learner,
        calibrate=params.match_calibrate, grid=params.match_grid_search,
    )
    scored = cut(scored.select(id_col, treated, "propensity_logit"), "scored")
    pairs = cut(
        X.nearest_neighbor_match(
            scored, id_col, treated, "propensity_logit", params.caliper, params.caliper_unit
        ),
        "pairs",
    )
    kept = counted(X.match_filter(frame, pairs, id_col), "matched")
    before = M.standardized_differences(frame, treated, columns)
    after = M.standardized_differences(kept, treated, columns)
    balance = before.withColumn("matched", F.lit(False)).unionByName(
        after.withColumn("matched", F.lit(True))
    )
    return kept, balance


def estimation_grid(frame: DataFrame, params: FitParams) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Time grid of the curves, joined by the target times inside the follow-up."""
    targets = K.reachable_times(frame, "event_time", params.target_times)
    if not targets:
        raise ValueError("no target time lies inside the follow-up")
    grid = {float(t) for t in K.grid_values(frame, "event_time", params.grid_size)}
    targets = tuple(float(t) for t in targets)
    return tuple(sorted(grid | set(targets))), targets


def prepared(
    design: DataFrame, params: FitParams, id_col: str, treated: str, learner: str
) -> tuple[DataFrame, list[str], DataFrame | None]:
    """Selected and matched rows, the covariates of the models, and the balance of the matching."""
    # Spark ML reads a dot in a column name as a struct field
    design = design.withColumnsRenamed({c: c.replace(".", "_") for c in design.columns if "." in c})
    frame = select_rows(design, params, id_col, treated)
    fixed = {id_col, treated, *OUTCOMES, *[c.replace(".", "_") for c in params.exclude_columns]}
    columns = [c for c in frame.columns if c not in fixed]
    if not params.match:
        return frame, columns, None
    frame, balance = match_rows(frame, params, id_col, treated, columns, learner)
    return frame, columns, balance


def stacked_score(params: FitParams, id_col: str, treated: str, settings: dict[str, dict] | None = None) -> Score:
    """The stacked propensity over as many folds as the outer ones."""

    def score(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
        stacked = Q.stacked_propensity(
            frame, id_col, treated, columns, params.seed, folds=params.n_folds_outer, settings=settings,
            calibration=params.propensity_calibration,
        )
        return stacked.select(id_col, "propensity")

    return score


def run_estimation(
    design: DataFrame,
    params: FitParams = FitParams(),
    id_col: str = "patient_id",
    treated: str = "exposed",
    learner: str = "gbt",
    propensity_settings: dict[str, dict] | None = None,
    score: Score | None = None,
) -> Estimated:
    """Doubly robust risks, ratios and differences for one design matrix, with diagnostics.

    ``score`` gives columns ``id_col`` and ``propensity`` for the weights (by default the stacked score).
    Every stage that is read again is written to the shared folder first, so a lost executor
    repeats one stage at most.
    """
    frame, columns, balance = prepared(design, params, id_col, treated, learner)
    curve = K.aalen_johansen(frame, "event_time", "event_indicator", [treated])

    grid, targets = estimation_grid(frame, params)
    names = (id_col, columns, treated, *OUTCOMES, grid)

    def choose(train: DataFrame, fold: int):
        best, _ = H.tune(
            train, *names, params.hazard, params.eval_metric, params.n_trials, params.n_folds_inner, params.seed,
            study=f"fold_{fold + 1}", path=params.trial_path,
        )
        return best

    crossed = H.cross_fit(
        frame, *names, folds=params.n_folds_outer, params=params.hazard, seed=params.seed,
        choose=choose if params.tune else None,
    )
    metrics = H.metric_panel(crossed, treated, *OUTCOMES, grid)

    score = score or stacked_score(params, id_col, treated, propensity_settings)
    propensity = cut(score(frame, columns).join(frame.select(id_col, treated), id_col), "propensity")
    target = T.Target(
        id_col, treated, "event_indicator", "propensity", grid, targets, bound=params.nuisance_bound
    )
    start = cut(T.targeting_frame(crossed, propensity, target, "event_time"), "targeting")
    done = T.tmle_update(start, target, params.max_updates)
    final = cut(done.frame, "targeted")
    estimates = cut(T.all_estimates(final, start, target), "estimates")
    targeted = estimates.where(~F.col("g_comp"))
    compared = [*columns, *excluded_covariates(frame, params, id_col, treated)]
    continuous, binary = effect_heterogeneity(final, frame, target, compared, params)
    weights = T.nuisance_weights(final, target)
    return Estimated(
        estimates=estimates,
        metrics=metrics,
        auc_curves=H.auc_curves(crossed, treated, *OUTCOMES, grid),
        aalen_johansen=curve,
        e_values=T.e_values(targeted.where(F.col("type") == "rr")),
        difference_e_values=T.difference_e_values(targeted),
        contours=T.both_contours(targeted, params.contour_strengths),
        nuisance_weights=exact_quantiles(
            weights, "weight", (0.01, 0.25, 0.5, 0.75, 0.99, 1.0), [treated, "target_time"]
        ),
        propensity_calibration=X.calibration_table(propensity, "propensity", treated, id_col),
        effects_continuous=continuous,
        effects_binary=binary,
        balance=balance,
        updates=done.updates,
        solved=done.solved,
    )


def excluded_covariates(frame: DataFrame, params: FitParams, id_col: str, treated: str) -> list[str]:
    """Numeric and boolean columns that the models do not see; the effect groups are compared on them too."""
    fixed = {id_col, treated, *OUTCOMES}
    names = {c.replace(".", "_") for c in params.exclude_columns} - fixed
    kinds = (NumericType, BooleanType)
    return [f.name for f in frame.schema.fields if f.name in names and isinstance(f.dataType, kinds)]


def effect_heterogeneity(
    targeted: DataFrame, frame: DataFrame, target: T.Target, columns: Sequence[str], params: FitParams
) -> tuple[DataFrame | None, DataFrame | None]:
    """Covariates compared between the lowest and the highest effect group of each target time."""
    effects = T.effect_rows(targeted, target)
    grouped = M.hte_quantile_groups(
        effects, "target_time", "hte", params.hte_quantile, params.hte_ceiling
    )
    kinds = M.feature_kinds(frame, columns)
    chosen = {k: [c for c in columns if kinds[c] == k] for k in ("continuous", "binary")}
    joined = grouped.join(frame.select(target.id_col, *columns), target.id_col)
    by = ["target_time"]
    continuous = M.compare_continuous(joined, by, chosen["continuous"]) if chosen["continuous"] else None
    binary = M.compare_binary(joined, by, chosen["binary"]) if chosen["binary"] else None
    return continuous, binary


def benchmark_rows(frame: DataFrame, params: FitParams) -> tuple[DataFrame, tuple[float, ...], tuple[float, ...]]:
    """Rows with event times in quantile bins, the time grid, and the target times that the binned times reach."""
    edges = [float(t) for t in K.grid_values(frame, "event_time", params.benchmark_bins)]
    if not edges:
        raise ValueError("the benchmark needs rows")
    binned = cut(frame.withColumn("event_time", K.snap_below("event_time", edges)), "binned")
    targets = tuple(float(t) for t in K.reachable_times(binned, "event_time", params.target_times))
    if not targets:
        raise ValueError("no target time lies inside the follow-up")
    return binned, tuple(sorted({*edges, *targets})), targets


def e_value_benchmark(
    design: DataFrame,
    params: FitParams,
    covariates: Mapping[str, Sequence[str]] | Sequence[str],
    id_col: str = "patient_id",
    treated: str = "exposed",
    learner: str = "gbt",
    score: Score | None = None,
) -> DataFrame:
    """E-values of the full run (``left_out`` is '') beside those of runs that leave one covariate out each.

    A covariate is a column or, in a mapping, a name for several (its one-hot columns). ``change`` is what leaving it out does to the
    estimate; for ratios, ``observed_e_value`` is the strength of a confounder that would do the same, the yardstick for
    ``e_value``. Rows, matching, bins of the event time, folds and passes of the hazard fits are shared by all runs; only the
    propensity, the targeting and the estimates are each run's own. ``score`` gives columns ``id_col`` and ``propensity`` (by
    default the stacked score). Hazards are logistic, without tuning.
    """
    groups = dict(covariates) if isinstance(covariates, Mapping) else {c: [c] for c in covariates}
    groups = {name: [c.replace(".", "_") for c in group] for name, group in groups.items()}
    frame, columns, _ = prepared(design, params, id_col, treated, learner)
    unknown = {c for group in groups.values() for c in group} - set(columns)
    if unknown or "" in groups:
        raise ValueError(f"not among the covariates: {', '.join(sorted(unknown)) or 'a name is empty'}")
    rows, grid, targets = benchmark_rows(frame, params)
    names = ["", *groups]
    curves = H.cross_fit_without(
        rows, id_col, columns, treated, *OUTCOMES, grid, list(groups.values()),
        folds=params.n_folds_outer, params=params.hazard, seed=params.seed,
    )
    score = score or stacked_score(params, id_col, treated)
    target = T.Target(id_col, treated, "event_indicator", "propensity", grid, targets, bound=params.nuisance_bound)

    def run(number: int) -> DataFrame:
        used = [c for c in columns if c not in groups.get(names[number], ())]
        propensity = cut(score(rows, used), "propensity")
        start = cut(T.targeting_frame(curves[number], propensity, target, "event_time"), "targeting")
        done = T.tmle_update(start, target, params.max_updates)
        estimates = cut(T.estimates(T.influence_rows(done.frame, target)), "estimates")
        found = T.both_e_values(estimates)
        return found.withColumns({"left_out": F.lit(names[number]), "solved": F.lit(done.solved)})

    runs = fit_together(design.sparkSession, run, range(len(names)))
    table = cut(reduce(DataFrame.unionByName, runs), "benchmark")
    keys = ["event", "target_time", "type"]
    full = table.where(F.col("left_out") == "").select(*keys, F.col("estimate").alias("_full"))
    joined = table.join(full, keys)
    ratio = F.when((F.col("type") == "rr") & (F.col("left_out") != ""), F.col("estimate") / F.col("_full"))
    return joined.withColumns(
        {"change": F.col("estimate") - F.col("_full"), "observed_e_value": e_value(ratio)}
    ).drop("_full")


def write_results(result: Estimated, out: str) -> None:
    """Write all result tables below one folder."""
    write_estimates(result.estimates, f"{out}/estimates")
    write_metrics(result.metrics, f"{out}/metrics")
    write_metrics(result.auc_curves, f"{out}/auc_curves")
    tables = {
        "aalen_johansen": result.aalen_johansen,
        "e_values": result.e_values,
        "difference_e_values": result.difference_e_values,
        "contours": result.contours,
        "nuisance_weights": result.nuisance_weights,
        "propensity_calibration": result.propensity_calibration,
        "effects_continuous": result.effects_continuous,
        "effects_binary": result.effects_binary,
        "balance": result.balance,
    }
    for name, table in tables.items():
        if table is not None:
            table.write.mode("overwrite").parquet(f"{out}/{name}")
    if not result.solved:
        logger.warning("targeting did not solve its equations after %d updates", result.updates)
    row = [(result.updates, result.solved)]
    spark = result.estimates.sparkSession
    spark.createDataFrame(row, "updates int, solved boolean").coalesce(1).write.mode("overwrite").parquet(f"{out}/targeting")
