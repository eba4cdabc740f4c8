"""Time grids, competing-risk curves by group, and curve operators on the long form.

Durations are whole days, so everything ordered in time runs on counts per day: at most a few
thousand rows per group, whatever the number of persons.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOG_ZERO = -1e300


def _before(by: Sequence[str], order: str):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _upto(by: Sequence[str], order: str):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def time_grid(frame: DataFrame, duration: str, k: int = 100) -> DataFrame:
    """Distinct lower quantiles of the durations at ``k`` evenly spaced probabilities."""
    counts = frame.groupBy(F.col(duration).alias("t")).agg(F.count(F.lit(1)).alias("_c"))
    everything = Window.partitionBy()
    marked = counts.select(
        "t",
        F.sum("_c").over(everything).alias("_n"),
        F.coalesce(F.sum("_c").over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"),
        F.sum("_c").over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)).alias("_to"),
    )
    ranks = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda j: F.floor(j * (F.col("_n") - 1) / F.lit(float(k - 1))),
    )
    hit = F.exists(ranks, lambda r: (r >= F.col("_from")) & (r < F.col("_to")))
    chosen = marked.where(hit)
    return chosen.select((F.row_number().over(Window.orderBy("t")) - 1).alias("t_idx"), "t")


def grid_values(frame: DataFrame, duration: str, k: int = 100) -> list[int]:
    """The grid as a sorted list of at most ``k`` days."""
    return sorted(row["t"] for row in time_grid(frame, duration, k).collect())


def snap_to_grid(value: str | Column, grid: Sequence[float]) -> Column:
    """Last grid time not after the value; values before the grid go to its first time."""
    value = F.col(value) if isinstance(value, str) else value
    times = F.array(*[F.lit(t) for t in grid])
    return F.coalesce(F.array_max(F.filter(times, lambda t: t <= value)), F.lit(grid[0]))


def snap_below(value: str | Column, edges: Sequence[float]) -> Column:
    """Lower edge of the half-open bin ``(edge, next]`` that holds the value; the first edge itself stays in the first bin."""
    value = F.col(value) if isinstance(value, str) else value
    array = F.array(*[F.lit(e) for e in edges])
    lower = F.coalesce(F.array_max(F.filter(array, lambda e: e < value)), F.lit(edges[0]))
    return F.when(value.isNotNull(), lower)


def reachable_times(frame: DataFrame, duration: str, targets: Sequence[float]) -> list[float]:
    """Target times not beyond the largest duration."""
    longest = frame.agg(F.max(duration)).first()[0]
    return [t for t in targets if longest is not None and t <= longest]


def risk_table(frame: DataFrame, time: str, event: str, causes: Sequence[int], by: Sequence[str]) -> DataFrame:
    """Per group and day: at risk, all events, events per cause, censored."""
    code = F.col(event)
    daily = frame.groupBy(*by, F.col(time).alias("t")).agg(
        F.count(F.lit(1)).alias("_leaving"),
        F.count_if(code > 0).alias("n_events"),
        *[F.count_if(code == c).alias(f"n_events_{c}") for c in causes],
    )
    from_here = Window.partitionBy(*by).orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    return daily.withColumn("n_risk", F.sum("_leaving").over(from_here)).withColumn(
        "n_censored", F.col("_leaving") - F.col("n_events")
    ).drop("_leaving")


def _log_keep(hit: str, risk: Column) -> Column:
    """log(1 - hit / risk), very negative when nobody is left."""
    share = F.col(hit) / risk
    return F.when(share >= 1, F.lit(LOG_ZERO)).otherwise(F.log1p(-share))


def kaplan_meier(frame: DataFrame, time: str, event: str, by: Sequence[str] = ()) -> DataFrame:
    """Event-free survival and censoring survival per group and day.

    Events precede censoring on the same day, so the censoring curve counts only the persons still
    event free that day.
    """
    table = risk_table(frame, time, event, [], by)
    left = F.greatest(F.col("n_risk") - F.col("n_events"), F.lit(1))
    here = _upto(by, "t")
    return table.select(
        *by,
        "t",
        "n_risk",
        "n_events",
        "n_censored",
        F.exp(F.sum(_log_keep("n_events", F.col("n_risk"))).over(here)).alias("surv"),
        F.exp(F.sum(_log_keep("n_censored", left)).over(here)).alias("cens_surv"),
    )


def censoring_curve(daily: DataFrame, by: Sequence[str]) -> DataFrame:
    """Censoring survival from daily counts with ``leaving`` and ``n_events``."""
    from_here = Window.partitionBy(*by).orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    rows = daily.withColumn("n_risk", F.sum("leaving").over(from_here)).withColumn(
        "n_censored", F.col("leaving") - F.col("n_events")
    )
    left = F.greatest(F.col("n_risk") - F.col("n_events"), F.lit(1))
    curve = F.exp(F.sum(_log_keep("n_censored", left)).over(_upto(by, "t")))
    return rows.select(*by, "t", curve.alias("cens_surv"))


def aalen_johansen(
    frame: DataFrame, time: str, event: str, by: Sequence[str] = (), cause: int = 1
) -> DataFrame:
    """Cumulative incidence of one cause with its variance, per group and day."""
    table = risk_table(frame, time, event, [cause], by)
    cause_events = f"n_events_{cause}"
    n, d, dj = F.col("n_risk").cast("double"), F.col("n_events"), F.col(cause_events)
    here, earlier = _upto(by, "t"), _before(by, "t")
    curve = table.withColumn(
        "surv", F.exp(F.sum(_log_keep("n_events", F.col("n_risk"))).over(here))
    ).withColumn("_lag", F.coalesce(F.lag("surv").over(Window.partitionBy(*by).orderBy("t")), F.lit(1.0)))
    curve = curve.withColumn("cif", F.sum(F.col("_lag") * dj / n).over(here))
    a = F.when(n > d, d / (n * (n - d))).otherwise(0.0)
    b = F.col("_lag") * F.col("_lag") * dj * (n - dj) / (n * n * n)
    c = F.col("_lag") * dj / (n * n)
    f = F.col("cif")
    sums = {"_a0": a, "_a1": a * f, "_a2": a * f * f, "_b": b, "_c0": c, "_c1": c * f}
    curve = curve.withColumns({name: F.sum(term).over(here) for name, term in sums.items()})
    variance = (
        f * f * F.col("_a0")
        - 2 * f * F.col("_a1")
        + F.col("_a2")
        + F.col("_b")
        - 2 * (f * F.col("_c0") - F.col("_c1"))
    )
    return curve.select(
        *by, "t", "n_risk", "n_events", cause_events, "surv", "cif", variance.alias("variance")
    )


def running_monotone(curves: DataFrame, keys: Sequence[str], value: str, increasing: bool, order: str = "t") -> DataFrame:
    """Running maximum (or minimum) along time."""
    pick = F.max if increasing else F.min
    return curves.withColumn(value, pick(value).over(_upto(keys, order)))


def lag_survival(curves: DataFrame, keys: Sequence[str], surv: str = "surv", order: str = "t") -> DataFrame:
    """Survival just before each time, 1 at the start."""
    ordered = Window.partitionBy(*keys).orderBy(order)
    return curves.withColumn("surv_before", F.lag(surv, 1, 1.0).over(ordered))


def hazard_from_cif(
    curves: DataFrame, keys: Sequence[str], cif: str = "cif", surv: str = "surv", order: str = "t"
) -> DataFrame:
    ordered = Window.partitionBy(*keys).orderBy(order)
    step = F.col(cif) - F.lag(cif, 1, 0.0).over(ordered)
    return curves.withColumn("hazard", step / F.lag(surv, 1, 1.0).over(ordered))


def cif_from_hazard(
    curves: DataFrame, keys: Sequence[str], hazard: str = "hazard", surv: str = "surv", order: str = "t"
) -> DataFrame:
    lagged = lag_survival(curves, keys, surv, order)
    step = F.col("surv_before") * F.col(hazard)
    return lagged.withColumn("cif_again", F.sum(step).over(_upto(keys, order))).drop("surv_before")


def effect_by_time(curves: DataFrame, id_col: str, arm: str = "arm", cif: str = "cif", order: str = "t") -> DataFrame:
    """Difference of the cumulative incidence between arm 1 and arm 0, per person and time."""
    of_arm = [F.max(F.when(F.col(arm) == a, F.col(cif))) for a in (1, 0)]
    return curves.groupBy(id_col, order).agg((of_arm[0] - of_arm[1]).alias("hte"))


def at_target_times(curves: DataFrame, targets: Sequence[float], order: str = "t") -> DataFrame:
    """Curve rows at exactly the target times."""
    return curves.where(F.col(order).isin(list(targets)))


def counterfactual(frame: DataFrame, column: str = "exposed") -> DataFrame:
    """Every row once as exposed and once as unexposed."""
    arms = F.explode(F.array(F.lit(True), F.lit(False)))
    return frame.drop(column).withColumn(column, arms)
