"""Exposed and control cohorts for many experiments in one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispan.functions import dates as D
from epispan.operators.hotdeck import hot_deck_sample
from epispan.params import (
    COMPOSITE,
    HISTORICAL,
    TEST_NEGATIVE,
    CohortParams,
    Experiment,
    PersonColumns,
)
from epispan.session import cut


def with_index(persons: DataFrame, cols: PersonColumns) -> DataFrame:
    """Add the index date and the age in days at index."""
    return persons.withColumn("index_date", D.index_date(cols)).withColumn(
        "age_days", D.age_days("index_date", cols.birth)
    )


def with_outcome(frame: DataFrame, death: str) -> DataFrame:
    """Add event indicator and event time from the three outcome dates."""
    return frame.withColumn(
        "event_indicator", D.event_indicator("censoring_date", "event_date", death)
    ).withColumn("event_time", D.event_time("index_date", "censoring_date", "event_date", death))


def require_nonnull(frame: DataFrame, column: str) -> None:
    """Raise when a needed column holds no value at all; stops at the first value found."""
    if frame.where(F.col(column).isNotNull()).limit(1).count() == 0:
        raise RuntimeError(f"No information available in column {column}.")


def split_exposed_pool(
    persons: DataFrame, cols: PersonColumns, params: CohortParams
) -> tuple[DataFrame, DataFrame]:
    """Exposed persons of sufficient age, and the pool of never exposed persons."""
    dated = with_index(persons, cols)
    exposed = (
        dated.where(F.col("index_date").isNotNull())
        .where(D.old_enough("age_days", params.min_age, params.min_age_unit))
        .withColumn("exposed", F.lit(True))
        .withColumn("censoring_date", F.col(cols.censoring))
    )
    pool = dated.where(F.col("index_date").isNull()).withColumn("exposed", F.lit(False))
    return exposed, pool


def _experiment_rows(experiments: Sequence[Experiment], cols: PersonColumns, params: CohortParams) -> Column:
    """The experiments as one constant array; the endpoint is a position among the endpoint dates."""
    endpoints = [*cols.endpoint_map, COMPOSITE]
    rows = []
    for e in experiments:
        if e.endpoint not in endpoints:
            raise ValueError(f"Unknown endpoint: {e.endpoint}")
        wave = params.wave(e.wave)
        subset = "tested" if e.design == TEST_NEGATIVE else e.subset
        rows.append(
            F.struct(
                F.lit(e.name).alias("experiment"),
                F.lit(e.design).alias("design"),
                F.lit(endpoints.index(e.endpoint)).alias("endpoint"),
                F.lit(wave.first).alias("first"),
                F.lit(wave.last).cast("date").alias("last"),
                F.lit(subset).cast("string").alias("subset"),
            )
        )
    return F.array(*rows)


def _per_experiment(
    frame: DataFrame,
    experiments: Sequence[Experiment],
    cols: PersonColumns,
    params: CohortParams,
    keep: Callable[[Column], Column],
) -> DataFrame:
    """One row per person and qualifying experiment; rows that do not qualify are never emitted."""
    rows = F.filter(_experiment_rows(experiments, cols, params), keep)
    endpoints = [*cols.endpoint_map, COMPOSITE]
    dates = F.array(*[D.event_date(cols, endpoint) for endpoint in endpoints])
    spread = frame.withColumn("_e", F.explode(rows))
    return spread.withColumns(
        {
            "experiment": F.col("_e.experiment"),
            "design": F.col("_e.design"),
            "event_date": F.get(dates, F.col("_e.endpoint")),
        }
    ).drop("_e")


def _inside(date: str, e: Column) -> Column:
    return (F.col(date) >= e["first"]) & (e["last"].isNull() | (F.col(date) <= e["last"]))


def exposed_cohort(
    persons: DataFrame,
    experiments: Sequence[Experiment],
    cols: PersonColumns,
    params: CohortParams,
) -> DataFrame:
    """Exposed rows of every experiment with outcome and age."""
    exposed, _ = split_exposed_pool(persons, cols, params)
    exposed = exposed.withColumns(
        {f"_{s}": D.in_subset(cols, s) for s in ("hospital", "tested")}
    )

    def keep(e: Column) -> Column:
        member = (
            e["subset"].isNull()
            | ((e["subset"] == "hospital") & F.col("_hospital"))
            | ((e["subset"] == "tested") & F.col("_tested"))
        )
        return _inside("index_date", e) & member

    spread = _per_experiment(exposed, experiments, cols, params, keep).drop("_hospital", "_tested")
    valid = spread.where(D.valid_dates("index_date", cols.censoring, "event_date", cols.death))
    return with_outcome(valid, cols.death)


def control_pool(
    persons: DataFrame,
    experiments: Sequence[Experiment],
    cols: PersonColumns,
    params: CohortParams,
) -> DataFrame:
    """Pool rows of every experiment; test-negative pools need a first test inside the wave."""
    _, pool = split_exposed_pool(persons, cols, params)

    def keep(e: Column) -> Column:
        tested = F.coalesce(_inside(cols.tested, e), F.lit(False))
        return (e["design"] != TEST_NEGATIVE) | tested

    pool = pool.drop("index_date", "age_days")
    return _per_experiment(pool, experiments, cols, params, keep)


def sampled_controls(
    exposed: DataFrame,
    pool: DataFrame,
    experiments: Sequence[Experiment],
    cols: PersonColumns,
    params: CohortParams,
    on_empty: str = "error",
) -> DataFrame:
    """Controls with index and censoring dates drawn from the exposed of the same experiment."""
    draw = {"id_col": cols.id, "by": ["experiment"], "seed": params.seed, "on_empty": on_empty}
    donors = exposed.select(
        cols.id,
        "experiment",
        F.col("index_date").alias("donor_date"),
        F.col("age_days").alias("donor_age"),
    )
    drawn = hot_deck_sample(donors, pool, values=["donor_date", "donor_age"], salt="a", **draw)
    historical = F.col("design") == HISTORICAL
    drawn = drawn.withColumn(
        "index_date",
        F.when(historical, F.date_add(F.col(cols.birth), F.col("donor_age"))).otherwise(
            F.col("donor_date")
        ),
    ).drop("donor_date", "donor_age")

    controls = drawn.withColumn("censoring_date", F.col(cols.censoring))
    if any(e.design == HISTORICAL for e in experiments):
        followed = exposed.where(historical & (F.col("event_indicator") == 0)).select(
            cols.id, "experiment", F.col("event_time").alias("donor_time")
        )
        drawn = hot_deck_sample(
            followed, drawn, values=["donor_time"], salt="b", needed=historical, **draw
        )
        limit, own = F.lit(params.historical_cutoff), F.col(cols.censoring)
        followed_until = F.date_add("index_date", F.col("donor_time"))
        controls = drawn.withColumns(
            {
                "censoring_date": F.when(historical, followed_until).otherwise(own),
                cols.censoring: F.when(historical, limit).otherwise(own),
            }
        ).drop("donor_time")

    controls = controls.where(
        D.valid_dates("index_date", cols.censoring, "event_date", cols.death)
    ).withColumn("censoring_date", D.forced_censoring("censoring_date", cols.censoring))
    controls = controls.withColumn("age_days", D.age_days("index_date", cols.birth))
    return with_outcome(controls, cols.death)


def final_projection(frame: DataFrame, id_col: str) -> DataFrame:
    """The dated-cohort columns, with the age in years."""
    return frame.select(
        "experiment",
        id_col,
        "exposed",
        "index_date",
        D.age_years("age_days").alias("age_at_index"),
        "event_time",
        "event_indicator",
    )


def build_cohorts(
    persons: DataFrame,
    experiments: Sequence[Experiment],
    cols: PersonColumns,
    params: CohortParams,
    on_empty: str = "error",
) -> DataFrame:
    """Dated cohorts of all experiments, keyed by ``experiment``.

    The exposed rows feed the output and several donor tables, so they are written out once.
    """
    needed = ["experiment", "design", cols.id, "exposed", "index_date", "age_days"]
    exposed = exposed_cohort(persons, experiments, cols, params)
    exposed = cut(exposed.select(*needed, "event_time", "event_indicator"), "exposed")
    pool = control_pool(persons, experiments, cols, params)
    controls = sampled_controls(exposed, pool, experiments, cols, params, on_empty)
    return final_projection(exposed, cols.id).unionByName(final_projection(controls, cols.id))


def build_cohort(
    persons: DataFrame,
    experiment: Experiment,
    cols: PersonColumns = PersonColumns(),
    params: CohortParams = CohortParams(),
) -> DataFrame:
    """Dated cohort of one experiment; checks the hospital flag when it is needed."""
    if experiment.subset == "hospital":
        require_nonnull(persons, cols.hospitalized)
    return build_cohorts(persons, [experiment], cols, params).drop("experiment")


def arm_sizes(cohorts: DataFrame, experiments: Sequence[Experiment], id_col: str) -> DataFrame:
    """``(experiment, exposed, n, person_days, id_sum)`` for both arms of every experiment asked for, zeros where an arm is empty.

    Experiments that found no donors, and so no controls, thus stay visible when ``build_cohorts`` drops them.
    """
    arms = [(e.name, arm) for e in experiments for arm in (True, False)]
    asked = cohorts.sparkSession.createDataFrame(arms, "experiment string, exposed boolean")
    found = cohorts.groupBy("experiment", "exposed").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_time").alias("person_days"), F.sum(id_col).alias("id_sum")
    )
    sums = ("n", "person_days", "id_sum")
    return asked.join(found, ["experiment", "exposed"], "left").na.fill(0, sums)


def event_counts(cohort: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per exposure arm and event indicator, missing combinations as zero."""
    counts = [
        F.count_if(F.col("event_indicator") == code).alias(f"n_{label}")
        for code, label in ((0, "censored"), (1, "event"), (2, "death"))
    ]
    return cohort.groupBy(*by, "exposed").agg(*counts)
