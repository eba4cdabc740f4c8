"""Queries on person dates and cohort designs."""

from __future__ import annotations

from pyspark.sql import functions as F

from epispan.functions import dates as D
from epispan.operators import designs
from epispan.operators.hotdeck import donor_index, hot_deck_sample
from epispan.params import (
    CONCURRENT,
    HISTORICAL,
    TEST_NEGATIVE,
    Experiment,
    experiment_table,
)
from epispan.registry.base import query
from epispan.registry.sql import OUTCOME, PERSONS, VALID, cohorts, hashed
from epispan.sources.surrogate import COLUMNS, PARAMS, person_dates

C1 = Experiment("composite", None, HISTORICAL)
C2 = Experiment("composite", None, CONCURRENT)
C3 = Experiment("composite", None, TEST_NEGATIVE)
ALL_EXPERIMENTS = experiment_table(
    endpoints=("a", "b", "c", "composite"), waves=("wave_1998", "wave_1999", "wave_2000")
)


def dated(spark, sf):
    return designs.with_index(person_dates(spark, sf), COLUMNS)


def exposed_now(spark, sf):
    """Exposed persons with composite event and outcome dates, before the validity filter."""
    exposed, _ = designs.split_exposed_pool(person_dates(spark, sf), COLUMNS, PARAMS)
    return exposed.withColumn("event_date", D.event_date(COLUMNS, "composite"))


EXPOSED0 = f"""{PERSONS},
exposed0 AS (
  SELECT *, least(date_event_a, date_event_b, date_event_c) AS event_date, censoring_global AS censoring_date
  FROM dated WHERE index_date IS NOT NULL AND age_days >= 70)
"""


@query("person_dates", "D1", f"WITH {PERSONS} SELECT * FROM persons")
def _person_dates(spark, sf):
    return person_dates(spark, sf)


@query("index_date", "P1", f"WITH {PERSONS} SELECT person_id, index_date FROM dated")
def _index_date(spark, sf):
    return dated(spark, sf).select("person_id", "index_date")


@query(
    "age_at_index",
    "P2 P3",
    f"""WITH {PERSONS} SELECT person_id, age_days, round(age_days / 365.25, 2) AS age_years,
    round(age_days / 365.0, 4) AS age_years_365 FROM dated""",
)
def _age(spark, sf):
    return dated(spark, sf).select(
        "person_id",
        "age_days",
        F.round(D.age_years("age_days"), 2).alias("age_years"),
        F.round(D.age_years("age_days", 365.0), 4).alias("age_years_365"),
    )


@query(
    "event_date",
    "P4",
    f"""WITH {PERSONS} SELECT person_id, date_event_a AS event_a, date_event_b AS event_b,
    date_event_c AS event_c, least(date_event_a, date_event_b, date_event_c) AS event_composite
    FROM persons""",
)
def _event_date(spark, sf):
    endpoints = ("a", "b", "c", "composite")
    return person_dates(spark, sf).select(
        "person_id", *[D.event_date(COLUMNS, e).alias(f"event_{e}") for e in endpoints]
    )


@query(
    "event_indicator_and_time",
    "P5",
    f"WITH {EXPOSED0} SELECT person_id, {OUTCOME} FROM exposed0",
)
def _indicator(spark, sf):
    rows = designs.with_outcome(exposed_now(spark, sf), COLUMNS.death)
    return rows.select("person_id", "event_indicator", "event_time")


@query(
    "force_censoring",
    "P6",
    f"""WITH {PERSONS} SELECT person_id, CASE WHEN censoring_global < index_date + 400
    THEN censoring_global ELSE index_date + 400 END AS censoring_date
    FROM dated WHERE index_date IS NOT NULL""",
)
def _force(spark, sf):
    planned = F.date_add("index_date", 400)
    return (
        dated(spark, sf)
        .where(F.col("index_date").isNotNull())
        .select(
            "person_id",
            D.forced_censoring(planned, "censoring_global").alias("censoring_date"),
        )
    )


@query(
    "filter_valid_dates",
    "P7",
    f"WITH {EXPOSED0} SELECT person_id, index_date, event_date, death_date FROM exposed0 WHERE {VALID}",
)
def _valid(spark, sf):
    keep = D.valid_dates("index_date", "censoring_global", "event_date", "death_date")
    return (
        exposed_now(spark, sf)
        .where(keep)
        .select("person_id", "index_date", "event_date", "death_date")
    )


@query(
    "wave_filter",
    "P8",
    f"""WITH {PERSONS} SELECT person_id, index_date >= DATE '1998-01-01' AS wave_open,
    index_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AS wave_1998,
    index_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' AS wave_1999,
    index_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AS wave_2000
    FROM dated WHERE index_date IS NOT NULL""",
)
def _waves(spark, sf):
    return (
        dated(spark, sf)
        .where(F.col("index_date").isNotNull())
        .select(
            "person_id",
            *[D.in_wave("index_date", w).alias(w.name or "wave_open") for w in PARAMS.waves],
        )
    )


@query(
    "subset_filter",
    "P9",
    f"""WITH {PERSONS} SELECT person_id, index_date IS NOT NULL AS in_all,
    index_date IS NOT NULL AND hospitalized AS in_hospital,
    coalesce(index_date IS NOT NULL AND date_first_positive = index_date, false) AS in_tested
    FROM dated""",
)
def _subsets(spark, sf):
    return dated(spark, sf).select(
        "person_id",
        D.in_subset(COLUMNS, None).alias("in_all"),
        D.in_subset(COLUMNS, "hospital").alias("in_hospital"),
        D.in_subset(COLUMNS, "tested").alias("in_tested"),
    )


@query(
    "min_age_filter",
    "P11",
    f"""WITH {PERSONS} SELECT person_id, age_days FROM dated
    WHERE age_days / 365.25 >= 70""",
)
def _min_age(spark, sf):
    kept = dated(spark, sf).where(D.old_enough("age_days", 70.0, "years"))
    return kept.select("person_id", "age_days")


@query(
    "split_exposed_pool",
    "P12",
    f"""WITH {PERSONS} SELECT person_id, index_date IS NOT NULL AS exposed, index_date
    FROM dated WHERE index_date IS NULL OR age_days >= 70""",
)
def _split(spark, sf):
    exposed, pool = designs.split_exposed_pool(person_dates(spark, sf), COLUMNS, PARAMS)
    keep = ["person_id", "exposed", "index_date"]
    return exposed.select(*keep).unionByName(pool.select(*keep))


@query(
    "require_nonnull",
    "P10",
    f"WITH {PERSONS} SELECT count(*) AS hospitalized_persons FROM persons WHERE hospitalized",
)
def _require(spark, sf):
    persons = person_dates(spark, sf)
    designs.require_nonnull(persons, COLUMNS.hospitalized)
    return persons.where(F.col("hospitalized")).agg(
        F.count(F.lit(1)).alias("hospitalized_persons")
    )


_COHORT = "SELECT person_id, exposed, index_date, round(age_at_index, 6) AS age_at_index, event_time, event_indicator FROM cohort"


def _rounded(cohort):
    return cohort.withColumn("age_at_index", F.round("age_at_index", 6))


@query("historical_controls", "C1 C4 P13 U1", f"WITH {cohorts([C1])} {_COHORT}")
def _c1(spark, sf):
    return _rounded(designs.build_cohort(person_dates(spark, sf), C1, COLUMNS, PARAMS))


@query("concurrent_controls", "C2 U1", f"WITH {cohorts([C2])} {_COHORT}")
def _c2(spark, sf):
    return _rounded(designs.build_cohort(person_dates(spark, sf), C2, COLUMNS, PARAMS))


@query("test_negative_controls", "C3 U1", f"WITH {cohorts([C3])} {_COHORT}")
def _c3(spark, sf):
    return _rounded(designs.build_cohort(person_dates(spark, sf), C3, COLUMNS, PARAMS))


@query(
    "experiment_grid",
    "J16 D13",
    f"""WITH {cohorts(ALL_EXPERIMENTS)}
    SELECT a.experiment, a.exposed, count(person_id) AS n, CAST(coalesce(sum(event_time), 0) AS BIGINT) AS person_days,
      CAST(coalesce(sum(person_id), 0) AS BIGINT) AS id_sum
    FROM (SELECT x.experiment, y.exposed FROM (SELECT unnest([{", ".join(f"'{e.name}'" for e in ALL_EXPERIMENTS)}]) AS experiment) x,
      (SELECT unnest([true, false]) AS exposed) y) a
    LEFT JOIN cohort c ON c.experiment = a.experiment AND c.exposed = a.exposed GROUP BY ALL""",
)
def _grid(spark, sf):
    persons = person_dates(spark, sf)
    rows = designs.build_cohorts(persons, ALL_EXPERIMENTS, COLUMNS, PARAMS, on_empty="drop")
    return designs.arm_sizes(rows, ALL_EXPERIMENTS, "person_id")


@query(
    "event_counts",
    "A1 S12",
    f"""WITH {cohorts([C1, C2, C3])}
    SELECT experiment, exposed, count(*) FILTER (WHERE event_indicator = 0) AS n_censored,
      count(*) FILTER (WHERE event_indicator = 1) AS n_event,
      count(*) FILTER (WHERE event_indicator = 2) AS n_death FROM cohort GROUP BY ALL""",
)
def event_counts(spark, sf):
    rows = designs.build_cohorts(person_dates(spark, sf), [C1, C2, C3], COLUMNS, PARAMS)
    return designs.event_counts(rows, ["experiment"])


@query(
    "donor_index",
    "W9",
    f"""WITH {PERSONS} SELECT person_id, hospitalized,
      row_number() OVER (PARTITION BY hospitalized ORDER BY {hashed("'donor'", "person_id")}, person_id) - 1 AS donor_index,
      count(*) OVER (PARTITION BY hospitalized) AS n_donors
    FROM dated WHERE index_date IS NOT NULL""",
)
def _donor_index(spark, sf):
    donors = dated(spark, sf).where(F.col("index_date").isNotNull())
    return donor_index(
        donors.select("person_id", "hospitalized"), "person_id", ["hospitalized"], PARAMS.seed
    )


@query(
    "hot_deck_sample",
    "J11",
    f"""WITH {PERSONS}, donors AS (
      SELECT hospitalized, index_date AS drawn_date, age_days AS drawn_age,
        row_number() OVER (PARTITION BY hospitalized ORDER BY {hashed("'donor'", "person_id")}, person_id) - 1 AS k,
        count(*) OVER (PARTITION BY hospitalized) AS n
      FROM dated WHERE index_date IS NOT NULL)
    SELECT p.person_id, p.hospitalized, drawn_date, drawn_age
    FROM dated p JOIN donors d ON d.hospitalized = p.hospitalized AND k = {hashed("'s'", "person_id")} % n
    WHERE index_date IS NULL""",
)
def _hot_deck(spark, sf):
    rows = dated(spark, sf)
    donors = rows.where(F.col("index_date").isNotNull()).select(
        "person_id",
        "hospitalized",
        F.col("index_date").alias("drawn_date"),
        F.col("age_days").alias("drawn_age"),
    )
    recipients = rows.where(F.col("index_date").isNull()).select("person_id", "hospitalized")
    return hot_deck_sample(
        donors,
        recipients,
        values=["drawn_date", "drawn_age"],
        id_col="person_id",
        by=["hospitalized"],
        seed=PARAMS.seed,
        salt="s",
    )
