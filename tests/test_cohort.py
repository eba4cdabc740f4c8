"""Cohort rules on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from epispan.functions import dates as D
from epispan.operators import designs as G
from epispan.operators.hotdeck import donor_index, hot_deck_sample
from epispan.params import (
    CONCURRENT,
    HISTORICAL,
    TEST_NEGATIVE,
    CohortParams,
    Experiment,
    PersonColumns,
    experiment_table,
)
from epispan.sources.tables import person_dates_schema

COLS = PersonColumns()
DAY = dt.date.fromisoformat


def person(i, **dates):
    row = dict.fromkeys([COLS.id, *COLS.date_columns, COLS.hospitalized])
    row |= {COLS.id: i, COLS.birth: DAY("1940-01-01"), COLS.censoring: DAY("2022-12-31")}
    for key, value in dates.items():
        row[key] = DAY(value) if isinstance(value, str) else value
    return row


def frame(spark, rows):
    schema = person_dates_schema(COLS)
    return spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in rows], schema)


POSITIVE, DIAGNOSIS, AD = COLS.positive, COLS.diagnosis, "date_first_ad_diagnosis"


def outcome(spark, censoring, event, death, index="2020-01-01"):
    rows = [(DAY(index), *[DAY(d) if d else None for d in (censoring, event, death)])]
    df = spark.createDataFrame(rows, "index_date date, censoring_date date, event_date date, death date")
    r = G.with_outcome(df, "death").first()
    return r["event_indicator"], r["event_time"]


def test_ties_go_to_censoring_then_event(spark):
    same = "2020-02-01"
    assert outcome(spark, same, same, same) == (0, 31)
    assert outcome(spark, "2020-03-01", same, same) == (1, 31)
    assert outcome(spark, "2020-03-01", None, same) == (2, 31)
    assert outcome(spark, "2020-03-01", None, None) == (0, 60)


def test_dates_equal_to_the_index_are_invalid(spark):
    i = "2020-05-01"
    rows = [
        person(1, **{POSITIVE: i}),
        person(2, **{POSITIVE: i, AD: i}),
        person(3, **{POSITIVE: i, COLS.death: i}),
        person(4, **{POSITIVE: i, COLS.censoring: i}),
        person(5, **{POSITIVE: i, AD: "2020-05-02", COLS.death: "2020-05-02"}),
        person(6, **{DIAGNOSIS: "2020-04-01", POSITIVE: i}),
        person(7),
    ]
    e = Experiment("ad", None, CONCURRENT)
    got = {r[COLS.id]: r for r in G.exposed_cohort(frame(spark, rows), [e], COLS, CohortParams()).collect()}
    assert sorted(got) == [1, 5, 6]
    assert got[5]["event_indicator"] == 1
    assert got[6]["index_date"] == DAY("2020-04-01")


def test_age_unit_of_the_minimum(spark):
    rows = [person(1, **{POSITIVE: "2020-05-01"}), person(2, **{POSITIVE: "2020-05-01", COLS.birth: "1960-01-01"})]
    e = Experiment("ad", None, CONCURRENT)
    for unit, want in (("years", [1]), ("days", [1, 2])):
        params = CohortParams(min_age_unit=unit)
        got = G.exposed_cohort(frame(spark, rows), [e], COLS, params).collect()
        assert sorted(r[COLS.id] for r in got) == want
    with pytest.raises(ValueError):
        D.old_enough("age_days", 70, "weeks")


def test_wave_bounds_are_closed(spark):
    days = ["2020-08-31", "2020-09-01", "2021-05-31", "2021-06-01"]
    rows = [person(i, **{POSITIVE: d}) for i, d in enumerate(days)]
    e = Experiment("ad", "second_wave", CONCURRENT)
    got = G.exposed_cohort(frame(spark, rows), [e], COLS, CohortParams()).collect()
    assert sorted(r[COLS.id] for r in got) == [1, 2]


def test_subsets_treat_unknown_as_not_member(spark):
    rows = [
        person(1, **{POSITIVE: "2020-05-01", COLS.hospitalized: True}),
        person(2, **{POSITIVE: "2020-05-01"}),
        person(3, **{DIAGNOSIS: "2020-05-01", POSITIVE: "2020-06-01"}),
        person(4, **{DIAGNOSIS: "2020-05-01", COLS.hospitalized: False}),
    ]
    want = {None: [1, 2, 3, 4], "hospital": [1], "tested": [1, 2]}
    experiments = [Experiment("ad", None, CONCURRENT, s) for s in want]
    got = G.exposed_cohort(frame(spark, rows), experiments, COLS, CohortParams()).collect()
    for e in experiments:
        assert sorted(r[COLS.id] for r in got if r["experiment"] == e.name) == want[e.subset]


def test_hospital_subset_needs_the_flag(spark):
    rows = [person(1, **{POSITIVE: "2020-05-01"}), person(2)]
    with pytest.raises(RuntimeError):
        G.build_cohort(frame(spark, rows), Experiment("ad", None, CONCURRENT, "hospital"))


def test_unknown_names_are_refused(spark):
    with pytest.raises(ValueError):
        Experiment("ad", None, "something")
    with pytest.raises(ValueError):
        D.event_date(COLS, "stroke")
    with pytest.raises(ValueError):
        CohortParams().wave("fifth_wave")
    rows = frame(spark, [person(1, **{POSITIVE: "2020-05-01"})])
    with pytest.raises(ValueError):
        G.build_cohort(rows, Experiment("stroke", None, CONCURRENT))


def test_no_donors_raise_or_drop(spark):
    rows = frame(spark, [person(1, **{COLS.tested: "2020-05-01"}), person(2)])
    e = Experiment("ad", None, CONCURRENT)
    with pytest.raises(Exception, match="no donors"):
        G.build_cohort(rows, e).collect()
    assert G.build_cohorts(rows, [e], COLS, CohortParams(), on_empty="drop").count() == 0


def population(spark):
    rows = []
    for i in range(200):
        if i % 4 == 0:
            day = dt.date(2020, 3, 1) + dt.timedelta(days=i)
            extra = {POSITIVE: str(day), COLS.tested: str(day)}
            if i % 12 == 0:
                extra[AD] = str(day + dt.timedelta(days=40 + i))
        else:
            extra = {COLS.tested: "2020-06-01"} if i % 2 else {}
        rows.append(person(i, **{**extra, COLS.birth: f"19{30 + i % 20}-02-03"}))
    return frame(spark, rows)


def test_designs_set_dates_from_the_exposed(spark):
    people = population(spark).cache()
    births = {r[COLS.id]: r[COLS.birth] for r in people.collect()}
    for design in (HISTORICAL, CONCURRENT, TEST_NEGATIVE):
        rows = G.build_cohort(people, Experiment("ad", None, design)).collect()
        exposed = [r for r in rows if r["exposed"]]
        controls = [r for r in rows if not r["exposed"]]
        assert exposed and controls
        for r in controls:
            if design == HISTORICAL:
                ages = {(e["index_date"] - births[e[COLS.id]]).days for e in exposed}
                assert (r["index_date"] - births[r[COLS.id]]).days in ages
                assert r["index_date"] + dt.timedelta(days=r["event_time"]) <= DAY("2019-12-31")
            else:
                assert r["index_date"] in {e["index_date"] for e in exposed}
            if design == TEST_NEGATIVE:
                assert r[COLS.id] % 2 == 1
        again = G.build_cohort(people, Experiment("ad", None, design)).collect()
        assert sorted(map(str, rows)) == sorted(map(str, again))


def test_many_experiments_equal_single_runs(spark):
    people = population(spark)
    experiments = experiment_table(endpoints=("ad", "composite"), waves=("first_wave", None), arms=((HISTORICAL, "tested"), (TEST_NEGATIVE, None)))
    together = G.build_cohorts(people, experiments, COLS, CohortParams())
    for e in experiments[:3]:
        alone = G.build_cohort(people, e)
        mine = together.where(F.col("experiment") == e.name).drop("experiment")
        assert sorted(map(str, mine.collect())) == sorted(map(str, alone.collect()))


def test_donors_are_numbered_densely_and_drawn_evenly(spark):
    donors = spark.range(1000).select(F.col("id"), F.lit("x").alias("g"), (F.col("id") * 10).alias("v"))
    numbers = sorted(r["donor_index"] for r in donor_index(donors, "id", ["g"], 7).collect())
    assert numbers == list(range(1000))
    recipients = spark.range(5000, 25000).select(F.col("id"), F.lit("x").alias("g"))
    drawn = hot_deck_sample(donors, recipients, values=["v"], id_col="id", by=["g"], seed=7, salt="s")
    counts = drawn.groupBy("v").count().agg(F.count(F.lit(1)).alias("k"), F.max("count").alias("m"), F.sum("count").alias("n")).first()
    assert counts["n"] == 20000 and counts["k"] > 990 and counts["m"] < 50


def test_event_counts_fill_missing_with_zero(spark):
    df = spark.createDataFrame([(True, 0), (True, 1), (False, 2)], "exposed boolean, event_indicator int")
    got = {r["exposed"]: tuple(r)[1:] for r in G.event_counts(df).collect()}
    assert got == {True: (1, 1, 0), False: (0, 0, 1)}


def test_region_override_order(spark):
    df = spark.createDataFrame([("SMR", "PEDW"), ("SMR", None), (None, None)], "a string, b string")
    limit = D.region_limit(["a", "b"], [("PEDW", "2022-05-31"), ("SMR", "2022-08-31")], "2022-10-31")
    got = [str(r[0]) for r in df.select(limit).collect()]
    assert got == ["2022-05-31", "2022-08-31", "2022-10-31"]
