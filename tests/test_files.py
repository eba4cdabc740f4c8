"""Readers and writers with the default file layout."""

import datetime as dt

import pytest

from epispan.params import CONCURRENT, TEST_NEGATIVE, Experiment, experiment_table
from epispan.plans.cohort import run_cohorts
from epispan.session import scratch_path, shared_folder
from epispan.sources import sinks, tables

HEADER = (
    "patient_id,hospitalized_due_to_covid,birth_date,date_first_tested_positive,date_first_covid_diagnosis,"
    "date_first_tested,date_first_ad_diagnosis,date_first_pd_diagnosis,"
    "date_first_unspecified_dementia_diagnosis,death_date,censoring_global,unused"
)


@pytest.fixture
def person_csv(tmp_path):
    lines = [HEADER]
    for i in range(60):
        day = dt.date(2020, 3, 1) + dt.timedelta(days=i)
        positive = day if i % 3 == 0 else ""
        tested = day if i % 2 == 0 or positive else ""
        event = day + dt.timedelta(days=100) if i % 4 == 0 else ""
        lines.append(f"{i},{'True' if i % 6 == 0 else ''},1940-01-01,{positive},,{tested},{event},,,,2022-12-31,x")
    path = tmp_path / "persons.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_columns_are_matched_by_name(spark, person_csv):
    rows = tables.read_person_dates(spark, person_csv)
    first = rows.where("patient_id = 0").first()
    assert first["birth_date"] == dt.date(1940, 1, 1) and first["hospitalized_due_to_covid"] is True
    assert "unused" not in rows.columns and rows.where("date_first_tested_positive is null").count() == 40


def test_missing_columns_are_reported(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text("patient_id,birth_date\n1,1940-01-01\n")
    with pytest.raises(ValueError, match="death_date"):
        tables.read_person_dates(spark, str(path))


def test_cohort_stage_writes_all_results(spark, person_csv, tmp_path):
    persons = tables.read_person_dates(spark, person_csv)
    experiments = [Experiment("ad", "first_wave", CONCURRENT), Experiment("composite", None, TEST_NEGATIVE)]
    out = str(tmp_path / "out")
    cohorts = run_cohorts(spark, persons, experiments, out)
    assert {r[0] for r in cohorts.select("experiment").distinct().collect()} == {e.name for e in experiments}
    assert spark.read.csv(f"{out}/event_counts", header=True).count() == 4
    histograms = spark.read.parquet(f"{out}/histograms")
    assert {r[0] for r in histograms.select("feature").distinct().collect()} == {"index_date", "age_at_index", "event_time"}


def test_experiment_names_and_paths():
    experiments = experiment_table()
    assert len(experiments) == len({e.name for e in experiments}) == 36
    e = Experiment("ad", "first_wave", CONCURRENT, "tested")
    assert sinks.experiment_path("/data/", e) == "/data/ad_first_wave_equal_control_fu_tested.csv"


def test_text_export_has_two_decimals(spark, tmp_path):
    path = str(tmp_path / "export")
    sinks.write_csv(spark.createDataFrame([(1, 2.34567)], "id long, v double"), path)
    assert spark.read.csv(path, header=True).first()["v"] == "2.35"


def test_missing_design_matrix_raises(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_design_matrix(spark, str(tmp_path / "absent"))


def test_scratch_paths_lie_in_the_named_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    assert scratch_path(spark, "a").startswith(folder) and scratch_path(spark, "a") != scratch_path(spark, "a")


@pytest.mark.parametrize("column, bad", [("birth_date", "03/04/2020"), ("patient_id", "x7")])
def test_bad_values_raise_with_column_and_value(spark, person_csv, tmp_path, column, bad):
    lines = open(person_csv).read().split("\n")
    names = lines[0].split(",")
    values = lines[1].split(",")
    values[names.index(column)] = bad
    path = tmp_path / "bad.csv"
    path.write_text("\n".join([lines[0], ",".join(values), *lines[2:]]))
    with pytest.raises(Exception, match=f"column {column}: bad value {bad}"):
        tables.read_person_dates(spark, str(path)).collect()


def test_dates_of_another_format_raise(spark, tmp_path):
    path = tmp_path / "tests.tsv"
    path.write_text("eid\tspecdate\tresult\n1\t01/02/2020\t1\n2\t2020-02-03\t0\n3\t\t0\n")
    rows = tables.read_glob_tsv(spark, str(path)).orderBy("eid").collect()
    assert [r.specdate for r in rows] == [dt.date(2020, 2, 1), dt.date(2020, 2, 3), None]
    path.write_text("eid\tspecdate\tresult\n1\tApr 5 2020\t1\n")
    with pytest.raises(Exception, match="column specdate: bad value Apr 5 2020"):
        tables.read_glob_tsv(spark, str(path)).collect()
