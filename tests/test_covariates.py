"""Covariate rules on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from epispan.functions import codes as C
from epispan.operators import covariates as V
from epispan.operators import wide as Wd
from epispan.params import BIOBANK_PATTERNS
from epispan.plans import covariates as plan

DAY = dt.date.fromisoformat
INDEX = DAY("2020-06-30")


def cohort(spark, ids=(1, 2)):
    return spark.createDataFrame([(i, INDEX) for i in ids], "person_id long, index_date date")


def wide(spark):
    rows = [
        # visit 1 has no date; the latest visit before the index is visit 2 and lacks a bmi
        (1, DAY("2010-01-01"), None, DAY("2019-01-01"), 20.0, 99.0, None, 1.0),
        # both visits lie after the index
        (2, DAY("2021-01-01"), None, DAY("2022-01-01"), 30.0, None, 31.0, 0.0),
        # a visit on the index date counts
        (3, DAY("2010-01-01"), INDEX, DAY("2021-01-01"), 20.0, 25.0, 40.0, 0.0),
    ]
    names = ["person_id", "visit_date-0.0", "visit_date-1.0", "visit_date-2.0", "bmi-0.0", "bmi-1.0", "bmi-2.0", "sex-0.0"]
    return spark.createDataFrame(rows, "a long, b date, c date, d date, e double, f double, g double, h double").toDF(*names)


def test_as_of_values_wide_and_long_agree(spark):
    people = cohort(spark, (1, 2, 3))
    rows = people.join(wide(spark), "person_id", "left")
    got = {r["person_id"]: r["bmi"] for r in Wd.asof_from_wide(rows, ["person_id"], "index_date").collect()}
    assert got == {1: 20.0, 2: None, 3: 25.0}
    long = Wd.wide_to_long(wide(spark), "person_id")
    found = V.asof_latest_visit(long, people, ["person_id"], "person_id").collect()
    assert {r["person_id"]: r["value"] for r in found} == {1: 20.0, 3: 25.0}
    static = {r["person_id"]: r["sex"] for r in Wd.static_columns(wide(spark), ["person_id"]).collect()}
    assert static == {1: 1.0, 2: 0.0, 3: 0.0}


def test_carry_forward_over_spans(spark):
    rows = [(k, v, 10.0 * v if v % 7 == k else None) for k in (1, 2) for v in range(40)]
    long = spark.createDataFrame(rows, "k long, visit int, value double")
    for span in (3, 1000):
        got = {(r["k"], r["visit"]): r["value"] for r in V.carry_forward(long, ["k"], "visit", "value", span).collect()}
        for k in (1, 2):
            last = None
            for v in range(40):
                last = 10.0 * v if v % 7 == k else last
                assert got[k, v] == last


def codes(spark, rows):
    return spark.createDataFrame(rows, "person_id long, pos int, code string, code_date date")


def test_look_back_window_is_left_open_and_right_closed(spark):
    start = INDEX - dt.timedelta(days=5 * 365)
    rows = [
        (1, 0, "E110", start),
        (1, 1, "I251", start + dt.timedelta(days=1)),
        (1, 2, "J45", INDEX),
        (1, 3, "F329", INDEX + dt.timedelta(days=1)),
        (1, 4, None, INDEX),
    ]
    found = V.code_features(
        codes(spark, rows), cohort(spark), ["person_id"], "person_id", BIOBANK_PATTERNS, days_since_last=True
    )
    got = V.complete_features(cohort(spark), found, ["person_id"], ["num_diagnoses"], list(BIOBANK_PATTERNS))
    got = {r["person_id"]: r.asDict() for r in got.collect()}
    assert got[1]["num_diagnoses"] == 2
    # flags look back without limit, but not past the index
    assert got[1]["diabetes"] and got[1]["cardiovascular_disease"] and not got[1]["depression"]
    assert got[1]["days_since_last"] == 0
    assert got[2]["num_diagnoses"] == 0 and got[2]["diabetes"] is False


def test_several_index_dates_per_person(spark):
    people = spark.createDataFrame(
        [("a", 1, DAY("2020-01-01")), ("b", 1, DAY("2021-01-01"))], "experiment string, person_id long, index_date date"
    )
    rows = [(1, 0, "E110", DAY("2019-06-01")), (1, 1, "E111", DAY("2020-06-01"))]
    keys = ["experiment", "person_id"]
    got = V.code_features(codes(spark, rows), people, keys, "person_id", {}).collect()
    assert {r["experiment"]: r["num_diagnoses"] for r in got} == {"a": 1, "b": 2}


def test_icd_format(spark):
    cases = {"E112A": "E11.2", "E11": "E11", "I2510": "I25.10", "S72001A": "S72.001", "XXA": "", "T36X5XD": "T36.X5", "M80SDA": "M80."}
    df = spark.createDataFrame([(c,) for c in cases], "code string")
    got = {r["code"]: r["out"] for r in df.withColumn("out", C.format_icd("code")).collect()}

    def plain(code):
        code = code[:3] + "." + code[3:] if len(code) > 3 else code
        return code.rstrip("A").rstrip("D").rstrip("S").strip("X")

    assert got == {c: plain(c) for c in cases}
    assert got["E112A"] == "E11.2"


@pytest.mark.parametrize("chunk_size", [1, 7, 60, 10_000])
def test_arrays_are_one_per_key_in_position_order(spark, chunk_size):
    rows = [(1, i, f"E{i % 90:02d}", INDEX - dt.timedelta(days=i % 50)) for i in range(500)]
    rows += [(2, i, "I10", INDEX) for i in range(3)]
    arrays = V.collect_code_arrays(
        codes(spark, rows[::-1]), cohort(spark), ["person_id"], "person_id", F.col("code"), "codes", "days",
        chunk_size=chunk_size,
    ).collect()
    got = {r["person_id"]: r for r in arrays}
    assert len(arrays) == len(got) == 2
    assert got[1]["codes"] == [f"E{i % 90:02d}" for i in range(500)]
    assert got[1]["days"] == [f"{INDEX - dt.timedelta(days=i % 50):%Y%m%d}" for i in range(500)]
    assert got[2]["codes"] == ["I10"] * 3


def test_too_many_categories_raise(spark):
    frame = spark.range(200).withColumn("few", F.col("id") % 3)
    assert V.categories(frame, ["few"], most=50) == {"few": ["0", "1", "2"]}
    with pytest.raises(ValueError, match="id"):
        V.categories(frame, ["id", "few"], most=50)


def test_unknown_drug_and_repeated_dictionary_keys(spark):
    drugs = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "person_id long, drug_code string")
    names = spark.createDataFrame([("a", "N02BE01"), ("a", "N02BE01")], "medication_code string, atc string")
    got = V.map_codes(drugs, names, "drug_code", "medication_code", "atc").collect()
    assert sorted((r["drug_code"] or "", r["atc"]) for r in got) == [("", "UNK"), ("a", "N02BE"), ("b", "UNK")]


def test_one_hot_of_null_is_all_zero(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id long, c string")
    got = {r["id"]: (r["c_x"], r["c_y"]) for r in V.one_hot(df, V.categories(df, ["c"])).collect()}
    assert got == {1: (1, 0), 2: (0, 1), 3: (0, 0)}


def test_first_code_by_date_or_by_position(spark):
    rows = [(1, 0, "U071", DAY("2021-01-01")), (1, 1, "U071", DAY("2020-01-01")), (2, 0, "I10", INDEX)]
    early = V.first_date_of_code(codes(spark, rows), "person_id", "U07", "d").collect()
    placed = V.first_date_of_code(codes(spark, rows), "person_id", "U07", "d", position="pos").collect()
    assert [(r["person_id"], str(r["d"])) for r in early] == [(1, "2020-01-01")]
    assert [(r["person_id"], str(r["d"])) for r in placed] == [(1, "2021-01-01")]


def test_code_families_keep_positions_across_families(spark):
    df = spark.createDataFrame([(1, "A", None, "C", "2020-01-01", None, "2020-01-03")], "id long, a string, b string, c string, x string, y string, z string").toDF(
        "id", "41270-0.0", "41270-0.1", "41271-0.0", "41280-0.0", "41280-0.1", "41281-0.0"
    )
    got = Wd.code_families_to_long(df, "id", [("41270", "41280"), ("41271", "41281")]).collect()
    assert [(r["pos"], r["code"], str(r["code_date"])) for r in got] == [(0, "A", "2020-01-01"), (2, "C", "2020-01-03")]


def test_eligibility(spark):
    rows = [
        (1, None, None, "1949-06-01"),  # pool, old enough
        (2, None, None, "1955-01-01"),  # pool, too young
        (3, "2020-05-01", None, "1945-01-01"),
        (4, "2020-02-01", "2020-05-01", "1945-01-01"),  # too early
        (5, None, "2020-05-01", "1955-01-01"),  # exposed, too young
    ]
    df = spark.createDataFrame(rows, "id long, p string, d string, b string")
    df = df.withColumns({c: F.col(c).cast("date") for c in "pdb"})
    keep = V.eligibility_filter("p", "d", "b", pool_date="2015-01-01", earliest_exposure="2020-03-01")
    assert [r["id"] for r in df.where(keep).orderBy("id").collect()] == [1, 3]


def test_special_columns_of_the_biobank(spark):
    names = ["blood_pressure_systolic_manual", "blood_pressure_systolic_manual.1", "blood_pressure_systolic_automatic",
             "blood_pressure_systolic_automatic.1", "education", "education.1", "deprivation_england", "deprivation_wales"]
    rows = [(120.0, 130.0, 100.0, 100.0, 3.0, 2.0, None, 5.0), (120.0, None, 100.0, 110.0, None, 6.0, 1.0, None)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(8))).toDF(*names)
    got = [r.asDict() for r in plan.biobank_specials(df).collect()]
    assert got == [
        {"education": 2.0, "blood_pressure_systolic": 125.0, "deprivation": 5.0},
        {"education": 6.0, "blood_pressure_systolic": 105.0, "deprivation": 1.0},
    ]
