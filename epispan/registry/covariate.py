"""Queries on covariates at the index date."""

from __future__ import annotations

from pyspark.sql import functions as F

from epispan.functions import codes as C
from epispan.functions import dates as D
from epispan.operators import covariates as V
from epispan.operators import wide as Wd
from epispan.registry.base import query
from epispan.registry.cohort import dated
from epispan.registry.sql import CODED, PERSONS, VISITS
from epispan.sources import surrogate as S

KEYS = ["person_id"]


def indexed(spark, sf):
    """All exposed persons with their index date."""
    rows = dated(spark, sf).where(F.col("index_date").isNotNull())
    return rows.select("person_id", "index_date")


def named_wide(spark, sf):
    mapping = {**S.FIELDS, "53": "visit_date"}
    return Wd.rename_fields(S.wide_main(spark, sf), mapping)


def wide_at_index(spark, sf):
    wide = named_wide(spark, sf).withColumnRenamed("eid", "person_id")
    return indexed(spark, sf).join(wide, "person_id", "left")


COHORT = f"{PERSONS}, co AS (SELECT person_id, index_date FROM dated WHERE index_date IS NOT NULL)"
FIELD_NAME = "CASE field WHEN '101' THEN 'bmi' WHEN '102' THEN 'pressure' ELSE 'education' END"

ASOF_TAIL = f"""{VISITS},
latest_long AS (
  SELECT person_id, {FIELD_NAME} AS field, arr, arg_max(value, (visit_date, visit)) AS value
  FROM co JOIN long_values ON eid = person_id AND visit_date <= index_date GROUP BY ALL),
latest AS (
  SELECT person_id,
    max(value) FILTER (WHERE field = 'bmi') AS bmi,
    max(value) FILTER (WHERE field = 'education') AS education,
    max(value) FILTER (WHERE field = 'pressure' AND arr = 0) AS pressure,
    max(value) FILTER (WHERE field = 'pressure' AND arr = 1) AS pressure_1
  FROM co LEFT JOIN latest_long USING (person_id) GROUP BY person_id)
"""
ASOF = f"{COHORT}, {ASOF_TAIL}"


@query(
    "rename_fields",
    "P16 P17 S4",
    """SELECT c_custkey AS eid, CAST(c_nationkey % 2 AS DOUBLE) AS sex FROM customer""",
)
def _rename(spark, sf):
    picked = Wd.select_by_regex(named_wide(spark, sf), r"^(eid$|sex-)")
    return picked.select("eid", Wd.quoted("sex-0.0").alias("sex"))


@query(
    "wide_to_long",
    "P19 D3",
    f"""WITH {VISITS} SELECT eid, {FIELD_NAME} AS field, visit, arr, visit_date, value FROM long_values""",
)
def _long(spark, sf):
    return Wd.wide_to_long(named_wide(spark, sf), "eid")


@query(
    "static_columns",
    "P19",
    "SELECT c_custkey AS eid, CAST(c_nationkey % 2 AS DOUBLE) AS sex FROM customer",
)
def _static(spark, sf):
    return Wd.static_columns(named_wide(spark, sf), ["eid"])


@query(
    "set_to_missing",
    "P18",
    f"""WITH {VISITS} SELECT eid, visit, CASE WHEN value <> -1 THEN value END AS education
    FROM long_values WHERE field = '103'""",
)
def _missing(spark, sf):
    long = Wd.wide_to_long(named_wide(spark, sf), "eid").where(F.col("field") == "education")
    shown = long.select("eid", "visit", F.col("value").alias("education"))
    return V.set_to_missing(shown, ["education"], [-1, -3, -7])


@query("asof_latest_visit", "J5", f"WITH {ASOF} SELECT * FROM latest_long")
def _asof(spark, sf):
    long = Wd.wide_to_long(named_wide(spark, sf), "eid").withColumnRenamed("eid", "person_id")
    return V.asof_latest_visit(long, indexed(spark, sf), KEYS, "person_id")


@query("asof_from_wide", "J5 J15", f"WITH {ASOF} SELECT * FROM latest")
def _asof_wide(spark, sf):
    rows = Wd.asof_from_wide(wide_at_index(spark, sf), KEYS, "index_date")
    return rows.withColumnRenamed("pressure.1", "pressure_1")


@query(
    "asof_over_orders",
    "J5",
    f"""WITH {COHORT} SELECT person_id, arg_max(day_price, d) AS latest_price
    FROM co JOIN (SELECT o_custkey, d, arg_max(price, o_orderkey) AS day_price FROM ord GROUP BY 1, 2)
      ON o_custkey = person_id AND d <= index_date GROUP BY person_id""",
)
def _asof_orders(spark, sf):
    long = S.orders(spark, sf).select(
        F.col("o_custkey").alias("person_id"),
        F.lit("price").alias("field"),
        F.lit(0).alias("arr"),
        F.col("o_orderkey").alias("visit"),
        F.col("o_orderdate").alias("visit_date"),
        F.col("o_totalprice").alias("value"),
    )
    rows = V.asof_latest_visit(long, indexed(spark, sf), KEYS, "person_id")
    return rows.select("person_id", F.col("value").alias("latest_price"))


@query(
    "carry_forward",
    "W1",
    """WITH y AS (
      SELECT o_custkey AS eid, CAST(year(o_orderdate) - 1995 AS INTEGER) AS visit,
        CASE WHEN count(*) > 1 THEN max(o_totalprice) END AS value FROM orders GROUP BY 1, 2)
    SELECT eid, visit, last_value(value IGNORE NULLS) OVER (PARTITION BY eid ORDER BY visit
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM y""",
)
def _carry(spark, sf):
    yearly = (
        S.orders(spark, sf)
        .groupBy(F.col("o_custkey").alias("eid"), (F.year("o_orderdate") - 1995).alias("visit"))
        .agg(F.when(F.count(F.lit(1)) > 1, F.max("o_totalprice")).alias("value"))
    )
    return V.carry_forward(yearly, ["eid"], "visit", "value")


@query(
    "special_columns",
    "P20 P21 P22",
    f"""WITH {ASOF} SELECT person_id, least(bmi, pressure, education) AS smallest,
    round(coalesce((pressure + pressure_1) / 2, pressure), 4) AS pressure_mean,
    coalesce(education, bmi, pressure) AS first_known FROM latest""",
)
def _special(spark, sf):
    rows = Wd.asof_from_wide(wide_at_index(spark, sf), KEYS, "index_date")
    second = Wd.quoted("pressure.1")
    mean = C.mean_of_repeats(["pressure", second])
    return rows.select(
        "person_id",
        C.row_min(["bmi", "pressure", "education"]).alias("smallest"),
        F.round(C.prefer(mean, F.col("pressure")), 4).alias("pressure_mean"),
        F.coalesce("education", "bmi", "pressure").alias("first_known"),
    )


@query(
    "attach_main",
    "J1",
    f"""WITH {COHORT} SELECT person_id, index_date, c_acctbal, c_mktsegment
    FROM co LEFT JOIN customer ON c_custkey = person_id""",
)
def _attach(spark, sf):
    main = S.table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return V.attach_main(indexed(spark, sf), main, "person_id", "c_custkey")


@query(
    "keep_cohort_persons",
    "J2",
    f"""WITH {COHORT}, {CODED} SELECT person_id, count(*) AS n_codes FROM coded
    WHERE person_id IN (SELECT person_id FROM co) GROUP BY person_id""",
)
def _keep(spark, sf):
    kept = V.keep_cohort_persons(S.coded_history(spark, sf), indexed(spark, sf), "person_id")
    return kept.groupBy("person_id").agg(F.count(F.lit(1)).alias("n_codes"))


IN_WINDOW = "code_date > index_date - 5 * 365 AND code_date <= index_date"
FEATURES_TAIL = f"""{CODED}, features AS (
  SELECT co.person_id, count(code) FILTER (WHERE {IN_WINDOW}) AS num_diagnoses,
    count(drug_code) FILTER (WHERE {IN_WINDOW}) AS num_drugs,
    coalesce(bool_or(regexp_matches(code, '^(?:E[01].*)') AND code_date <= index_date), false) AS econ_early,
    coalesce(bool_or(regexp_matches(code, '^(?:P[45].*)') AND code_date <= index_date), false) AS promo_45,
    coalesce(bool_or(regexp_matches(code, '^(?:S1.*)') AND code_date <= index_date), false) AS small_1,
    coalesce(bool_or(regexp_matches(code, '^(?:L.*)') AND code_date <= index_date), false) AS any_large,
    CAST(date_diff('day', max(code_date) FILTER (WHERE code_date <= index_date), any_value(index_date)) AS INTEGER) AS days_since_last
  FROM co LEFT JOIN coded c ON c.person_id = co.person_id GROUP BY co.person_id)
"""
FEATURES = f"{COHORT}, {FEATURES_TAIL}"


def diagnosis_features(spark, sf):
    cohort = indexed(spark, sf)
    found = V.code_features(
        S.coded_history(spark, sf), cohort, KEYS, "person_id", S.PATTERNS, days_since_last=True
    )
    return V.complete_features(
        cohort.select("person_id"), found, KEYS, ["num_diagnoses"], list(S.PATTERNS)
    )


def drug_counts(spark, sf):
    cohort = indexed(spark, sf)
    drugs = S.coded_history(spark, sf)
    found = V.code_features(
        drugs, cohort, KEYS, "person_id", {}, count_name="num_drugs", code="drug_code"
    )
    return V.complete_features(cohort.select("person_id"), found, KEYS, ["num_drugs"], [])


@query(
    "code_count_lookback",
    "A3 J6 A7",
    f"WITH {FEATURES} SELECT person_id, num_diagnoses, days_since_last FROM features",
)
def _counts(spark, sf):
    return diagnosis_features(spark, sf).select("person_id", "num_diagnoses", "days_since_last")


@query(
    "any_code_before",
    "A4 J7",
    f"WITH {FEATURES} SELECT person_id, econ_early, promo_45, small_1, any_large FROM features",
)
def _flags(spark, sf):
    return diagnosis_features(spark, sf).select("person_id", *S.PATTERNS)


@query(
    "drug_count_lookback",
    "A5 J6 D5",
    f"WITH {FEATURES} SELECT person_id, num_drugs FROM features",
)
def _drugs(spark, sf):
    return drug_counts(spark, sf)


@query(
    "attach_features",
    "J3",
    f"""WITH {FEATURES} SELECT person_id, num_diagnoses, num_drugs, econ_early, promo_45, small_1,
    any_large, days_since_last FROM features""",
)
def _attach_features(spark, sf):
    cohort = indexed(spark, sf).select("person_id")
    return V.attach_features(
        cohort, [diagnosis_features(spark, sf), drug_counts(spark, sf)], KEYS
    )


@query(
    "map_codes",
    "J8 D6 S7",
    f"""WITH {CODED} SELECT coalesce(substr(atc, 1, 5), 'UNK') AS atc, count(*) AS n,
      count(DISTINCT person_id) AS persons
    FROM coded LEFT JOIN atc_map ON medication_code = drug_code GROUP BY 1""",
)
def _map(spark, sf):
    mapped = V.map_codes(
        S.coded_history(spark, sf).select("person_id", "drug_code"),
        S.drug_map(spark, sf),
        "drug_code",
        "medication_code",
        "atc",
    )
    per_person = mapped.groupBy("atc", "person_id").agg(F.count(F.lit(1)).alias("n"))
    return per_person.groupBy("atc").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("persons")
    )


ICD = "trim(rtrim(rtrim(rtrim(CASE WHEN length(code) > 3 THEN substr(code, 1, 3) || '.' || substr(code, 4) ELSE code END, 'A'), 'D'), 'S'), 'X')"


@query(
    "format_icd",
    "X1",
    f"WITH {CODED} SELECT code, {ICD} AS formatted, count(*) AS n FROM coded GROUP BY code",
)
def _icd(spark, sf):
    counts = S.coded_history(spark, sf).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("formatted", C.format_icd("code"))


def _code_arrays(spark, sf):
    return V.collect_code_arrays(
        S.coded_history(spark, sf),
        indexed(spark, sf),
        KEYS,
        "person_id",
        C.format_icd("code"),
        "diagnoses",
        "diagnosis_dates",
    )


def _drug_arrays(spark, sf):
    mapped = V.map_codes(
        S.coded_history(spark, sf), S.drug_map(spark, sf), "drug_code", "medication_code", "atc"
    )
    return V.collect_code_arrays(
        mapped,
        indexed(spark, sf),
        KEYS,
        "person_id",
        F.col("atc"),
        "drugs",
        "prescription_dates",
    )


def _array_sql(code: str, codes_name: str, dates_name: str) -> str:
    return f"""(
      SELECT co.person_id,
        list({code} ORDER BY pos, {code}, code_date) AS {codes_name},
        list(strftime(code_date, '%Y%m%d') ORDER BY pos, {code}, code_date) AS {dates_name}
      FROM co JOIN coded c ON c.person_id = co.person_id
        LEFT JOIN atc_map ON medication_code = drug_code
      WHERE {IN_WINDOW} GROUP BY co.person_id)"""


ATC = "coalesce(substr(atc, 1, 5), 'UNK')"


@query(
    "collect_code_arrays",
    "A6",
    f"""WITH {COHORT}, {CODED} SELECT person_id,
      array_to_string(diagnoses, '|') AS diagnoses, array_to_string(diagnosis_dates, '|') AS diagnosis_dates
    FROM {_array_sql(ICD, "diagnoses", "diagnosis_dates")}""",
)
def _arrays(spark, sf):
    arrays = _code_arrays(spark, sf)
    return arrays.withColumns(
        {c: F.array_join(c, "|") for c in ("diagnoses", "diagnosis_dates")}
    )


@query(
    "collect_drug_arrays",
    "A6 J8",
    f"""WITH {COHORT}, {CODED} SELECT person_id,
      array_to_string(drugs, '|') AS drugs, array_to_string(prescription_dates, '|') AS prescription_dates
    FROM {_array_sql(ATC, "drugs", "prescription_dates")}""",
)
def _drug_lists(spark, sf):
    arrays = _drug_arrays(spark, sf)
    return arrays.withColumns({c: F.array_join(c, "|") for c in ("drugs", "prescription_dates")})


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    "one_hot",
    "P23 P24 D8",
    "SELECT c_custkey AS person_id, "
    + ", ".join(
        f"CASE WHEN c_mktsegment = '{s}' AND c_acctbal >= 0 THEN 1 ELSE 0 END AS segment_{s}"
        for s in SEGMENTS
    )
    + " FROM customer",
)
def _one_hot(spark, sf):
    known = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))
    rows = S.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("person_id"), known.alias("segment")
    )
    return V.one_hot(rows, V.categories(rows, ["segment"]))


@query(
    "recode",
    "P25",
    """SELECT c_custkey AS person_id, CASE c_nationkey % 2 WHEN 0 THEN 'Female' ELSE 'Male' END AS sex,
    CASE c_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'composite' ELSE 'death' END AS label FROM customer""",
)
def _recode(spark, sf):
    nation = F.col("c_nationkey")
    return S.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("person_id"),
        C.sex_label(nation % 2, False).alias("sex"),
        C.endpoint_label(nation % 3, "composite").alias("label"),
    )


@query(
    "pack_features",
    "P26",
    """SELECT c_custkey AS person_id, '{"c_acctbal":' || CAST(CAST(c_acctbal AS INTEGER) AS VARCHAR)
    || ',"c_mktsegment":"' || c_mktsegment || '"}' AS additional_features FROM customer""",
)
def _pack(spark, sf):
    rows = S.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("person_id"),
        F.rint("c_acctbal").cast("int").alias("c_acctbal"),
        "c_mktsegment",
    )
    packed = V.pack_features(rows, ["c_acctbal", "c_mktsegment"])
    return packed.withColumn("additional_features", F.to_json("additional_features"))


@query(
    "birth_date_from_year",
    "P27",
    "SELECT c_custkey AS person_id, make_date(1921 + c_nationkey, 1, 1) AS birth_date FROM customer",
)
def _birth(spark, sf):
    return S.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("person_id"),
        D.birth_date_from_year(F.lit(1921) + F.col("c_nationkey")).alias("birth_date"),
    )


OVERRIDES = (("PEDW", "2001-03-31"), ("SMR", "2001-05-31"))


def raw_sources(spark, sf):
    """Customer as a main table with three data-source columns."""
    nation = F.col("c_nationkey")
    return S.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("person_id"),
        (F.lit(1921) + nation).alias("birth_year"),
        F.when(nation % 3 == 0, "SMR").alias("source_0"),
        F.when(nation % 4 == 0, "PEDW").otherwise("HES").alias("source_1"),
        F.when(nation % 5 == 0, "SMR").alias("source_2"),
    )


REGION = """CASE WHEN c_nationkey % 4 = 0 THEN DATE '2001-03-31'
  WHEN c_nationkey % 3 = 0 OR c_nationkey % 5 = 0 THEN DATE '2001-05-31' ELSE DATE '2001-08-01' END"""


def region():
    return D.region_limit(["source_0", "source_1", "source_2"], OVERRIDES, "2001-08-01")


@query("region_censoring", "P28", f"SELECT c_custkey AS person_id, {REGION} AS censoring_global FROM customer")
def _region(spark, sf):
    return raw_sources(spark, sf).select("person_id", region().alias("censoring_global"))


@query(
    "first_tests",
    "A2 J4",
    """SELECT c_custkey AS person_id, min(CAST(o_orderdate AS DATE)) AS date_first_tested,
    min(CAST(o_orderdate AS DATE)) FILTER (WHERE o_orderstatus = 'F') AS date_first_tested_positive
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'
    GROUP BY c_custkey""",
)
def _first_tests(spark, sf):
    persons = raw_sources(spark, sf).select("person_id")
    firsts = V.first_tests(
        test_results(spark, sf), "person_id", "specdate", F.col("result") == 1
    )
    return persons.join(firsts, "person_id", "left")


def test_results(spark, sf):
    urgent = S.orders(spark, sf).where(F.col("o_orderpriority") == "1-URGENT")
    return urgent.select(
        F.col("o_custkey").alias("person_id"),
        F.col("o_orderdate").alias("specdate"),
        (F.col("o_orderstatus") == "F").cast("int").alias("result"),
    )


@query(
    "first_date_of_code",
    "C6",
    f"""WITH {CODED} SELECT person_id, min(code_date) AS earliest,
      arg_min(code_date, (pos, code_date)) AS at_first_position
    FROM coded WHERE starts_with(code, 'E1') GROUP BY person_id""",
)
def _first_code(spark, sf):
    coded = S.coded_history(spark, sf)
    earliest = V.first_date_of_code(coded, "person_id", "E1", "earliest")
    placed = V.first_date_of_code(coded, "person_id", "E1", "at_first_position", position="pos")
    return earliest.join(placed, "person_id")


RAW = f"""{CODED}, raw AS (
  SELECT c_custkey AS person_id, make_date(1921 + c_nationkey, 1, 1) AS birth_date, {REGION} AS censoring_global,
    date_first_tested, date_first_tested_positive, date_first_diagnosis
  FROM customer
  LEFT JOIN (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS date_first_tested,
      min(CAST(o_orderdate AS DATE)) FILTER (WHERE o_orderstatus = 'F') AS date_first_tested_positive
    FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON o_custkey = c_custkey
  LEFT JOIN (SELECT person_id AS pid, min(code_date) AS date_first_diagnosis
    FROM coded WHERE starts_with(code, 'E1') GROUP BY 1) ON pid = c_custkey)
"""


def assembled(spark, sf):
    return V.build_person_dates(
        raw_sources(spark, sf),
        test_results(spark, sf),
        S.coded_history(spark, sf),
        id_col="person_id",
        birth_year="birth_year",
        exposure_prefix="E1",
        test_date="specdate",
        positive=F.col("result") == 1,
        region=region(),
    ).drop("birth_year", "source_0", "source_1", "source_2")


@query("build_person_dates", "C7 J4 J15", f"WITH {RAW} SELECT * FROM raw")
def _build(spark, sf):
    return assembled(spark, sf)


@query(
    "eligibility_filter",
    "P29",
    f"""WITH {RAW}, f AS (SELECT *, least(date_first_tested_positive, date_first_diagnosis) AS first_exposure FROM raw)
    SELECT person_id, first_exposure FROM f
    WHERE (first_exposure IS NULL AND date_diff('day', birth_date, DATE '1995-01-01') / 365.0 >= 65)
      OR (first_exposure >= DATE '1995-06-01' AND date_diff('day', birth_date, first_exposure) / 365.0 >= 70)""",
)
def _eligible(spark, sf):
    keep = V.eligibility_filter(
        "date_first_tested_positive",
        "date_first_diagnosis",
        "birth_date",
        pool_date="1995-01-01",
        earliest_exposure="1995-06-01",
    )
    first = F.least("date_first_tested_positive", "date_first_diagnosis")
    return assembled(spark, sf).where(keep).select("person_id", first.alias("first_exposure"))


@query(
    "code_families_to_long",
    "D4 S5 P17",
    """SELECT o_custkey AS person_id, CAST(year(o_orderdate) - 1995 AS INTEGER) AS pos,
      arg_min(o_orderpriority, o_orderkey) AS code,
      CAST(arg_min(o_orderdate, o_orderkey) AS DATE) AS code_date
    FROM orders GROUP BY 1, 2""",
)
def _families(spark, sf):
    return Wd.code_families_to_long(
        wide_codes(spark, sf), "person_id", [("41270", "41280"), ("41271", "41281")]
    )


def wide_codes(spark, sf):
    """One code and one date column per calendar year, split over two column families."""
    year = F.year("o_orderdate") - 1995
    yearly = (
        S.orders(spark, sf)
        .groupBy(F.col("o_custkey").alias("person_id"), year.alias("slot"))
        .agg(
            F.min_by("o_orderpriority", "o_orderkey").alias("code"),
            F.min_by("o_orderdate", "o_orderkey").alias("code_date"),
        )
    )
    picks = []
    for slot in range(7):
        family, place = ("0", slot) if slot < 4 else ("1", slot - 4)
        for source, prefix in (("code", "4127"), ("code_date", "4128")):
            value = F.max(F.when(F.col("slot") == slot, F.col(source)))
            picks.append(value.alias(f"{prefix}{family}-0.{place}"))
    return yearly.groupBy("person_id").agg(*picks)
