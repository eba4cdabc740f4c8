"""Queries on readers, writers and the three stages end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from epispan.functions import codes as C
from epispan.operators import designs
from epispan.operators import wide as Wd
from epispan.params import FitParams
from epispan.plans import cohort as stage_one
from epispan.plans import covariates as stage_two
from epispan.plans import estimation as stage_three
from epispan.plans import experiments as stages
from epispan.registry.base import query
from epispan.registry.cohort import C1, C2, C3
from epispan.registry.covariate import (
    ASOF_TAIL,
    FEATURES_TAIL,
    ICD,
    IN_WINDOW,
    KEYS,
    ATC,
    test_results,
    wide_codes,
)
from epispan.registry.estimation import MOMENTS, ROUNDED, step_estimates
from epispan.registry.sql import CODED, PERSONS, cohorts
from epispan.registry.statistic import _fold_sql, fold_metrics
from epispan.operators.summaries import unpivot_metrics
from epispan.session import cut, scratch_path
from epispan.sources import sinks
from epispan.sources import surrogate as S
from epispan.sources import tables


def concurrent(spark, sf):
    return designs.build_cohorts(S.person_dates(spark, sf), [C2], S.COLUMNS, S.PARAMS)


@query("read_person_dates", "S1 D1", f"WITH {PERSONS} SELECT * FROM persons")
def _persons(spark, sf):
    path = scratch_path(spark, "persons")
    S.person_dates(spark, sf).write.csv(path, header=True)
    return tables.read_person_dates(spark, path, S.COLUMNS)


@query(
    "read_dated_cohort",
    "S2 S8 D2",
    f"""WITH {cohorts([C2])} SELECT person_id, exposed, index_date, round(age_at_index, 2) AS age_at_index,
    event_time, event_indicator FROM cohort""",
)
def _dated(spark, sf):
    path = scratch_path(spark, "dated")
    sinks.write_csv(concurrent(spark, sf).drop("experiment"), path)
    return tables.read_dated_cohort(spark, path, S.COLUMNS)


@query(
    "write_cohort",
    "S8 S3 D2",
    f"""WITH {cohorts([C1, C2, C3])} SELECT experiment, exposed, count(*) AS n, CAST(sum(event_time) AS BIGINT) AS person_days
    FROM cohort GROUP BY ALL""",
)
def _write(spark, sf):
    path = scratch_path(spark, "cohorts")
    rows = designs.build_cohorts(S.person_dates(spark, sf), [C1, C2, C3], S.COLUMNS, S.PARAMS)
    sinks.write_cohort(rows, path)
    return (
        tables.read_design_matrix(spark, path)
        .groupBy("experiment", "exposed")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("event_time").alias("person_days"))
    )


@query(
    "write_event_counts",
    "S12 A1",
    f"""WITH {cohorts([C2])} SELECT experiment, exposed, count(*) FILTER (WHERE event_indicator = 0) AS n_censored,
      count(*) FILTER (WHERE event_indicator = 1) AS n_event, count(*) FILTER (WHERE event_indicator = 2) AS n_death
    FROM cohort GROUP BY ALL""",
)
def _counts(spark, sf):
    path = scratch_path(spark, "counts")
    sinks.write_event_counts(designs.event_counts(concurrent(spark, sf), ["experiment"]), path)
    schema = "experiment string, exposed boolean, n_censored bigint, n_event bigint, n_death bigint"
    return spark.read.schema(schema).csv(path, header=True)


@query(
    "read_glob_tsv",
    "S6 U2 D7 T1",
    """SELECT o_custkey AS eid, CAST(o_orderdate AS DATE) AS specdate, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS result
    FROM orders WHERE o_orderpriority = '1-URGENT'""",
)
def _tsv(spark, sf):
    path = scratch_path(spark, "tests")
    rows = test_results(spark, sf).withColumnRenamed("person_id", "eid")
    slash = F.col("eid") % 2 == 0
    text = F.when(slash, F.date_format("specdate", "dd/MM/yyyy")).otherwise(
        F.date_format("specdate", "yyyy-MM-dd")
    )
    rows = rows.withColumn("specdate", text)
    for name, part in (("covid19_result_a", rows.where(slash)), ("covid19_result_b", rows.where(~slash))):
        part.write.csv(f"{path}/{name}", sep="\t", header=True)
    return tables.read_glob_tsv(spark, f"{path}/covid19_result*")


@query(
    "read_code_map",
    "S7 D6",
    """SELECT p_partkey AS medication_code, substr(p_type, 1, 1) || lpad(CAST(p_size AS VARCHAR), 2, '0') || 'AB' || substr(p_brand, 7, 2) AS atc
    FROM part WHERE p_partkey % 10 <> 0""",
)
def _map(spark, sf):
    path = scratch_path(spark, "map")
    S.drug_map(spark, sf).write.csv(path, header=True)
    return tables.read_code_map(spark, path, key_type="bigint")


@query(
    "read_wide_main",
    "S4 D3",
    """SELECT o_custkey AS eid, CAST(max(o_orderdate) FILTER (WHERE year(o_orderdate) = 1996) AS DATE) AS visit_date,
      min(o_totalprice) FILTER (WHERE year(o_orderdate) = 1996) AS reading FROM orders GROUP BY 1
    UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
)
def _wide(spark, sf):
    path = scratch_path(spark, "wide")
    S.wide_main(spark, sf).write.csv(path, header=True)
    rows = tables.read_wide_main(spark, path, "eid", "53", columns=["53-1.0", "102-1.0"])
    return rows.select("eid", Wd.quoted("53-1.0").alias("visit_date"), Wd.quoted("102-1.0").alias("reading"))


@query(
    "read_code_families",
    "S5 D4",
    """SELECT o_custkey AS person_id, CAST(year(o_orderdate) - 1995 AS INTEGER) AS pos,
      arg_min(o_orderpriority, o_orderkey) AS code, CAST(arg_min(o_orderdate, o_orderkey) AS DATE) AS code_date
    FROM orders GROUP BY 1, 2""",
)
def _families(spark, sf):
    path = scratch_path(spark, "families")
    wide_codes(spark, sf).write.csv(path, header=True)
    rows = tables.read_code_families(spark, path, "person_id", ["41280", "41281"])
    return Wd.code_families_to_long(rows, "person_id", [("41270", "41280"), ("41271", "41281")])


@query(
    "write_estimates",
    "S10 D12",
    f"WITH {MOMENTS} SELECT event, target_time, type, arm, "
    + ", ".join(f"round({c}, 7) AS {c}" for c in ROUNDED)
    + ", false AS g_comp FROM est",
)
def _estimates(spark, sf):
    path = scratch_path(spark, "estimates")
    sinks.write_estimates(step_estimates(spark, sf).withColumn("g_comp", F.lit(False)), path)
    schema = "event int, target_time double, arm int, estimate double, se double, lo double, hi double, type string, g_comp boolean"
    rows = spark.read.schema(schema).csv(path, header=True)
    return rows.withColumns({c: F.round(c, 7) for c in ROUNDED})


@query(
    "write_metrics",
    "S11 D11",
    f"WITH {_fold_sql()} SELECT fold, metric, endpoint, round(value, 8) AS value FROM fm",
)
def _metrics(spark, sf):
    path = scratch_path(spark, "metrics")
    sinks.write_metrics(unpivot_metrics(fold_metrics(spark, sf), "fold", "composite"), path)
    schema = "fold int, metric string, endpoint string, value double"
    rows = spark.read.schema(schema).json(path)
    return rows.withColumn("value", F.round("value", 8))


def biobank(spark, sf) -> stage_two.Biobank:
    codes = S.coded_history(spark, sf)
    return stage_two.Biobank(
        main=S.wide_main(spark, sf),
        diagnoses=codes.select("person_id", "pos", "code", "code_date"),
        drugs=codes.select("person_id", "pos", "drug_code", "code_date"),
        drug_map=S.drug_map(spark, sf),
        fields=S.FIELDS,
        patterns=S.PATTERNS,
        one_hot=("education",),
    )


def merged_rows(spark, sf):
    cohort = cut(concurrent(spark, sf).drop("experiment"), "cohort")
    source = biobank(spark, sf)
    return cohort, source, stage_two.merge_covariates(cohort, source, KEYS, "person_id")


LEVELS = tuple(f"{k}.0" for k in range(2, 10))
MERGED = f"""{cohorts([C2])}, co AS (SELECT person_id, index_date FROM cohort), {ASOF_TAIL.replace("index_date GROUP BY ALL", "index_date WHERE value <> -1 GROUP BY ALL")}, {FEATURES_TAIL},
merged AS (
  SELECT c.* EXCLUDE (experiment), l.bmi, l.pressure, l.pressure_1, l.education, CAST(c_nationkey % 2 AS DOUBLE) AS sex,
    f.num_diagnoses, f.num_drugs, f.econ_early, f.promo_45, f.small_1, f.any_large
  FROM cohort c JOIN latest l USING (person_id) JOIN features f USING (person_id) JOIN customer ON c_custkey = person_id)
"""


@query(
    "merge_covariates",
    "J1 J3 J5 A3 A4 A5 P18 P19 D8",
    f"WITH {MERGED} SELECT * REPLACE (round(age_at_index, 6) AS age_at_index) FROM merged",
)
def _merge(spark, sf):
    _, _, merged = merged_rows(spark, sf)
    rows = merged.withColumn("age_at_index", F.round("age_at_index", 6))
    return rows.withColumnRenamed("pressure.1", "pressure_1")


@query(
    "design_matrix",
    "P24 D8 S3 S8",
    f"""WITH {MERGED}, l AS (SELECT DISTINCT education FROM merged WHERE education IS NOT NULL)
    SELECT person_id, education, CAST(1 AS INTEGER) AS hot FROM merged WHERE education IS NOT NULL""",
)
def _design(spark, sf):
    _, _, merged = merged_rows(spark, sf)
    path = scratch_path(spark, "design")
    stage_two.design_matrix(merged, ("education",)).drop("pressure.1").write.parquet(path)
    rows = tables.read_design_matrix(spark, path)
    hot = [c for c in rows.columns if c.startswith("education_")]
    cells = F.array(
        *[
            F.struct(F.lit(float(c.split("_")[1])).alias("education"), Wd.quoted(c).alias("hot"))
            for c in hot
        ]
    )
    return rows.select("person_id", F.inline(F.filter(cells, lambda c: c["hot"] == 1)))


def _list_sql(code: str, name: str) -> str:
    return f"""(SELECT c.person_id, array_to_string(list({code} ORDER BY pos, {code}, code_date), '|') AS {name},
      array_to_string(list(strftime(code_date, '%Y%m%d') ORDER BY pos, {code}, code_date), '|') AS {name}_dates
      FROM co JOIN coded c ON c.person_id = co.person_id LEFT JOIN atc_map ON medication_code = drug_code
      WHERE {IN_WINDOW} GROUP BY c.person_id)"""


@query(
    "write_patient_json",
    "S9 D9 A6 P25 P26 X1",
    f"""WITH {MERGED} SELECT m.person_id, round(age_at_index, 6) AS age_at_index,
      CASE WHEN sex = 0 THEN 'Female' ELSE 'Male' END AS sex, strftime(index_date, '%Y%m%d') AS index_date,
      coalesce(d.d, '') AS diagnoses, coalesce(d.d_dates, '') AS diagnosis_dates, coalesce(g.g, '') AS drugs, coalesce(g.g_dates, '') AS prescription_dates,
      event_time AS time_to_endpoint, CASE event_indicator WHEN 0 THEN '' WHEN 1 THEN 'composite' ELSE 'death' END AS endpoint_label,
      exposed, bmi, education, any_large
    FROM merged m LEFT JOIN {_list_sql(ICD, "d")} d USING (person_id) LEFT JOIN {_list_sql(ATC, "g")} g USING (person_id)""",
)
def _json(spark, sf):
    cohort, source, merged = merged_rows(spark, sf)
    arrays = stage_two.code_arrays(cohort, source, KEYS, "person_id")
    records = stage_two.patient_json(merged.drop("pressure.1"), arrays, KEYS, "composite")
    path = scratch_path(spark, "records")
    sinks.write_patient_json(records, path, "person_id")
    schema = """person_id bigint, age_at_index double, sex string, index_date string, diagnoses array<string>,
      diagnosis_dates array<string>, drugs array<string>, prescription_dates array<string>, time_to_endpoint int,
      endpoint_labels array<string>, exposed boolean, additional_features struct<bmi double, education double, any_large boolean>"""
    rows = spark.read.schema(schema).json(path)
    lists = ("diagnoses", "diagnosis_dates", "drugs", "prescription_dates")
    return rows.select(
        *[c for c in rows.columns if c not in (*lists, "endpoint_labels", "additional_features", "age_at_index")],
        F.round("age_at_index", 6).alias("age_at_index"),
        *[F.array_join(c, "|").alias(c) for c in lists],
        F.col("endpoint_labels")[0].alias("endpoint_label"),
        "additional_features.*",
    )


@query(
    "cohort_stage",
    "S8 S12 A1 A9 C4",
    f"""WITH {cohorts([C1, C2, C3])}, x AS (SELECT experiment, exposed, age_at_index AS v FROM cohort),
    e AS (SELECT *, min(v) OVER (PARTITION BY experiment) AS lo, max(v) OVER (PARTITION BY experiment) AS hi FROM x)
    SELECT experiment, CAST(least(floor((v - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, count(*) FILTER (WHERE exposed) AS n_exposed,
      count(*) FILTER (WHERE NOT exposed) AS n_control FROM e GROUP BY ALL""",
)
def _stage_one(spark, sf):
    out = scratch_path(spark, "stage")
    persons = S.person_dates(spark, sf)
    stage_one.run_cohorts(spark, persons, [C1, C2, C3], out, S.COLUMNS, S.PARAMS)
    rows = spark.read.parquet(f"{out}/histograms").where("feature = 'age_at_index'")
    rows = rows.where(F.col("n_exposed") + F.col("n_control") > 0)
    return rows.select("experiment", "bin", "n_exposed", "n_control")


@query("estimation_stage", "S3 S10 S11 A26 M22 T2 J9 M15 M17 M18 M19 M20 M21")
def _stage_three(spark, sf):
    _, _, merged = merged_rows(spark, sf)
    design = cut(
        stage_two.design_matrix(merged, ("education",)).drop("pressure.1", "pressure"), "design"
    )
    params = FitParams(
        exclude_columns=("person_id", "index_date"),
        control_subsample_factor=3.0,
        caliper=0.5,
        match_calibrate=False,
        match_grid_search=False,
        n_folds_outer=2,
        tune=False,
        target_times=(200, 400, 600),
        grid_size=12,
        max_updates=10,
    )
    small = {"forest": {"numTrees": 10}, "gbt": {"maxIter": 3, "maxDepth": 3, "stepSize": 0.1}}
    result = stage_three.run_estimation(
        design, params, "person_id", "exposed", learner="logistic", propensity_settings=small
    )
    return result.estimates


ASOF_ALL = ASOF_TAIL.replace("index_date GROUP BY ALL", "index_date WHERE value <> -1 GROUP BY ALL")
ASOF_ALL = ASOF_ALL.replace("SELECT person_id", "SELECT experiment, person_id")
ASOF_ALL = ASOF_ALL.replace("USING (person_id) GROUP BY person_id", "USING (experiment, person_id) GROUP BY experiment, person_id")
FEATURES_ALL = FEATURES_TAIL.replace("SELECT co.person_id", "SELECT co.experiment, co.person_id")
FEATURES_ALL = FEATURES_ALL.replace("GROUP BY co.person_id", "GROUP BY co.experiment, co.person_id")


def all_designs(spark, sf):
    cohorts_of_all = cut(designs.build_cohorts(S.person_dates(spark, sf), [C1, C2, C3], S.COLUMNS, S.PARAMS), "cohorts")
    return stages.experiment_designs(cohorts_of_all, biobank(spark, sf), "person_id", drop=("pressure.1",))


@query(
    "experiment_designs",
    "J16 J1 J3 J5 A3 A4 A5 P24",
    f"""WITH {cohorts([C1, C2, C3])}, co AS (SELECT experiment, person_id, index_date FROM cohort), {ASOF_ALL}, {FEATURES_ALL}
    SELECT c.experiment, c.person_id, c.exposed, c.index_date, c.event_time, c.event_indicator, round(c.age_at_index, 6) AS age_at_index,
      l.bmi, l.pressure, l.education, CAST(c_nationkey % 2 AS DOUBLE) AS sex,
      f.num_diagnoses, f.num_drugs, f.econ_early, f.promo_45, f.small_1, f.any_large
    FROM cohort c JOIN latest l USING (experiment, person_id) JOIN features f USING (experiment, person_id)
    JOIN customer ON c_custkey = person_id""",
)
def _experiment_designs(spark, sf):
    rows = all_designs(spark, sf)
    hot = [c for c in rows.columns if c.startswith("education_")]
    # every person has one indicator or none, so the indicators give the level back
    level = F.coalesce(*[F.when(Wd.quoted(c) == 1, F.lit(float(c.split("_")[1]))) for c in hot])
    return rows.withColumns({"education": level, "age_at_index": F.round("age_at_index", 6)}).drop(*hot)
