"""Covariate stage: attach baseline covariates of a wide biobank to dated cohorts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispan.functions import codes as C
from epispan.operators import covariates as V
from epispan.operators import wide as Wd
from epispan.operators.joins import BROADCAST_ROWS
from epispan.params import (
    BIOBANK_FIELDS,
    BIOBANK_MISSING,
    BIOBANK_ONE_HOT,
    BIOBANK_PATTERNS,
    BIOBANK_VISIT_FIELD,
)

COHORT_COLUMNS = ("exposed", "index_date", "age_at_index", "event_time", "event_indicator")


@dataclass(frozen=True)
class Biobank:
    """Raw sources and their layout: wide main table, long diagnoses and drugs, drug dictionary."""

    main: DataFrame
    diagnoses: DataFrame  # id, pos, code, code_date
    drugs: DataFrame  # id, pos, drug_code, code_date
    drug_map: DataFrame  # medication_code, atc
    main_id: str = "eid"
    fields: Mapping[str, str] = field(default_factory=lambda: dict(BIOBANK_FIELDS))
    visit_field: str = BIOBANK_VISIT_FIELD
    missing: Sequence[float] = BIOBANK_MISSING
    patterns: Mapping[str, str] = field(default_factory=lambda: dict(BIOBANK_PATTERNS))
    one_hot: Sequence[str] = BIOBANK_ONE_HOT


def main_covariates(cohort: DataFrame, source: Biobank, keys: Sequence[str], id_col: str) -> DataFrame:
    """Static and as-of covariates of the main table: one join, then expressions inside the row."""
    mapping = {**source.fields, source.visit_field: "visit_date"}
    named = Wd.rename_fields(source.main, mapping)
    layout = Wd.wide_layout(named.columns)
    known = set(mapping.values())
    keep = [c for c in named.columns if c == source.main_id or c.split("-")[0] in known]
    named = named.select(*[Wd.quoted(c) for c in keep])
    values = [c for c, *_ in layout.repeated if c in keep] + [c for c in layout.static if c in keep]
    named = V.set_to_missing(named, values, source.missing)
    rows = V.attach_main(cohort.select(*keys, "index_date"), named, id_col, source.main_id)
    latest = Wd.asof_columns(rows.columns, "index_date")
    return rows.select(*keys, *latest, *Wd.static_values(rows.columns))


def biobank_specials(frame: DataFrame) -> DataFrame:
    """Education, blood pressure and deprivation from their several raw columns, where present."""
    out, used = {}, []
    education = [c for c in frame.columns if c.split(".")[0] == "education"]
    if education:
        out["education"] = C.row_min([Wd.quoted(c) for c in education])
        used += [c for c in education if c != "education"]
    for side in ("systolic", "diastolic"):
        pairs = {}
        for kind in ("manual", "automatic"):
            name = f"blood_pressure_{side}_{kind}"
            if name in frame.columns and f"{name}.1" in frame.columns:
                pairs[kind] = C.mean_of_repeats([Wd.quoted(name), Wd.quoted(f"{name}.1")])
                used += [name, f"{name}.1"]
        if pairs:
            out[f"blood_pressure_{side}"] = F.coalesce(*pairs.values())
    regions = [c for c in ("deprivation_england", "deprivation_scotland", "deprivation_wales") if c in frame.columns]
    if regions:
        out["deprivation"] = F.coalesce(*[F.col(c) for c in regions])
        used += regions
    return frame.withColumns(out).drop(*used)


def merge_covariates(
    cohort: DataFrame, source: Biobank, keys: Sequence[str], id_col: str
) -> DataFrame:
    """Cohort with main covariates, diagnosis counts and flags, and drug counts.

    Diagnoses and drugs are reduced to one row per person and day before they meet the index
    dates, and before that to the cohort's persons where those are few enough to broadcast.
    """
    keys = list(keys)
    index = cohort.select(*keys, "index_date")
    persons = cohort.select(id_col).distinct()
    few = persons.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    main = biobank_specials(main_covariates(cohort, source, keys, id_col))
    diagnoses, drugs = source.diagnoses, source.drugs
    if few:
        diagnoses = V.keep_cohort_persons(diagnoses, F.broadcast(persons), id_col)
        drugs = V.keep_cohort_persons(drugs, F.broadcast(persons), id_col)
    found = V.code_features(diagnoses, index, keys, id_col, source.patterns)
    counted = V.code_features(
        drugs, index, keys, id_col, {}, count_name="num_drugs", code="drug_code"
    )
    merged = V.attach_features(cohort, [main], keys)
    merged = V.complete_features(merged, found, keys, ["num_diagnoses"], list(source.patterns))
    return V.complete_features(merged, counted, keys, ["num_drugs"], [])


def design_matrix(merged: DataFrame, one_hot: Sequence[str]) -> DataFrame:
    """One-hot encoded covariates for the models; other columns stay as they are."""
    present = [c for c in one_hot if c in merged.columns]
    if not present:
        return merged
    return V.one_hot(merged, V.categories(merged, present))


def code_arrays(cohort: DataFrame, source: Biobank, keys: Sequence[str], id_col: str) -> DataFrame:
    """Diagnosis and drug arrays of the look-back window, one row per key."""
    index = cohort.select(*keys, "index_date")
    diagnoses = V.collect_code_arrays(
        source.diagnoses, index, keys, id_col, C.format_icd("code"), "diagnoses", "diagnosis_dates"
    )
    mapped = V.map_codes(source.drugs, source.drug_map, "drug_code", "medication_code", "atc")
    drugs = V.collect_code_arrays(
        mapped, index, keys, id_col, F.col("atc"), "drugs", "prescription_dates"
    )
    return diagnoses.join(drugs, list(keys), "full")


def patient_json(
    merged: DataFrame,
    arrays: DataFrame,
    keys: Sequence[str],
    endpoint: str,
    female_coded_as_one: bool = False,
) -> DataFrame:
    """Nested patient records: code arrays, labels, and all other covariates packed in one object."""
    fixed = {*keys, *COHORT_COLUMNS, "sex", "num_diagnoses", "num_drugs", "days_since_last"}
    extra = [c for c in merged.columns if c not in fixed]
    packed = V.pack_features(merged, extra)
    empty = F.array().cast("array<string>")
    lists = ("diagnoses", "diagnosis_dates", "drugs", "prescription_dates")
    joined = packed.join(arrays, list(keys), "left").withColumns(
        {c: F.coalesce(F.col(c), empty) for c in lists}
    )
    label = C.endpoint_label("event_indicator", endpoint)
    return joined.withColumns(
        {
            "sex": C.sex_label("sex", female_coded_as_one),
            "index_date": F.date_format("index_date", "yyyyMMdd"),
            "endpoint_labels": F.array(label),
            "time_to_endpoint": F.col("event_time"),
        }
    ).drop("event_time", "event_indicator", "num_diagnoses", "num_drugs", "days_since_last")
