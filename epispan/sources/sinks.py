"""Writers for cohorts, nested patient records, estimates and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from epispan.params import Experiment

# Field names of the nested record.
RECORD_COLUMNS = (
    "age_at_index",
    "sex",
    "index_date",
    "diagnoses",
    "diagnosis_dates",
    "drugs",
    "prescription_dates",
    "time_to_endpoint",
    "endpoint_labels",
    "exposed",
    "additional_features",
)


def experiment_path(parent: str, experiment: Experiment, extension: str = "csv") -> str:
    return f"{parent.rstrip('/')}/{experiment.name}.{extension}"


def rounded_floats(frame: DataFrame, digits: int = 2) -> DataFrame:
    """Round every floating column, as in the exported text files."""
    names = [f.name for f in frame.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return frame.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in names})


def write_cohort(frame: DataFrame, path: str, by: Sequence[str] = ("experiment",)) -> None:
    """Full-precision Parquet, one folder per experiment."""
    frame.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_csv(frame: DataFrame, path: str) -> None:
    """Text export with two decimals."""
    rounded_floats(frame).write.mode("overwrite").csv(path, header=True)


def patient_records(frame: DataFrame, id_col: str) -> DataFrame:
    """Nested record columns in their fixed order."""
    return frame.select(id_col, *RECORD_COLUMNS)


def write_patient_json(frame: DataFrame, path: str, id_col: str) -> None:
    patient_records(frame, id_col).write.mode("overwrite").json(path)


def write_estimates(estimates: DataFrame, path: str) -> None:
    """One folder per estimate type and g-computation flag."""
    estimates.write.mode("overwrite").partitionBy("type", "g_comp").csv(path, header=True)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def write_event_counts(counts: DataFrame, path: str) -> None:
    counts.write.mode("overwrite").csv(path, header=True)
