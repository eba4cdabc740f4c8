"""Cohort stage: from person dates to dated cohorts of all experiments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epispan.operators.designs import build_cohorts, event_counts, require_nonnull
from epispan.operators.summaries import histogram
from epispan.params import CohortParams, Experiment, PersonColumns
from epispan.sources.sinks import write_cohort, write_event_counts


def cohort_histograms(cohort: DataFrame, by: Sequence[str] = ("experiment",)) -> DataFrame:
    """Shared-edge histograms of index date (as days since 1970), age and event time per indicator."""
    by = list(by)
    day = F.datediff("index_date", F.lit("1970-01-01").cast("date"))
    parts = [
        histogram(cohort, day, "exposed", by=by).withColumns(
            {"feature": F.lit("index_date"), "event_indicator": F.lit(None).cast("int")}
        ),
        histogram(cohort, F.col("age_at_index"), "exposed", by=by).withColumns(
            {"feature": F.lit("age_at_index"), "event_indicator": F.lit(None).cast("int")}
        ),
        histogram(cohort, F.col("event_time"), "exposed", by=[*by, "event_indicator"]).withColumn(
            "feature", F.lit("event_time")
        ),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def run_cohorts(
    spark: SparkSession,
    persons: DataFrame,
    experiments: Sequence[Experiment],
    out: str,
    cols: PersonColumns = PersonColumns(),
    params: CohortParams = CohortParams(),
) -> DataFrame:
    """Write the cohorts, their event counts and histograms; returns the written cohorts."""
    if any(e.subset == "hospital" for e in experiments):
        require_nonnull(persons, cols.hospitalized)
    write_cohort(build_cohorts(persons, experiments, cols, params), f"{out}/cohorts")
    cohorts = spark.read.parquet(f"{out}/cohorts")
    write_event_counts(event_counts(cohorts, ["experiment"]), f"{out}/event_counts")
    cohort_histograms(cohorts).write.mode("overwrite").parquet(f"{out}/histograms")
    return cohorts
