"""Stages 2 and 3 over all experiments of a cohort table keyed by (experiment, person)."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispan.operators.joins import require_rows
from epispan.params import FitParams
from epispan.plans.covariates import Biobank, design_matrix, merge_covariates
from epispan.plans.estimation import Score, run_estimation, write_results
from epispan.session import cut, fit_together

logger = logging.getLogger(__name__)
KEY = "experiment"
MAX_EXPERIMENTS = 1_000
RUN_DDL = "experiment string, state string, updates int, solved boolean, error string"
ESTIMATE_DDL = (
    "event int, target_time double, type string, arm int, estimate double, se double, lo double, hi double, g_comp boolean, experiment string"
)


def experiment_designs(cohorts: DataFrame, source: Biobank, id_col: str, drop: Sequence[str] = ()) -> DataFrame:
    """Covariates and indicators of all experiments in one plan, written one folder per experiment.

    The wide table, the codes and the drugs are each read once; a person's codes are shared by all of the person's index dates.
    Indicators have the levels of all experiments together.
    """
    merged = cut(merge_covariates(cohorts, source, [KEY, id_col], id_col), "merged")
    return cut(design_matrix(merged, source.one_hot).drop(*drop), "designs", by=(KEY,))


def experiment_names(designs: DataFrame) -> list[str]:
    names = [r[0] for r in designs.select(KEY).distinct().limit(MAX_EXPERIMENTS + 1).collect()]
    if len(names) > MAX_EXPERIMENTS or None in names:
        raise ValueError(f"experiments need names, at most {MAX_EXPERIMENTS}")
    return sorted(names)


def run_table(spark, out: str) -> DataFrame:
    """One row per experiment that ended: ``done``, or ``failed`` with its error."""
    return _written(spark, f"{out}/runs", RUN_DDL)


def estimate_table(spark, out: str) -> DataFrame:
    """Estimates of all finished experiments."""
    return _written(spark, f"{out}/estimates", ESTIMATE_DDL)


def _written(spark, path: str, schema: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def run_experiments(
    designs: DataFrame,
    out: str,
    params: FitParams = FitParams(),
    id_col: str = "patient_id",
    treated: str = "exposed",
    learner: str = "gbt",
    score: Score | None = None,
    at_once: int = 2,
) -> DataFrame:
    """Estimate every experiment below ``out`` and return the table of runs.

    A run that is done is not repeated, so a stopped call goes on with the experiments that are left; failed ones are tried again.
    An experiment whose data cannot be estimated, such as one without a target time inside the follow-up, fails alone. All tables of
    a run lie in ``tables/<experiment>``, its estimates also in ``estimates``, its state, written last, in ``runs``.
    """
    spark = designs.sparkSession
    names = experiment_names(require_rows(designs, "there are no experiments to estimate"))
    done = {r[KEY] for r in run_table(spark, out).where("state = 'done'").collect()}

    def run(name: str) -> None:
        rows = designs.where(F.col(KEY) == name).drop(KEY)
        try:
            result = run_estimation(rows, params, id_col, treated, learner, score=score)
            write_results(result, f"{out}/tables/{name}")
            result.estimates.write.mode("overwrite").parquet(f"{out}/estimates/{KEY}={name}")
            state = ("done", result.updates, result.solved, None)
        except (Py4JJavaError, ValueError, RuntimeError, ArithmeticError) as error:
            logger.warning("experiment %s failed: %s", name, error)
            state = ("failed", None, None, str(error)[:2000])
        row = spark.createDataFrame([state], "state string, updates int, solved boolean, error string")
        row.coalesce(1).write.mode("overwrite").parquet(f"{out}/runs/{KEY}={name}")

    fit_together(spark, run, [name for name in names if name not in done], at_once)
    return run_table(spark, out)
