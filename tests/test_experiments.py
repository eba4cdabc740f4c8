"""Stage 3 over several experiments: runs on their own, failures alone, and resuming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epispan.operators import propensity as Q
from epispan.params import FitParams
from epispan.plans import experiments as stages
from epispan.plans.estimation import run_estimation

PARAMS = FitParams(
    exclude_columns=("w", "seen"), subset_condition=None, match=False, tune=False, n_folds_outer=2, grid_size=6, target_times=(20, 40), max_updates=20
)
DDL = "experiment string, patient_id long, exposed boolean, event_time int, event_indicator int, x double, z double, w double, seen date"


def people(name, seed, longest, n=300):
    rng = np.random.default_rng(seed)
    x, z, exposed = rng.normal(size=n), rng.integers(0, 2, n), rng.random(n) < 0.5
    t1, t2 = rng.exponential(60 / np.exp(0.5 * x)), rng.exponential(120, n)
    last = np.minimum(np.minimum(t1, t2), rng.uniform(longest / 2, longest, n))
    code = np.where(t1 == last, 1, np.where(t2 == last, 2, 0))
    return [(name, int(i), bool(e), int(t) + 1, int(c), float(u), float(v), float(i % 50), None) for i, (e, t, c, u, v) in enumerate(zip(exposed, last, code, x, z))]


def score(rows, used):
    scored = Q.propensity_scores(rows, "patient_id", "exposed", used, 1, learner="logistic")
    return scored.select("patient_id", F.col("propensity_score").alias("propensity"))


def found(frame):
    return {(r.event, r.target_time, r.type, r.arm, r.g_comp): r.estimate for r in frame.collect()}


def test_experiments_run_fail_and_resume(spark, tmp_path):
    designs = spark.createDataFrame(people("a", 1, 90) + people("short", 2, 8), DDL)
    out = str(tmp_path / "out")
    runs = {r.experiment: r for r in stages.run_experiments(designs, out, PARAMS, score=score).collect()}
    assert {k: r.state for k, r in runs.items()} == {"a": "done", "short": "failed"}
    assert runs["a"].solved and "target time" in runs["short"].error
    got = stages.estimate_table(spark, out)
    alone = run_estimation(designs.where("experiment = 'a'").drop("experiment"), PARAMS, score=score)
    assert {r.experiment for r in got.collect()} == {"a"}
    assert found(got) == pytest.approx(found(alone.estimates), abs=1e-7)
    # effect groups are compared on excluded numbers too
    assert {r.covariate for r in alone.effects_continuous.collect()} == {"x", "w"}
    tables = [spark.read.parquet(f"{out}/tables/a/{t}").count() for t in ("e_values", "difference_e_values", "contours")]
    assert tables == [4, 4, 2 * 4 * len(PARAMS.contour_strengths) ** 2]

    def never(rows, used):
        raise AssertionError("a finished run is not repeated")

    assert stages.run_experiments(designs.where("experiment = 'a'"), out, PARAMS, score=never).count() == 2
    assert found(stages.estimate_table(spark, out)) == found(got)


def test_no_experiments_raise_and_no_runs_are_an_empty_table(spark, tmp_path):
    with pytest.raises(RuntimeError):
        stages.run_experiments(spark.createDataFrame([], DDL), str(tmp_path / "none"), PARAMS)
    assert stages.run_table(spark, str(tmp_path / "none")).count() == 0
    unnamed = spark.createDataFrame([(None, *r[1:]) for r in people("a", 1, 90, 5)], DDL)
    with pytest.raises(ValueError):
        stages.run_experiments(unnamed, str(tmp_path / "none"), PARAMS)
