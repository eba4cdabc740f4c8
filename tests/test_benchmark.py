"""E-values of differences, quantile bins, and the benchmark that leaves covariates out."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from epispan.operators import curves as K
from epispan.operators import propensity as Q
from epispan.operators import tmle as T
from epispan.params import FitParams
from epispan.plans import estimation as plan

DDL = "event int, target_time double, type string, arm int, estimate double, se double, lo double, hi double"


def table(spark, cases):
    rows = []
    for k, (p1, p0, s1, s0, cov) in enumerate(cases):
        se = math.sqrt(s1**2 + s0**2 - 2 * cov)
        rows += [(1, float(k), "risks", 1, p1, s1, None, None), (1, float(k), "risks", 0, p0, s0, None, None)]
        rows.append((1, float(k), "rd", None, p1 - p0, se, p1 - p0 - T.Z_95 * se, p1 - p0 + T.Z_95 * se))
    return spark.createDataFrame(rows, DDL)


def vanishing(high, low, sh, sl, cov):
    """Smallest bias factor at which the limit of ``high - B low`` reaches 0, by bisection."""
    left = lambda b: high - b * low - T.Z_95 * math.sqrt(max(sh**2 + b * b * sl**2 - 2 * b * cov, 0.0))
    lo, hi = 1.0, high / low
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if left(mid) > 0 else (lo, mid)
    return lo


def test_difference_e_values_by_bisection(spark):
    cases = [
        (0.30, 0.10, 0.02, 0.01, 0.0), (0.10, 0.30, 0.01, 0.02, 1e-5), (0.2, 0.1, 0.02, 0.03, -1e-5),
        (0.3, 0.01, 0.02, 0.008, 0.0),  # the lower risk does not differ from 0
        (0.2, 0.19, 0.02, 0.02, 0.0), (0.2, 0.2, 0.0, 0.0, 0.0), (0.2, 0.0, 0.01, 0.0, 0.0),
    ]
    got = {int(r.target_time): r for r in T.difference_e_values(table(spark, cases)).collect()}
    e_value = lambda b: b + math.sqrt(b * (b - 1))
    for k, (p1, p0, s1, s0, cov) in enumerate(cases[:4]):
        sides = (p1, p0, s1, s0) if p1 >= p0 else (p0, p1, s0, s1)
        assert got[k].e_value == pytest.approx(e_value(sides[0] / sides[1]))
        assert got[k].e_value_limit == pytest.approx(e_value(vanishing(*sides, cov)), rel=1e-9)
        assert 1 < got[k].e_value_limit < got[k].e_value
    assert got[4].e_value_limit == 1.0 and got[4].e_value > 1
    assert (got[5].e_value, got[5].e_value_limit) == (1.0, 1.0)
    assert got[6].e_value is None and got[6].e_value_limit is None


def test_difference_contours_vanish_at_the_ratio(spark):
    rows = T.difference_contours(table(spark, [(0.3, 0.1, 0.01, 0.01, 0.0), (0.1, 0.3, 0.01, 0.01, 0.0)]), (1.0, 3.0, 1e9)).collect()
    for r in rows:
        sign = 1 if r.target_time == 0 else -1
        assert r.adjusted == pytest.approx(sign * (0.3 / r.bias_factor - 0.1))
        if min(r.rr_exposure, r.rr_outcome) == 1:
            assert r.adjusted == pytest.approx(r.estimate)


def test_bins_are_open_below(spark):
    rows = spark.createDataFrame([(v,) for v in (0, 1, 5, 6, 10, 11, None)], "v int")
    got = {r.v: r.b for r in rows.select("v", K.snap_below("v", [1.0, 5.0, 10.0]).alias("b")).collect()}
    assert got == {0: 1.0, 1: 1.0, 5: 1.0, 6: 5.0, 10: 5.0, 11: 10.0, None: None}


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(3)
    n = 500
    x, z = rng.normal(size=n), rng.integers(0, 2, n)
    exposed = rng.random(n) < 1 / (1 + np.exp(-x))
    t1, t2 = rng.exponential(60 / np.exp(0.8 * x + 0.5 * exposed)), rng.exponential(120, n)
    last = np.minimum(np.minimum(t1, t2), rng.uniform(30, 90, n))
    code = np.where(t1 == last, 1, np.where(t2 == last, 2, 0))
    rows = [(int(i), bool(e), int(t) + 1, int(c), float(u), float(v)) for i, (e, t, c, u, v) in enumerate(zip(exposed, last, code, x, z))]
    return spark.createDataFrame(rows, "patient_id long, exposed boolean, event_time int, event_indicator int, `x.0` double, z double")


def score(rows, used):
    if not used:
        return rows.select("patient_id", F.lit(0.5).alias("propensity"))
    scored = Q.propensity_scores(rows, "patient_id", "exposed", used, 1, learner="logistic")
    return scored.select("patient_id", F.col("propensity_score").alias("propensity"))


PARAMS = FitParams(
    exclude_columns=(), subset_condition=None, match=False, n_folds_outer=2, target_times=(20, 40, 5000), benchmark_bins=8, max_updates=20
)


def run(design, covariates):
    out = plan.e_value_benchmark(design, PARAMS, covariates, score=score)
    return {(r.left_out, r.event, r.target_time, r.type): r for r in out.collect()}


def test_a_covariate_left_out_equals_a_run_without_it(design):
    shared = run(design, {"risk": ["x.0"], "z": ["z"]})
    assert {k[0] for k in shared} == {"", "risk", "z"} and {k[2] for k in shared} == {20.0, 40.0}
    alone = run(design.drop("x.0"), {})
    assert len(shared) == 3 * 2 * 2 * 2 and len(alone) == 8
    for (_, *key), r in alone.items():
        other = shared["risk", *key]
        assert r.solved and other.solved
        assert other.estimate == pytest.approx(r.estimate, abs=1e-7) and other.e_value == pytest.approx(r.e_value, abs=1e-4)
    for (left_out, *key), r in shared.items():
        assert r.change == pytest.approx(r.estimate - shared["", *key].estimate)
        assert (r.observed_e_value is not None) == (r.type == "rr" and left_out != "")
    # the confounder moves the ratio more than the column without effect
    assert shared["risk", 1, 40.0, "rr"].observed_e_value > shared["z", 1, 40.0, "rr"].observed_e_value


def test_unknown_covariates_raise(design):
    with pytest.raises(ValueError):
        run(design, ["y"])
    with pytest.raises(ValueError):
        run(design, {"": ["z"]})
