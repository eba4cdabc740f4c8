"""Targeting against the Aalen-Johansen estimator, which it must reproduce without covariates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epispan.operators import curves as K
from epispan.operators import hazards as H
from epispan.operators import tmle as M

GRID = tuple(float(t) for t in range(1, 13))
TIMES = (4.0, 8.0, 11.0)


def simulated(n=400, seed=1):
    rng = np.random.default_rng(seed)
    treated = rng.random(n) < 0.4
    rate = np.where(treated, 0.12, 0.08)
    t1, t2 = rng.geometric(rate), rng.geometric(0.05, n)
    cens = rng.integers(3, 14, n)
    last = np.minimum(np.minimum(t1, t2), cens)
    code = np.where(t1 == last, 1, np.where(t2 == last, 2, 0))
    over = last > GRID[-1]
    return [
        (int(i), bool(a), int(min(t, GRID[-1])), 0 if o else int(e))
        for i, (a, t, e, o) in enumerate(zip(treated, last, code, over))
    ]


def empirical(rows, scale=1.0):
    """Hazard and censoring curves per arm from counts, events before censoring."""
    out = {}
    for arm in (0, 1):
        mine = [(t, e) for _, a, t, e in rows if a == bool(arm)]
        haz = np.zeros((2, len(GRID)))
        leave = np.zeros(len(GRID))
        for k, g in enumerate(GRID):
            at_risk = sum(t >= g for t, _ in mine)
            events = [sum(t == g and e == c for t, e in mine) for c in (1, 2)]
            if at_risk:
                haz[:, k] = np.array(events) / at_risk
                left = at_risk - sum(events)
                leave[k] = sum(t == g and e == 0 for t, e in mine) / left if left else 0.0
        out[arm] = (np.minimum(haz * scale, 0.9), np.cumprod(1 - leave))
    return out


def frame_of(spark, rows, scale=1.0):
    curves = empirical(rows, scale)
    share = np.mean([a for _, a, _, _ in rows])
    columns = ["id", "exposed", "event_time", "event_indicator", *H.curve_columns((1, 2))]
    arrays = [curves[a][0][c].tolist() for a in (0, 1) for c in (0, 1)]
    arrays += [curves[a][1].tolist() for a in (0, 1)]
    crossed = spark.createDataFrame([(*r, *arrays) for r in rows], columns)
    target = M.Target("id", "exposed", "event_indicator", "p", GRID, TIMES, bound=1e-3)
    propensity = crossed.select("id", F.lit(float(share)).alias("p"))
    return M.targeting_frame(crossed, propensity, target, "event_time"), target


def test_empirical_hazards_are_solved_and_match_aalen_johansen(spark):
    rows = simulated()
    frame, target = frame_of(spark, rows)
    score = M.scores(frame, target, [])[0]
    assert np.abs(score.mean).max() < 1e-12
    table = spark.createDataFrame(rows, "id long, exposed boolean, event_time int, event_indicator int")
    for cause in (1, 2):
        curve = K.aalen_johansen(table, "event_time", "event_indicator", ["exposed"], cause)
        known = {(r["exposed"], float(r["t"])): r for r in curve.collect()}
        for k, t in enumerate(TIMES):
            for arm in (0, 1):
                want = known[(bool(arm), t)]
                assert score.risk[arm, cause - 1, k] == pytest.approx(want["cif"], abs=1e-12)
                share = sum(r[1] == bool(arm) for r in rows) / len(rows)
                assert 0 < share < 1
                # the influence spread over all persons is that of the arm divided by its share
                se = score.sd[arm, cause - 1, k] * np.sqrt((len(rows) - 1) / len(rows)) / np.sqrt(len(rows))
                assert se == pytest.approx(np.sqrt(want["variance"]), rel=1e-9)


def test_wrong_hazards_are_pulled_to_aalen_johansen(spark):
    rows = simulated()
    frame, target = frame_of(spark, rows, scale=1.5)
    done = M.tmle_update(frame, target, max_updates=60)
    assert done.solved
    right, _ = frame_of(spark, rows)
    truth = M.scores(right, target, [])[0]
    assert np.abs(done.initial.risk - truth.risk).max() > 0.05
    assert (np.abs(done.score.risk - truth.risk) <= truth.sd / np.sqrt(len(rows))).all()
    after = M.scores(done.frame, target, [])[0]
    assert np.allclose(after.risk, done.score.risk, atol=1e-12)
    table = M.estimates(M.influence_rows(done.frame, target)).collect()
    kinds = {(r["type"], r["arm"]) for r in table}
    assert kinds == {("risks", 1), ("risks", 0), ("rr", None), ("rd", None)}
    for r in table:
        assert r["lo"] <= r["estimate"] <= r["hi"]


def test_clever_covariate_is_the_risk_gradient(spark):
    """A tiny step must change the mean risk by the squared length of the influence direction."""
    rows = simulated(60)
    frame, target = frame_of(spark, rows, scale=1.3)
    block = M.Block(frame.toPandas(), target)
    direction = np.zeros(target.shape)
    direction[1, 0, 1] = 1.0
    moved = block.moved(direction, 1e-6)
    surv, cif = H.incidence(block.haz)
    base = cif[..., target.at]
    change = (H.incidence(moved)[1][..., target.at] - base) / 1e-6
    lagged = H.before(surv)
    at = target.at[1]
    steps = np.arange(len(GRID)) <= at
    expected = np.zeros(len(block.haz))
    for cause in (0, 1):
        slope = (cause == 0) - (cif[:, 1, 0, [at]] - cif[:, 1, 0]) / surv[:, 1]
        clever = block.weight[:, 1] * slope
        expected += (lagged[:, 1] * slope * block.haz[:, 1, cause] * clever * steps).sum(axis=1)
    assert np.allclose(change[:, 1, 0, 1], expected, rtol=1e-3)
