"""Models, cross-fitting and the whole estimation stage on a randomised exposure."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epispan.operators import curves as K
from epispan.operators import hazards as H
from epispan.operators import propensity as Q
from epispan.operators import summaries as M
from epispan.params import FitParams, HazardParams
from epispan.plans import estimation as plan

GRID = tuple(float(t) for t in range(0, 61, 6))
TREES = {"forest": {"numTrees": 5}, "gbt": {"maxIter": 2, "maxDepth": 2, "stepSize": 0.1}}


def cohort(n=1500, seed=3):
    rng = np.random.default_rng(seed)
    x, z = rng.normal(size=n), rng.integers(0, 2, n)
    treated = rng.random(n) < 0.45
    t1 = rng.exponential(60 / np.exp(0.5 * x + 0.4 * treated))
    t2 = rng.exponential(120 / np.exp(0.3 * z))
    cens = rng.uniform(20, 90, n)
    last = np.minimum(np.minimum(t1, t2), cens)
    code = np.where(t1 == last, 1, np.where(t2 == last, 2, 0))
    gap = rng.random(n) < 0.1
    return [
        (int(i), bool(a), int(t), int(e), None if g else float(u), int(v))
        for i, (a, t, e, u, v, g) in enumerate(zip(treated, last, code, x, z, gap))
    ]


SCHEMA = "patient_id long, exposed boolean, event_time int, event_indicator int, x double, z int"


@pytest.fixture(scope="module")
def design(spark):
    return spark.createDataFrame(cohort(), SCHEMA).cache()


@pytest.fixture(scope="module")
def crossed(design):
    return H.cross_fit(
        design, "patient_id", ["x", "z"], "exposed", "event_time", "event_indicator", GRID, 3, seed=1
    )


def test_person_periods_count_time_at_risk(spark):
    df = spark.createDataFrame([(1, 13, 1), (2, 0, 0), (3, 99, 2)], "id long, t int, e int")
    rows = H.person_periods(df, "t", "e", GRID).collect()
    by_id = {i: [r for r in rows if r["id"] == i] for i in (1, 2, 3)}
    assert [len(by_id[i]) for i in (1, 2, 3)] == [3, 1, 11]
    assert [r["event_label"] for r in by_id[1]] == [0.0, 0.0, 1.0]
    assert not by_id[1][-1]["cens_risk"] and by_id[2][0]["cens_label"] == 1.0


def test_crossed_curves_are_proper_and_calibrated(design, crossed):
    rows = crossed.collect()
    assert len(rows) == design.count() == len({r["patient_id"] for r in rows})
    for r in rows[:50]:
        for arm in (0, 1):
            haz = np.array([r[H.haz_name(c, arm)] for c in (1, 2)])
            surv, cif = H.incidence(haz[None])
            assert np.allclose(surv + cif.sum(axis=1), 1.0)
            assert (np.diff(r[H.cens_name(arm)]) <= 1e-12).all()
    factual = {True: [], False: []}
    for r in rows:
        haz = np.array([r[H.haz_name(c, int(r["exposed"]))] for c in (1, 2)])
        factual[r["exposed"]].append(H.incidence(haz[None])[1][0, 0, -1])
    curve = K.aalen_johansen(design, "event_time", "event_indicator", ["exposed"])
    for arm in (True, False):
        known = max((r for r in curve.collect() if r["exposed"] is arm and r["t"] < 66), key=lambda r: r["t"])
        assert np.mean(factual[arm]) == pytest.approx(known["cif"], abs=0.06)


def test_metric_panel_and_single_metric(crossed):
    args = ("exposed", "event_time", "event_indicator", GRID)
    panel = H.metric_panel(crossed, *args).collect()
    got = {(r["fold"], r["metric"], r["endpoint"]): r["value"] for r in panel}
    assert len(got) == 3 * 5 * 4
    for fold in range(3):
        assert got[fold, "c_harrel", "1"] > 0.55
        assert 0 < got[fold, "ibs", "all"] < 0.3
    one = H.metric_panel(crossed, *args, only="c_antolini_all").collect()
    assert {r["fold"]: r["value"] for r in one} == pytest.approx(
        {k: got[k, "c_antolini", "all"] for k in range(3)}
    )
    with pytest.raises(ValueError):
        H.metric_panel(crossed, *args, only="c_index_1")


def test_boosted_hazards_have_the_same_shape(design):
    settings = HazardParams(learner="gbt", n_iter=2, max_depth=2, learning_rate=0.1, min_samples_leaf=5)
    few = design.where("patient_id < 300")
    model = H.fit_hazards(few, ["x", "z"], "exposed", "event_time", "event_indicator", GRID, params=settings)
    rows = H.predict_hazards(model, few, ["x", "z"], "exposed", ["patient_id", "exposed"]).collect()
    assert len(rows) == 300
    for r in rows:
        for arm in (0, 1):
            haz = np.array([r[H.haz_name(c, arm)] for c in (1, 2)])
            assert haz.shape == (2, len(GRID)) and (haz >= 0).all() and (haz.sum(axis=0) < 1).all()
            assert len(r[H.cens_name(arm)]) == len(GRID)


def test_propensity_variants(design):
    for calibrate in (False, True):
        rows = Q.propensity_scores(
            design, "patient_id", "exposed", ["x", "z"], 1, learner="logistic", calibrate=calibrate
        ).collect()
        assert len(rows) == 1500
        assert all(0 < r["propensity_score"] < 1 for r in rows)
        assert np.isfinite([r["propensity_logit"] for r in rows]).all()
    with pytest.raises(ValueError):
        Q.propensity_scores(design, "patient_id", "exposed", ["x"], 1, learner="logistic", grid=True)


def test_grid_search_reports_every_point(design):
    data = Q.prepare(design.where("patient_id < 400"), "exposed", ["x", "z"])
    folds = data.frame.withColumn("_fold", Q.hash_fold("patient_id", 1, 2))
    points = Q.grid_search(data, folds, "_fold", 2, depths=(1, 2), rates=(0.1,), iterations=(2,))
    assert {p["max_depth"] for p in points} == {1, 2}
    assert all(0 <= p["accuracy"] <= 1 for p in points)


def test_feature_kinds_count_null_as_a_value(spark):
    df = spark.createDataFrame(
        [(i, float(i), "ab"[i % 2], i % 2 == 0, 1 if i % 3 else None, 7) for i in range(200)],
        "id long, many double, text string, flag boolean, holes int, same int",
    )
    kinds = M.feature_kinds(df, ["many", "text", "flag", "holes", "same"])
    assert kinds == {"many": "continuous", "text": "binary", "flag": "binary", "holes": "binary", "same": None}


def test_stage_agrees_with_aalen_johansen_when_randomised(spark, design, tmp_path):
    params = FitParams(
        subset_condition="event_time > 0",
        control_subsample_factor=3.0,
        match_calibrate=False,
        match_grid_search=False,
        caliper=0.5,
        n_folds_outer=2,
        tune=False,
        target_times=(24, 48, 5000),
        grid_size=12,
        max_updates=20,
    )
    result = plan.run_estimation(design, params, learner="logistic", propensity_settings=TREES)
    assert result.solved
    rows = result.estimates.where((F.col("type") == "risks") & (F.col("event") == 1) & ~F.col("g_comp")).collect()
    known = {(r["exposed"], r["t"]): r["cif"] for r in result.aalen_johansen.collect()}
    assert {r["target_time"] for r in rows} == {24.0, 48.0}
    for r in rows:
        truth = max((t, c) for (arm, t), c in known.items() if arm == bool(r["arm"]) and t <= r["target_time"])[1]
        assert abs(r["estimate"] - truth) < 3 * r["se"] + 0.02
        assert 0 < r["se"] < 0.1
    assert result.effects_continuous.count() == 2 and result.effects_binary.count() == 2
    assert result.balance.count() == 4 and result.e_values.count() == 4
    plan.write_results(result, str(tmp_path / "out"))
    written = spark.read.csv(str(tmp_path / "out" / "estimates"), header=True)
    assert written.count() == 2 * 2 * 4 * 2
    assert spark.read.json(str(tmp_path / "out" / "metrics")).count() == 2 * 5 * 4
