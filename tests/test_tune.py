"""Tuning of the boosted model: fits in tasks against fits by passes, waves against single trials, and what the query asks for."""

import glob

import numpy as np
import pytest
from test_boosting import DDL, GRID, cohort

from epispan import session
from epispan.operators import boosting
from epispan.operators import hazards as H
from epispan.operators import search as S
from epispan.operators.sampling import stratified_folds
from epispan.params import FitParams, HazardParams
from epispan.registry import estimation as R

NAMES = (["x", "z"], "arm", "time", "event", GRID)


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(cohort(600), DDL).repartition(4).localCheckpoint()


def equal(some, others):
    for one, other in zip(some, others, strict=True):
        assert np.allclose(one.start, other.start) and len(one.rounds) == len(other.rounds)
        for a, b in zip((t for r in one.rounds for t in r), (t for r in other.rounds for t in r), strict=True):
            assert (a.feature, a.cut, a.missing_left, a.left) == (b.feature, b.cut, b.missing_left, b.left)
            assert np.allclose(a.value, b.value) and np.allclose(a.gain, b.gain)


def test_fits_in_tasks_equal_fits_by_passes(spark, people, monkeypatch):
    parts = [H.boosted_training(people.where(f"id % 3 {sign} 0"), *NAMES, seed=3, id_col="id") for sign in ("=", "<>")]
    assert [p.rows for p in parts] == [200, 400]
    settings = [HazardParams("boosted", 4, 0.1, 6, 15), HazardParams("boosted", 2, 0.05, 2, 40)]
    wanted = [(k, s) for s in settings for k in (0, 1)]
    in_tasks = boosting.fit_many(parts, wanted)
    assert [len(m.rounds) for m in in_tasks] == [4, 4, 2, 2]
    monkeypatch.setattr(boosting, "TASK_ROWS", 250)  # the larger part goes by passes
    mixed = boosting.fit_many(parts, wanted)
    monkeypatch.setattr(boosting, "TASK_ROWS", 0)
    equal(in_tasks, boosting.fit_many(parts, wanted))
    equal(in_tasks, mixed)


def test_margins_in_a_file_and_slices_change_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    n, edges = 500, [list(np.linspace(-2, 2, 100)), [0.0]]
    x = np.c_[rng.normal(size=n), rng.integers(0, 2, n)]
    x[::9, 0] = np.nan
    rows = np.c_[rng.integers(0, 1 << 30, (n, 2)), rng.integers(0, 8, n), rng.integers(0, 3, n), 1 + rng.random((n, 2)), boosting.bin_matrix(x, edges)].astype(float)
    part = boosting.Training(None, n, edges, 8, 2, (1 + np.arange(8) / 8, 1 + np.arange(8) / 9), 5)
    params = HazardParams("boosted", 12, 0.1, 5, 10)
    kept = part.fitted_on(rows.copy(), params)
    equal([kept], [part.fitted_on(rows[rng.permutation(n)], params)])
    monkeypatch.setattr(boosting, "SLICE_ROWS", 64)
    monkeypatch.setattr(boosting, "KEPT_MARGINS", 0)
    equal([kept], [part.fitted_on(rows.copy(), params)])


def test_tuning_tries_all_settings_and_values_are_those_of_single_trials(spark, people, monkeypatch):
    monkeypatch.setitem(S.BOOSTING, "n_iter", S.Range(2, 5, whole=True))
    args = (people, "id", *NAMES)
    best, trials = H.tune(*args, HazardParams(learner="boosted"), "c_antolini_all", n_trials=5, seed=3, at_once=3)
    rows = trials.orderBy("trial").collect()
    assert [(r.learner, r.state, r.wave, len(r.folds)) for r in rows] == [("boosted", "complete", k // 3, 3) for k in range(5)]
    for name in S.BOOSTING:
        assert len({r[name] for r in rows}) > 1
    dealt = session.cut(stratified_folds(people, "id", "event", 3, 3))
    parts = [H.boosted_training(dealt.where(f"fold <> {k}"), *NAMES, seed=3, id_col="id") for k in range(3)]
    for r in rows[::3]:  # trees are the same to the last digits only, by which curves may tie or not, so the fits are those of tasks
        own = HazardParams("boosted", *(r[s] for s in S.BOOSTING))
        models = [H.BoostedHazards(("x", "z", "arm"), 2, (1, 2), m) for m in boosting.fit_many(parts, [(k, own) for k in range(3)])]
        crossed = H.held_curves(dealt, 600, ["id", "fold", "arm", "time", "event"], ["x", "z"], "arm", 3, lambda k: models[k])
        panel = H.metric_panel(crossed, "arm", "time", "event", GRID, only="c_antolini_all").orderBy("fold").collect()
        assert np.allclose(r.folds, [p.value for p in panel], atol=1e-9)
    top = max(rows, key=lambda r: (r.value, -r.trial))
    assert [getattr(best, s) for s in S.BOOSTING] == [top[s] for s in S.BOOSTING]


def test_the_query_searches_the_boosted_settings_with_all_trials(spark, people, monkeypatch):
    asked = {}
    trial = ("study", 0, 0, "complete", 0.5, [0.5], "boosted", 60, 0.02, 5, 7, 0.001, None)

    def tune(*args, **named):
        asked.update({"base": args[7], "metric": args[8], **named})
        return HazardParams("boosted", 60, 0.02, 5, 7), spark.createDataFrame([trial, (*trial[:2], 1, *trial[3:7], 61, *trial[8:])], S.TRIAL_DDL)

    whole = H.tune.__defaults__
    monkeypatch.setattr(R.H, "tune", tune)
    monkeypatch.setattr(R, "fit_rows", lambda *_: people)
    rows = R._tune(spark, "none").orderBy("trial").collect()
    params = FitParams()
    assert asked["base"].learner == "boosted" and asked["metric"] == params.eval_metric
    assert asked.get("n_trials", whole[0]) == params.n_trials == 100 and asked.get("folds", whole[1]) == params.n_folds_inner == 3
    assert {"n_iter", "learning_rate", "max_depth", "min_samples_leaf"} <= set(rows[0].asDict())
    assert [r.best for r in rows] == [True, False]


def test_frames_cut_inside_are_deleted(spark, people):
    with session.cuts_discarded(spark):
        gone = session.cut(people, "gone")
        assert gone.count() == 600
    kept = session.cut(people, "kept")
    folder = session.shared_folder(spark).removeprefix("file:")
    assert not glob.glob(f"{folder}/gone-*") and glob.glob(f"{folder}/kept-*") and kept.count() == 600


def test_a_wave_that_fails_together_is_evaluated_one_by_one(spark):
    def one(params):
        if params.min_samples_leaf % 2:
            raise ValueError("odd leaves")
        return [params.learning_rate]

    def together(settings):
        return [one(p) for p in settings]

    base = HazardParams(learner="boosted")
    (best, table), (want, single) = (S.search(spark, one, base, 8, "s", seed=1, together=t) for t in (together, None))
    assert best == want and table.orderBy("trial").collect() == single.orderBy("trial").collect()
    assert {r.state for r in table.collect()} == set(S.STATES)
