"""Search over a trial table: it learns, and goes on after a stop as if there had been none."""

import random

import pytest

from epispan.operators import search as S
from epispan.params import HazardParams

BASE = HazardParams(learner="boosted")


def quality(params):
    """Best at a rate of 0.03 and a leaf of 30; three folds."""
    off = abs(S.BOOSTING["learning_rate"].place(params.learning_rate) - S.BOOSTING["learning_rate"].place(0.03))
    off += abs(params.min_samples_leaf - 30) / 59
    return [1 - off, 1 - off - 0.01, 1 - off + 0.01]


def settings(frame):
    return [(r.trial, r.n_iter, r.learning_rate, r.max_depth, r.min_samples_leaf, r.value) for r in frame.orderBy("trial").collect()]


def test_resumed_search_equals_an_unbroken_one_and_repeats_no_trial(spark, tmp_path):
    whole, table = S.search(spark, quality, BASE, 24, "s", seed=3)
    want = settings(table)
    runs = []

    def counted(params):
        runs.append(params)
        return quality(params)

    def stopping(params):
        if len(runs) >= 10:
            raise KeyboardInterrupt
        return counted(params)

    path = f"file:{tmp_path}/trials"
    with pytest.raises(KeyboardInterrupt):
        S.search(spark, stopping, BASE, 24, "s", seed=3, path=path)
    kept = {r.trial for r in S.Trials(spark, path).of("s")}
    assert kept == set(range(8))  # whole waves
    runs.clear()
    best, table = S.search(spark, counted, BASE, 24, "s", seed=3, path=path)
    assert len(runs) == 16 and settings(table) == want and best == whole
    S.search(spark, counted, BASE, 24, "s", seed=3, path=path)
    assert len(runs) == 16
    S.search(spark, counted, BASE, 4, "other", seed=3, path=path)  # a study of its own in the same table
    assert len(runs) == 20 and settings(S.Trials(spark, path).frame().where("study = 's'")) == want


def test_proposals_come_closer_than_random_draws():
    def value(s):
        return -abs(S.BOOSTING["learning_rate"].place(s["learning_rate"]) - 0.3) - abs(s["min_samples_leaf"] - 30) / 59

    late, plain = [], []
    for seed in range(20):
        draw = random.Random(seed)
        done = []
        for number in range(50):
            s = {n: r.value(draw.random()) for n, r in S.BOOSTING.items()} if number < 10 else S.propose(S.BOOSTING, done, draw)
            done.append((s, value(s)))
        late += [v for _, v in done[-15:]]
        plain += [v for _, v in done[:10]]
    assert sum(late) / len(late) > 0.4 * sum(plain) / len(plain)  # losses below 40 % of the random ones'


def test_failed_and_empty_trials_never_win(spark):
    def evaluate(params):
        if params.min_samples_leaf % 2:
            raise ValueError("odd leaves")
        return [None, None] if params.max_depth % 2 else [1.0, None]

    best, table = S.search(spark, evaluate, BASE, 12, "s", seed=1, larger_is_better=False)
    rows = table.collect()
    assert best.min_samples_leaf % 2 == 0 and best.max_depth % 2 == 0
    assert all((r.state == "failed") == (r.error is not None) for r in rows)
    with pytest.raises(RuntimeError, match="odd"):
        S.search(spark, lambda p: (_ for _ in ()).throw(ValueError("odd")), BASE, 2, "s")


def test_ranges():
    draw = random.Random(1)
    for name, own in (S.BOOSTING | S.LOGISTIC).items():
        values = [own.value(draw.random()) for _ in range(300)] + [own.value(0.0), own.value(1.0)]
        assert all(own.low <= v <= own.high * (1 + 1e-12) for v in values), name
        assert all(0 <= own.place(v) <= 1 + 1e-12 for v in values)
    assert set(S.space_of("logistic")) == {"reg_param"} and S.space_of("gbt")["max_depth"].high < 100
