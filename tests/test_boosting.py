"""Boosted competing risks: trees against plain walks, fits against curves without a model."""

import time

import numpy as np

from epispan.operators import boosting
from epispan.operators import hazards as H
from epispan.params import HazardParams

GRID = tuple(float(t) for t in range(0, 61, 6))
DDL = "id long, arm boolean, time long, event long, x double, z double"


def cohort(n=2000, seed=5):
    rng = np.random.default_rng(seed)
    x, z, arm = rng.normal(size=n), rng.integers(0, 2, n) * 1.0, rng.random(n) < 0.5
    t1, t2 = rng.exponential(60 / np.exp(1.2 * (x > 0.5))), rng.exponential(100, n)
    cens = rng.uniform(20, 90, n)
    last = np.minimum(np.minimum(t1, t2), cens)
    code = np.where(t1 == last, 1, np.where(t2 == last, 2, 0))
    hole = rng.random(n) < 0.1
    return [(int(i), bool(a), int(t), int(e), None if o else float(u), float(v)) for i, (a, t, e, u, v, o) in enumerate(zip(arm, last, code, x, z, hole))]


def fitted(spark, params, rows=None):
    frame = spark.createDataFrame(rows or cohort(), DDL).repartition(4)
    return frame, H.fit_hazards(frame, ["x", "z"], "arm", "time", "event", GRID, params=params, seed=3, id_col="id")


def test_curves_follow_the_data(spark):
    params = HazardParams(learner="boosted", n_iter=40, learning_rate=0.15, max_depth=3, min_samples_leaf=20)
    frame, model = fitted(spark, params)
    curves = H.predict_hazards(model, frame, ["x", "z"], "arm", ["id", "arm"]).toPandas().sort_values("id")
    haz = np.stack([np.stack(curves[H.haz_name(c, 0)]) for c in (1, 2)], axis=1)
    surv, cif = H.incidence(haz)
    assert (haz >= 0).all() and np.allclose(surv + cif.sum(axis=1), 1.0)
    assert (np.diff(np.stack(curves[H.cens_name(0)]), axis=1) <= 1e-12).all()
    high = np.array([r[4] is not None and r[4] > 0.5 for r in cohort()])
    for group in (high, ~high):  # what the model says of each group is what Aalen-Johansen finds in it
        own = spark.createDataFrame([r for r, g in zip(cohort(), group) if g], DDL)
        daily = own.groupBy("time", "event").count().collect()
        days = sorted({r.time for r in daily})
        at_risk, alive, inc, known = group.sum(), 1.0, 0.0, {}
        for day in days:
            d = {r.event: r["count"] for r in daily if r.time == day}
            inc += alive * d.get(1, 0) / at_risk
            alive *= 1 - (d.get(1, 0) + d.get(2, 0)) / at_risk
            at_risk -= sum(d.values())
            known[day] = inc
        for k in (3, 5, 7):
            want = max(v for t, v in known.items() if t <= GRID[k])
            assert abs(cif[group, 0, k].mean() - want) < 0.05


def test_depth_one_separates_the_risk_group_and_repeats_itself(spark):
    params = HazardParams(learner="boosted", n_iter=3, learning_rate=0.1, max_depth=1, min_samples_leaf=20)
    first, again = (fitted(spark, params)[1].model for _ in range(2))
    tree = first.rounds[0][1]
    assert tree.feature[0] in (0, 3)  # the covariate that matters, or time
    assert [t for r in first.rounds for t in r] == [t for r in again.rounds for t in r]


def test_times_of_a_tree_by_leaf_equal_a_walk_per_time():
    rng = np.random.default_rng(2)
    tree = boosting.Tree()
    a, b = tree.split(0, 2, 4, True, 1.0, (0.1, 0.2))  # on time
    c, _ = tree.split(a, 0, 3, False, 1.0, (0.3, 0.4))
    tree.split(b, 2, 7, True, 1.0, (0.5, 0.6))
    tree.split(c, 1, 2, True, 1.0, (0.7, 0.8))
    x = rng.integers(0, 6, (200, 2)).astype(np.uint8)
    total = np.zeros((200, 10))
    tree.over_time(x, 10, total)
    for place in range(10):
        walked = np.array(tree.value)[tree.leaves(np.c_[x, np.full(200, place + 1)].astype(int))]
        assert np.allclose(total[:, place], walked)


def test_small_leaves_and_deep_trees_are_bounded(spark):
    params = HazardParams(learner="boosted", n_iter=1, learning_rate=0.1, max_depth=60, min_samples_leaf=1)
    _, model = fitted(spark, params, cohort(400))
    assert all(sum(f < 0 for f in t.feature) <= boosting.MAX_LEAVES for t in model.model.rounds[0])


def test_chances_and_bins(spark):
    frame = spark.createDataFrame([(1, 1, 1.0), (1, 0, 2.0), (2, 0, 2.0), (3, 2, None)], "time long, event long, v double")
    days, uncensored, free = boosting.staying_chances(frame, "time", "event")
    assert days.tolist() == [1, 2, 3] and np.allclose(free, [3 / 4, 3 / 4, 0]) and np.allclose(uncensored, [2 / 3, 1 / 3, 1 / 3])
    edges = boosting.bin_edges(frame, ["v"])
    assert edges == [[1.0]]
    assert boosting.bin_matrix(np.array([[1.0], [1.5], [np.nan]]), edges).ravel().tolist() == [1, 2, 0]


def grown(rng, splits=7, features=3):
    tree = boosting.Tree()
    for _ in range(splits):
        leaf = int(rng.choice([k for k, f in enumerate(tree.feature) if f < 0]))
        tree.split(leaf, int(rng.integers(features)), int(rng.integers(1, 255)), bool(rng.integers(2)), 1.0, rng.normal(size=2))
    return tree


def walked(tree, row):
    node = 0
    while tree.feature[node] >= 0:
        value = row[tree.feature[node]]
        goes_left = tree.missing_left[node] if value == 0 else value <= tree.cut[node]
        node = tree.left[node] + (not goes_left)
    return node


def test_leaves_equal_a_walk_per_row_and_a_tree_takes_few_passes_over_its_rows():
    rng = np.random.default_rng(7)
    bins = np.asfortranarray(rng.choice([0, *range(256)], (300, 3)).astype(np.uint8))
    for splits in (0, 1, 7, 30):
        tree = grown(rng, splits)
        assert tree.leaves(bins).tolist() == [walked(tree, [int(v) for v in row]) for row in bins]
    rows = np.asfortranarray(rng.integers(0, 256, (boosting.SLICE_ROWS, 3)).astype(np.uint8))
    trees = [grown(rng) for _ in range(300)]

    def seconds():
        start = time.process_time()
        for tree in trees:
            tree.leaves(rows)
        return time.process_time() - start

    # a row and tree took about 80 ns when nodes were looked up row by row
    assert min(seconds() for _ in range(3)) < 25e-9 * len(rows) * len(trees)
