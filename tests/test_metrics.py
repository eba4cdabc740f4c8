"""Concordance, AUC and Brier scores against formulas over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epispan.operators import curves as K
from epispan.operators import metrics as E

GRID = (0.0, 2.0, 4.0, 6.0, 8.0)


def sample(seed, n=150):
    rng = np.random.default_rng(seed)
    day = rng.integers(0, 10, n)
    hit = rng.random(n) < 0.6
    score = np.round(rng.normal(size=n) - day / 10, 1)
    score[rng.random(n) < 1 / 3] = 0.4
    curve = np.cumprod(rng.uniform(0.7, 1.0, (n, len(GRID))), axis=1)
    return day, hit, score, curve


def as_frame(spark, day, hit, score, curve, group="g"):
    rows = [(group, int(d), bool(h), float(s), [float(x) for x in c]) for d, h, s, c in zip(day, hit, score, curve)]
    return spark.createDataFrame(rows, "g string, t int, hit boolean, s double, curve array<double>")


def longer(day, hit, i):
    return (day > day[i]) | ((day == day[i]) & ~hit)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("cell_rows", [10**6, 20, 5])
def test_concordance_equals_all_pairs(spark, seed, cell_rows):
    day, hit, score, curve = sample(seed)
    weight = 1.0 + np.arange(10) / 7
    conc = tied = comparable = 0.0
    for i in np.flatnonzero(hit):
        other = longer(day, hit, i)
        w = weight[day[i]]
        conc += w * (score[other] < score[i]).sum()
        tied += w * (score[other] == score[i]).sum()
        comparable += w * other.sum()
    weights = spark.createDataFrame([("g", int(t), float(w)) for t, w in enumerate(weight)], "g string, t int, weight double")
    got = E.concordance(
        as_frame(spark, day, hit, score, curve), ["g"], F.col("s"), "t", "hit", weights, cell_rows
    ).first()
    assert got["concordant"] == pytest.approx(conc)
    assert got["tied"] == pytest.approx(tied)
    assert got["comparable"] == pytest.approx(comparable)


def test_antolini_equals_all_pairs(spark):
    day, hit, score, curve = sample(3)
    own = np.searchsorted(GRID, day, side="right") - 1
    total = good = 0.0
    for i in np.flatnonzero(hit):
        other = longer(day, hit, i)
        mine, theirs = curve[i, own[i]], curve[other, own[i]]
        good += (mine < theirs).sum() + 0.5 * (mine == theirs).sum()
        total += other.sum()
    for cell_rows in (10**6, 40):
        got = E.antolini_concordance(
            as_frame(spark, day, hit, score, curve), ["g"], "curve", "t", "hit", GRID, cell_rows
        ).first()
        assert got["c_index"] == pytest.approx(good / total)


def test_auc_equals_all_pairs(spark):
    day, hit, score, curve = sample(4)
    frame = as_frame(spark, day, hit, score, curve)
    own = E.censoring_at_own_time(frame, E.censoring_survival(frame, "t", "hit", ["g"]), "t", ["g"])
    g = {r["t"]: r["cens_surv"] for r in own.collect()}
    for cell_rows in (10**6, 15):
        got = {r["t"]: r["auc"] for r in E.auc_over_time(frame, ["g"], F.col("s"), "t", "hit", (3.0, 6.0), own, cell_rows).collect()}
        for t in (3.0, 6.0):
            cases = np.flatnonzero(hit & (day <= t))
            control = day > t
            w = np.array([1 / g[day[i]] for i in cases])
            wins = [(score[control] < score[i]).sum() + 0.5 * (score[control] == score[i]).sum() for i in cases]
            assert got[t] == pytest.approx((w * wins).sum() / (w.sum() * control.sum()))


def test_brier_without_censoring_is_a_mean_square(spark):
    day, _, score, curve = sample(5)
    hit = np.ones(len(day), dtype=bool)
    frame = as_frame(spark, day, hit, score, curve)
    train = E.censoring_survival(frame, "t", "hit", ["g"])
    got = {r["t"]: r["brier"] for r in E.brier_over_time(frame, ["g"], "curve", "t", "hit", GRID, train).collect()}
    for k, t in enumerate(GRID):
        assert got[t] == pytest.approx((((day > t) - curve[:, k]) ** 2).mean())


def test_step_values_before_the_first_step(spark):
    steps = spark.createDataFrame([(3, 0.5), (5, 0.25)], "t int, v double")
    points = spark.createDataFrame([(1,), (3,), (4,), (9,)], "t int")
    got = {r["t"]: r["v"] for r in E.step_values(points, steps, [], "v", 1.0).collect()}
    assert got == {1: 1.0, 3: 0.5, 4: 0.5, 9: 0.25}


def test_curves_are_coherent(spark):
    rng = np.random.default_rng(6)
    rows = [(int(a), int(d), int(e)) for a, d, e in zip(rng.integers(0, 2, 300), rng.integers(1, 40, 300), rng.integers(0, 3, 300))]
    df = spark.createDataFrame(rows, "arm int, t int, e int")
    one = K.aalen_johansen(df, "t", "e", ["arm"], 1).withColumnRenamed("cif", "f1")
    two = K.aalen_johansen(df, "t", "e", ["arm"], 2).select("arm", "t", F.col("cif").alias("f2"))
    both = one.join(two, ["arm", "t"]).collect()
    assert all(r["surv"] + r["f1"] + r["f2"] == pytest.approx(1.0) for r in both)
    again = K.cif_from_hazard(K.hazard_from_cif(one, ["arm"], "f1"), ["arm"]).collect()
    assert all(r["cif_again"] == pytest.approx(r["f1"]) for r in again if r["surv"] > 0)
    last = max((r for r in both if r["arm"] == 1), key=lambda r: r["t"])
    assert last["n_risk"] >= 1 and last["variance"] >= -1e-12


def test_time_grid_equals_lower_quantiles(spark):
    rng = np.random.default_rng(7)
    days = rng.integers(0, 300, 1000)
    df = spark.createDataFrame([(int(d),) for d in days], "d int")
    want = np.unique(np.quantile(days, np.linspace(0, 1, 100), method="lower"))
    assert K.grid_values(df, "d", 100) == want.tolist()
    single = spark.createDataFrame([(5,)], "d int")
    assert K.grid_values(single, "d", 100) == [5]


def test_snap_keeps_early_values_at_the_first_time(spark):
    df = spark.createDataFrame([(1,), (3,), (4,), (99,)], "d int")
    assert [r[0] for r in df.select(K.snap_to_grid("d", [3, 5, 8])).collect()] == [3, 3, 3, 8]


def test_rows_of_the_cell_tree_grow_with_levels_not_with_days(spark):
    """With ten times the cells, rows written grow by the added levels alone."""
    n = 4000
    persons = spark.range(n).selectExpr("0 AS g", "id AS t", "1L AS any_n", "0L AS cens_n", "1.0D AS case_w", "pmod(id * 7919, 4000) AS rank")

    def written(n_cells):
        daily = persons.withColumn("cell", F.floor(F.col("rank") * n_cells / n).cast("int")).drop("rank")
        return E.cell_tree(daily, ["g"], n_cells).count()

    assert written(16) == 4 * n and written(160) == 8 * n
