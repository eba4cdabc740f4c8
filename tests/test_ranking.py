"""Distributed ranks, quantiles and samples against plain sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epispan.functions.hashing import stable_hash
from epispan.operators import ranking as R
from epispan.operators import sampling as P


def skewed(n=3000, seed=0):
    """A third of all rows share one value."""
    rng = np.random.default_rng(seed)
    values = np.where(rng.random(n) < 1 / 3, 0.25, rng.normal(size=n))
    return [(int(i), "ab"[i % 2], float(v)) for i, v in enumerate(values)]


@pytest.mark.parametrize("accuracy", [50, 200, 10000])
def test_exact_quantiles_equal_numpy(spark, accuracy):
    rows = skewed()
    df = spark.createDataFrame(rows, "id long, g string, v double")
    probs = [0.0, 0.05, 0.31, 0.5, 0.77, 0.95, 1.0]
    got = {
        (r["g"], r["prob"]): r["quantile"]
        for r in R.exact_quantiles(df, "v", probs, ["g"], accuracy).collect()
    }
    assert len(got) == 2 * len(probs)
    for g in "ab":
        mine = [v for _, h, v in rows if h == g]
        for p in probs:
            assert got[g, p] == pytest.approx(np.quantile(mine, p), abs=1e-12)


@pytest.mark.parametrize("shift", [0.0, 0.5])
def test_cells_from_two_levels_of_sketches_stay_even(spark, monkeypatch, shift):
    monkeypatch.setattr(R, "SKETCH_CELLS", 5)
    monkeypatch.setattr(R, "SKETCH_ACCURACY", 1000)
    values = np.array([v for _, _, v in skewed()])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    splits = R.value_splits(df, "v", 60, shift)
    assert splits == sorted(set(splits)) and len(splits) < 2 * 60
    rows = np.histogram(values[values != 0.25], splits)[0]
    assert rows.max() <= 3 * len(values) / 60
    at = splits.index(0.25)  # the frequent value has a cell of its own
    assert splits[at + 1] == np.nextafter(0.25, np.inf)


def test_positions_do_not_depend_on_the_number_of_cells(spark, monkeypatch):
    df = spark.createDataFrame(skewed(), "id long, g string, v double")

    def positions(n_cells):
        ranked = R.value_rank(df, "v", stable_hash(7, "id"), "id", n_cells)
        return {r["id"]: r["position"] for r in ranked.collect()}

    plain = positions(1)
    monkeypatch.setattr(R, "SKETCH_CELLS", 5)
    assert positions(60) == positions(5)
    assert sorted(positions(60).values()) == sorted(plain.values())


def test_quantiles_without_groups_ignore_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (10.0,)], "v double")
    got = {r["prob"]: r["quantile"] for r in R.exact_quantiles(df, "v", [0.25, 0.5]).collect()}
    assert got == {0.25: 2.0, 0.5: 3.0}


@pytest.mark.parametrize("n_cells", [1, 7, 64])
def test_value_rank_is_a_permutation_in_value_order(spark, n_cells):
    rows = skewed(800)
    df = spark.createDataFrame([(i, v) for i, _, v in rows], "id long, v double")
    got = R.value_rank(df, "v", stable_hash(0, "id"), "id", n_cells).collect()
    assert sorted(r["position"] for r in got) == list(range(800))
    ordered = [r["v"] for r in sorted(got, key=lambda r: r["position"])]
    assert ordered == sorted(ordered)
    assert all(r["group_rows"] == 800 for r in got)


def test_folds_are_balanced_and_disjoint(spark):
    df = spark.range(997).select(F.col("id"), (F.col("id") % 3).alias("e"))
    got = P.stratified_folds(df, "id", "e", 5, 1).collect()
    assert len({r["id"] for r in got}) == len(got) == 997
    for e in range(3):
        sizes = np.bincount([r["fold"] for r in got if r["e"] == e], minlength=5)
        assert sizes.max() - sizes.min() <= 1


@pytest.mark.parametrize("n", [0, 1, 37, 500, 900, 5000])
def test_take_hashed_keeps_exactly_n(spark, n):
    df = spark.range(900)
    kept = [r["id"] for r in P.take_hashed(df, "id", 3, n).collect()]
    assert len(kept) == len(set(kept)) == min(n, 900)
    fewer = {r["id"] for r in P.take_hashed(df, "id", 3, n // 2).collect()}
    assert fewer <= set(kept)


def test_subsample_only_when_there_are_more(spark):
    df = spark.range(100).select("id", (F.col("id") < 20).alias("x"))
    assert P.subsample_controls(df, "id", "x", 2.5, 1).groupBy("x").count().orderBy("x").collect()[0]["count"] == 50
    assert P.subsample_controls(df, "id", "x", 9.0, 1).count() == 100
