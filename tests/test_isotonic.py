"""Isotonic pooling over cells against plain pooling and the min-max formula."""

import numpy as np
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from epispan.operators import isotonic as I


def rows_of(seed, n=400, levels=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    x = np.round(x * levels) / levels if levels else x
    y = rng.random(n) < 1 / (1 + np.exp(-x))
    return [(float(a), float(b)) for a, b in zip(x, y)]


def min_max(rows):
    """Value of every distinct score: the greatest, over starts, of the least mean up to an end."""
    xs = sorted({x for x, _ in rows})
    n = np.array([sum(a == x for a, _ in rows) for x in xs])
    s = np.array([sum(b for a, b in rows if a == x) for x in xs])
    cn, cs = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(s)]
    mean = lambda a, b: (cs[b + 1] - cs[a]) / (cn[b + 1] - cn[a])
    return {x: max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i, x in enumerate(xs)}


@pytest.mark.parametrize(("seed", "levels", "cell_scores"), [(1, 5, 10**6), (2, 8, 3), (3, 12, 7)])
def test_values_equal_the_min_max_formula(spark, seed, levels, cell_scores):
    rows = rows_of(seed, levels=levels)
    frame = spark.createDataFrame(rows, "x double, y double").repartition(3)
    steps = I.fit(frame, "x", "y", cell_scores)
    got = {r.x: r.v for r in frame.select("x", steps.value(F.col("x")).alias("v")).distinct().collect()}
    want = min_max(rows)
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], abs=1e-12) for x in want)


def test_same_predictions_as_the_ml_regression(spark):
    rows = rows_of(4)
    frame = spark.createDataFrame(rows, "x double, y double")
    model = IsotonicRegression(featuresCol="x", labelCol="y", predictionCol="p").fit(frame)
    asked = spark.createDataFrame([(float(v),) for v in np.linspace(-5, 5, 101)], "x double")
    out = model.transform(asked).select("p", I.fit(frame, "x", "y", 20).value(F.col("x")).alias("v")).collect()
    assert [r.v for r in out] == pytest.approx([r.p for r in out], abs=1e-9)


def test_nulls_and_constants(spark):
    frame = spark.createDataFrame([(1.0, 1.0), (2.0, 0.0), (None, 1.0), (3.0, None)], "x double, y double")
    steps = I.fit(frame, "x", "y")
    assert [r.v for r in frame.select(steps.value(F.col("x")).alias("v")).collect()] == [0.5, 0.5, None, 0.5]
    with pytest.raises(ValueError):
        I.fit(frame.where("x IS NULL"), "x", "y")
