"""Person-level hazard fit against the same model on unfolded periods."""

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import functions as F

from epispan.operators import hazards as H
from epispan.operators import multinomial
from epispan.operators.blocks import Blocks
from epispan.params import HazardParams

GRID = tuple(float(t) for t in range(0, 61, 6))
DDL = "id long, arm boolean, time long, event long, x double, z double"


def cohort(n=800, seed=5, causes=2):
    rng = np.random.default_rng(seed)
    x, z, arm = rng.normal(size=n), rng.integers(0, 2, n) * 1.0, rng.random(n) < 0.4
    t1, t2 = rng.exponential(60 / np.exp(0.5 * x)), rng.exponential(100 / np.exp(0.4 * arm))
    cens = rng.uniform(20, 90, n)
    last = np.minimum(np.minimum(t1, t2 if causes == 2 else np.inf), cens)
    code = np.where(t1 == last, 1, np.where(t2 == last, 2, 0))
    return [(int(i), bool(a), int(t), int(e), float(u), float(v)) for i, (a, t, e, u, v) in enumerate(zip(arm, last, code, x, z))]


def unfolded(frame, reg):
    """Shares of all classes by a multinomial fit on one row per person and period."""
    rows = H.person_periods(frame.withColumn("arm", F.col("arm").cast("double")), "time", "event", GRID)
    rows = OneHotEncoder(inputCol="t_idx", outputCol="hot", dropLast=False).fit(rows).transform(rows)
    rows = VectorAssembler(inputCols=["x", "z", "arm", "hot"], outputCol="features").transform(rows)
    label = F.when(F.col("cens_label") == 1, 3.0).otherwise(F.col("event_label"))
    model = LogisticRegression(labelCol="y", family="multinomial", regParam=reg, maxIter=2000, tol=1e-14).fit(rows.select("features", label.alias("y")))
    table, offset = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    return table[:, :3], table[:, 3:] + offset[:, None]


def test_same_effects_as_unfolded_periods(spark):
    frame = spark.createDataFrame(cohort(), DDL).repartition(4)
    model = H.fit_hazards(frame, ["x", "z"], "arm", "time", "event", GRID, params=HazardParams(reg_param=1e-3))
    by_feature, by_time = unfolded(frame, 1e-3)
    assert np.abs(model.by_feature - by_feature).max() < 1e-5
    centred = lambda m: m - m.mean(axis=0)  # noqa: E731 - a shift of all classes changes nothing
    assert np.abs(centred(model.by_time) - centred(by_time)).max() < 1e-5


def test_without_features_hazards_are_shares_of_those_at_risk(spark):
    rows = cohort()
    frame = spark.createDataFrame(rows, DDL)
    matrix = frame.select(
        F.array(H.grid_index("time", GRID).cast("double"), F.when(F.col("event") == 0, 3.0).otherwise(F.col("event").cast("double"))).alias("row")
    )
    fitted = multinomial.fit(Blocks.written(matrix, "row"), 0, len(GRID), 4, 0.0)
    assert fitted.converged
    share = np.exp(fitted.by_time - fitted.by_time.max(axis=0))
    share /= share.sum(axis=0)
    own = np.array([max(i for i, t in enumerate(GRID) if t <= r[2]) for r in rows])
    for k in range(8):  # later times have few persons
        at_risk = (own >= k).sum()
        for cause in (1, 2):
            assert abs(share[cause, k] - sum(o == k and r[3] == cause for o, r in zip(own, rows)) / at_risk) < 1e-6


def test_class_nobody_has_stays_unlikely(spark):
    frame = spark.createDataFrame(cohort(causes=1), DDL)
    model = H.fit_hazards(frame, ["x"], "arm", "time", "event", GRID)
    row = H.predict_hazards(model, frame, ["x"], "arm", ["id", "arm"]).first()
    assert max(row.haz_2_0) < 1e-9 < max(row.haz_1_0)


def test_sums_over_many_tasks(spark):
    values = spark.range(1000).selectExpr("array(cast(id as double), 1.0D) AS row").repartition(50)
    blocks = Blocks.written(values, "row")
    blocks.tasks = 50  # as many as are summed on executors first
    assert blocks.summed(lambda m: m.sum(axis=0), 2).tolist() == [499500.0, 1000.0]


def test_features_left_out_equal_separate_fits(spark):
    rows = [(*r[:4], None if r[0] % 7 == 0 else r[4], r[5]) for r in cohort()]
    frame = spark.createDataFrame(rows, DDL).repartition(4)
    shared = H.fit_hazards_without(frame, ["x", "z"], "arm", "time", "event", GRID, [["x"], ["z"], ["x", "z"], []])
    for model, columns in zip(shared, (["x", "z"], ["z"], ["x"], [], ["x", "z"]), strict=True):
        alone = H.fit_hazards(frame, columns, "arm", "time", "event", GRID)
        curves = [
            H.predict_hazards(m, frame, c, "arm", ["id", "arm"]).orderBy("id").limit(50).collect()
            for m, c in ((model, ["x", "z"]), (alone, columns))
        ]
        for one, other in zip(*curves, strict=True):
            assert all(np.allclose(one[c], other[c], atol=1e-8) for c in H.curve_columns((1, 2)))


def test_searches_together_end_on_their_own():
    searches = [multinomial.newton(np.array([start]), np.array([True]), 50, 1e-12) for start in (0.0, 5.0)]
    calls = []

    def evaluate(points):
        calls.append(len(points))
        return [(np.cosh(x[0] - 3), np.sinh(x - 3), np.cosh(x - 3)[None]) for x in points]

    results = multinomial.together(searches, evaluate)
    assert all(converged and abs(point[0] - 3) < 1e-9 for point, _, converged in results)
    assert calls[0] == 2 and calls == sorted(calls, reverse=True)


class Whole:
    """Rows in the driver, with the number of passes over them."""

    def __init__(self, rows):
        self.rows, self.passes = rows, 0

    def summed(self, measure, length):
        self.passes += 1
        return measure(self.rows)


def test_features_of_large_numbers_take_few_passes_and_lead_to_the_same_curves():
    rng = np.random.default_rng(4)
    x = np.c_[rng.normal(size=4000), rng.random(4000) < 0.5].astype(float)
    last, label = rng.integers(0, 13, 4000), rng.choice(4, 4000, p=(0.1, 0.4, 0.3, 0.2))
    label[last < 12] = np.maximum(label[last < 12], 1)
    fits = []
    for size in (1.0, 23_000.0):  # an age in days
        blocks = Whole(np.c_[last, label, x[:, :1] * size + size, x[:, 1:]])
        fitted = multinomial.fit(blocks, 2, 13, 4, 1e-4)
        assert fitted.converged and blocks.passes < 25  # up to 290 before
        eta = np.einsum("cp,np->nc", fitted.by_feature, np.c_[x[:, :1] * size + size, x[:, 1:]])[:, :, None] + fitted.by_time
        share = np.exp(eta - eta.max(axis=1, keepdims=True))
        fits.append(share / share.sum(axis=1, keepdims=True))
    assert np.abs(fits[0] - fits[1]).max() < 1e-8
