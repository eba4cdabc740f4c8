"""Tail probabilities as columns against closed forms, a numeric integral and the standard library."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from epispan.functions import stats


def by_integral(t, df, cells=200_000):
    """Two-sided p value by Simpson's rule over the angle: t = sqrt(df) tan(a) has density c cos(a)^(df - 1)."""
    last = math.atan(abs(t) / math.sqrt(df))
    step = last / cells
    inner = sum((4 if k % 2 else 2) * math.cos(k * step) ** (df - 1) for k in range(1, cells))
    area = (1 + inner + math.cos(last) ** (df - 1)) * step / 3
    log_c = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(math.pi)
    return 1 - 2 * math.exp(log_c) * area


def values(spark, rows, column):
    return [r.p for r in spark.createDataFrame(rows, "k int, t double, df double").select("k", column.alias("p")).orderBy("k").collect()]


def test_t_p_values(spark):
    cases = [(t, df) for df in (1, 2, 3, 5, 10, 31, 200, 5000, 90_000) for t in (0.0, 0.3, -1.0, 1.9, 2.6)]
    got = values(spark, [(k, t, float(df)) for k, (t, df) in enumerate(cases)], stats.t_p_value(F.col("t"), F.col("df")))
    for p, (t, df) in zip(got, cases, strict=True):
        assert p == pytest.approx(by_integral(t, df, 2000), abs=1e-9), (t, df)
    far = values(spark, [(0, 40.0, 1.0), (1, 40.0, 2.0), (2, 60.0, 2.0)], stats.t_p_value(F.col("t"), F.col("df")))
    want = [1 - 2 / math.pi * math.atan(40.0), 1 - 40 / math.sqrt(1602), 1 - 60 / math.sqrt(3602)]
    assert far == pytest.approx(want, rel=1e-9)


def test_many_degrees_of_freedom_join_the_fraction(spark):
    rows = [(0, 2.5, 99_999.0), (1, 2.5, 100_001.0), (2, 1.959963985, 1e12)]
    low, high, normal = values(spark, rows, stats.t_p_value(F.col("t"), F.col("df")))
    assert low == pytest.approx(high, rel=1e-6) and normal == pytest.approx(0.05, abs=1e-9)


def test_chi2_p_values(spark):
    xs = [0.0, 0.01, 1.0, 3.841458820694124, 7.9, 8.0, 8.1, 25.0, 400.0, -1.0]
    got = values(spark, [(k, x, 1.0) for k, x in enumerate(xs)], stats.chi2_p_value(F.col("t")))
    assert got == pytest.approx([math.erfc(math.sqrt(max(x, 0.0) / 2)) for x in xs], rel=1e-9)


def test_unknown_statistics_have_no_p_value(spark):
    rows = [(0, None, 3.0), (1, float("nan"), 3.0), (2, 1.0, None), (3, 1.0, 0.0)]
    assert values(spark, rows, stats.t_p_value(F.col("t"), F.col("df"))) == [None] * 4
    assert values(spark, rows[:2], stats.chi2_p_value(F.col("t"))) == [None] * 2


def test_a_value_takes_the_steps_that_it_needs(spark):
    """400,000 values in a fraction of a minute on one core; 400 terms for each took about four minutes."""
    rows = spark.range(400_000, numPartitions=1).select("id", (F.col("id") % 997 / 100 - 5).alias("t"), (1 + F.col("id") % 4).alias("df"))
    start = time.monotonic()
    found = rows.select("id", stats.t_p_value(F.col("t"), F.col("df")).alias("p")).where(F.col("p") > 0).agg(F.count("p").alias("n"), F.min("p").alias("p")).first()
    assert found.n == 400_000 and time.monotonic() - start < 60
    one = stats._beta_fraction(np.array([0.5]), np.array([2.0]), np.array([0.3]))
    many = stats._beta_fraction(np.array([0.5, 45_000.0]), np.array([2.0, 0.5]), np.array([0.3, 0.9999]))
    assert one[0] == many[0]


def test_p_values_at_the_ends(spark):
    rows = [(0, 0.0, 3.0), (1, 1e-12, 3.0), (2, float("inf"), 3.0), (3, 2.0, -4.0), (4, 0.0, 0.0), (5, 1e200, 2.0)]
    assert values(spark, rows, stats.t_p_value(F.col("t"), F.col("df"))) == [1.0, None, None, None, None, None]
