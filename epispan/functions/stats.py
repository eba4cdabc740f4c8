"""Closed-form statistics and tail probabilities as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

LOGIT_GUARD = 1e-15
SCORE_GUARD = 1e-10
PROPENSITY_FLOOR = 1e-6


def logit(p: Column) -> Column:
    return F.log(p / ((1 - p) + F.lit(LOGIT_GUARD)))


def clipped(p: Column, floor: float = PROPENSITY_FLOOR) -> Column:
    return F.greatest(F.lit(floor), F.least(F.lit(1.0 - floor), p))


def risk_score(survival: Column) -> Column:
    """Summed cumulative hazard of a survival curve held as an array."""
    return F.aggregate(
        survival, F.lit(0.0), lambda acc, s: acc - F.log(s + F.lit(SCORE_GUARD))
    )


def pooled_t(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    """Two-sample t statistic with pooled variance."""
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    return (m1 - m2) / F.sqrt(pooled * (1 / n1 + 1 / n2))


def chi2_2x2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Chi-square of the table [[a, b], [c, d]] with continuity correction."""
    total = a + b + c + d
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    off = F.abs(a * d - b * c)
    corrected = F.greatest(off - total / 2, F.lit(0.0))
    return F.when(margins > 0, total * corrected * corrected / margins)


def smd(m1: Column, m0: Column, v1: Column, v0: Column) -> Column:
    spread = F.sqrt((v1 + v0) / 2)
    return F.when(spread > 0, (m1 - m0) / spread)


def significance_stars(p: Column, limit: int = 3) -> Column:
    """One star below 0.05 and one more per further tenfold, at most ``limit``; else ``n. s.``."""
    label = F.when(p.isNull() | (p >= 0.05), "n. s.")
    for count in range(1, limit + 1):
        upper_next = 0.05 / 10**count
        text = "*" * count
        label = label.otherwise(text) if count == limit else label.when(p >= upper_next, text)
    return label


def e_value(ratio: Column) -> Column:
    """Strength of unmeasured confounding that would explain a risk ratio away."""
    away = F.when(ratio < 1, 1 / ratio).otherwise(ratio)
    return away + F.sqrt(away * (away - 1))


def bias_factor(rr_exposure: Column, rr_outcome: Column) -> Column:
    return rr_exposure * rr_outcome / (rr_exposure + rr_outcome - 1)


#: Terms of the series and the fraction of the error function; enough for double precision where each is used.
FRACTION_TERMS = 400
SERIES_TERMS = 60
SHIFTS = 20
#: Steps of the beta fraction at most, two terms each: about the root of the degrees of freedom is needed.
BETA_STEPS = 2_000
#: Values that are worked on at once.
SLICE_VALUES = 1 << 14
#: Above this many degrees of freedom the t distribution is read off the normal one after a correction.
MANY_DF = 100_000.0
#: The expansion of log(gamma(a + 1/2) / gamma(a)) - log(a) / 2 in odd powers of 1 / a.
GAMMA_RATIO = (-1 / 8, 1 / 192, -1 / 640, 17 / 14336, -31 / 18432)


def _erfc(z: np.ndarray) -> np.ndarray:
    """Complementary error function for z >= 0: a series below 2, a continued fraction above."""
    out = np.empty(len(z))
    near = z < 2
    x = z[near]
    total = np.ones(len(x))
    for k in range(SERIES_TERMS, 0, -1):
        total = 1 + total * 2 * x * x / (2 * k + 1)
    out[near] = 1 - 2 / math.sqrt(math.pi) * np.exp(-x * x) * x * total
    x = z[~near]
    total = np.ones(len(x))
    for k in range(FRACTION_TERMS, 0, -1):
        total = 1 + k / (2 * x * x) / total
    out[~near] = np.exp(-x * x) / (x * math.sqrt(math.pi)) / total
    return out


def _log_gamma_ratio(a: np.ndarray) -> np.ndarray:
    """log(gamma(a + 1/2) / gamma(a)) for a > 0: shifted upwards, then expanded."""
    shifted = np.zeros(len(a))
    for k in range(SHIFTS, 0, -1):
        shifted += np.log((a + k - 1) / (a + k - 0.5))
    top = a + SHIFTS
    series = sum(factor / top ** (2 * power + 1) for power, factor in enumerate(GAMMA_RATIO))
    return np.log(top) / 2 + series + shifted


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """1 / (1 + d1 / (1 + d2 / ...)), the fraction of the incomplete beta function, until it stands still.

    Each value takes the steps that it needs, whatever others are worked on with it.
    """
    out = np.empty(len(x))
    place = np.arange(len(x))
    tiny, least = 1e-300, 4 * np.finfo(float).eps
    c, d = np.ones(len(x)), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    total = d.copy()
    for m in range(1, BETA_STEPS + 1):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d, c = 1 + term * d, 1 + term / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            change = c * d
            total = total * change
        going = np.abs(change - 1) > least
        if not going.all():
            out[place[~going]] = total[~going]
            place, a, b, x, c, d, total = (v[going] for v in (place, a, b, x, c, d, total))
            if not len(place):
                return out
    out[place] = total
    return out


def _t_by_fraction(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    a, half, x = df / 2, np.full(len(df), 0.5), df / (df + t * t)
    front = np.exp(_log_gamma_ratio(a) + a * np.log(x) + half * np.log(1 - x)) / math.sqrt(math.pi)
    upper = x < (a + 1) / (a + 2.5)
    first, second, share = np.where(upper, a, half), np.where(upper, half, a), np.where(upper, x, t * t / (df + t * t))
    tail = front * _beta_fraction(first, second, share) / first
    return np.where(t == 0, 1.0, np.where(upper, tail, 1 - tail))


def _t_by_normal(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(t) * (1 - 1 / (4 * df)) / np.sqrt(1 + t * t / (2 * df)) / math.sqrt(2))


def _sliced(values: Callable[..., np.ndarray], *arrays: pa.Array) -> pa.Array:
    """``values`` of slices of the arrays; null where any of them is null."""
    columns = [a.to_numpy(zero_copy_only=False).astype(float) for a in arrays]
    null = np.zeros(len(columns[0]), bool)
    for a in arrays:
        null |= a.is_null().to_numpy(zero_copy_only=False)
    out = np.empty(len(null))
    with np.errstate(all="ignore"):
        for start in range(0, len(out), SLICE_VALUES):
            out[start : start + SLICE_VALUES] = values(*[c[start : start + SLICE_VALUES] for c in columns])
    return pa.array(out, pa.float64(), mask=null)


def _t_values(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    out = np.full(len(t), np.nan)
    fraction = (df > 0) & (df <= MANY_DF)
    out[fraction] = _t_by_fraction(t[fraction], df[fraction])
    normal = df > MANY_DF
    out[normal] = _t_by_normal(t[normal], df[normal])
    return out


@F.arrow_udf(DoubleType())
def _erfc_of(z: pa.Array) -> pa.Array:
    return _sliced(_erfc, z)


@F.arrow_udf(DoubleType())
def _t_p_of(t: pa.Array, df: pa.Array) -> pa.Array:
    return _sliced(_t_values, t, df)


def erfc(z: Column) -> Column:
    """Complementary error function for z >= 0, as a column."""
    return _erfc_of(z.cast("double"))


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p value of a t statistic as a column; null without statistic or without degrees of freedom."""
    known = t.isNotNull() & ~F.isnan(t) & (df > 0)
    t, df = t.cast("double"), df.cast("double")
    # up to MANY_DF a square of the statistic that is nothing or all beside them has no logarithm
    x = F.try_divide(df, df + t * t)
    measured = (t == 0) | (df > MANY_DF) | ((x > 0) & (x < 1))
    return F.when(known & measured, _t_p_of(t, df))


def chi2_p_value(x: Column) -> Column:
    """Upper tail of a chi-square with one degree of freedom, as a column."""
    return F.when(x.isNotNull() & ~F.isnan(x), erfc(F.sqrt(F.greatest(x, F.lit(0.0)) / 2)))
