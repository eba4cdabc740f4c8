"""Sums over periods against a loop over persons, and the memory and columns that passes use."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from epispan.operators.blocks import lists, matrix, nullable
from epispan.operators.multinomial import period_sums


def rows_of(n, p, t, c, scale=1.0):
    rng = np.random.default_rng(5)
    rows = np.c_[rng.integers(0, t, n), rng.integers(0, c, n), scale * rng.normal(size=(n, p))]
    return rows, rng.normal(size=(c, p)), rng.normal(size=(c, t))


def by_loop(rows, p, t, c, by_feature, by_time):
    loss, gx, gt = 0.0, np.zeros((p, c)), np.zeros((t, c))
    xx, xt, tt = np.zeros((p, p, c, c)), np.zeros((p, t, c, c)), np.zeros((t, c, c))
    for row in rows:
        last, label, x = int(row[0]), int(row[1]), row[2:]
        for k in range(last + 1):
            eta = by_feature @ x + by_time[:, k]
            share = np.exp(eta - eta.max())
            share /= share.sum()
            held = label if k == last else 0
            loss += eta.max() - eta[held] + np.log(np.exp(eta - eta.max()).sum())
            off = share - np.eye(c)[held]
            curve = np.diag(share) - np.outer(share, share)
            gx += np.outer(x, off)
            gt[k] += off
            xx += np.multiply.outer(np.outer(x, x), curve)
            xt[:, k] += np.multiply.outer(x, curve)
            tt[k] += curve
    return np.concatenate([[loss], gx.ravel(), gt.ravel(), xx.ravel(), xt.ravel(), tt.ravel()])


@pytest.mark.parametrize(("p", "c", "scale"), [(3, 4, 1.0), (0, 4, 1.0), (2, 2, 1.0), (2, 3, 400.0)])
def test_sums_equal_a_loop_over_persons_and_periods(p, c, scale):
    rows, by_feature, by_time = rows_of(60, p, 5, c, scale)
    want = by_loop(rows, p, 5, c, by_feature, by_time)
    assert period_sums(rows, p, 5, c, by_feature, by_time) == pytest.approx(want, rel=1e-9, abs=1e-9 * np.abs(want).max())


def test_work_arrays_of_a_pass_stay_small():
    rows, by_feature, by_time = rows_of(20_000, 4, 24, 4)
    tracemalloc.start()
    period_sums(rows, 4, 24, 4, by_feature, by_time)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20


def test_curves_are_read_and_written_as_whole_columns():
    rows = np.arange(12.0).reshape(4, 3)
    assert (matrix(lists(rows)) == rows).all()
    assert (matrix(lists(rows).slice(1, 2)) == rows[1:3]).all()
    assert np.isnan(matrix(pa.array([[1.0, None]]))[0, 1])
    with pytest.raises(ValueError, match="no list"):
        matrix(pa.array([[1.0], None]))


def test_what_is_not_a_number_is_null():
    assert nullable(np.array([1.0, np.nan])).to_pylist() == [1.0, None]
    assert lists(np.array([[1.0, np.nan]])).to_pylist() == [[1.0, None]]
