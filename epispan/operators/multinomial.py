"""Multinomial discrete-time hazards by Newton steps on one row per person.

A person at risk until grid time ``m`` stands for ``m + 1`` periods that differ only in the effect of their time. Gradient and
curvature of all these periods are sums over the grid of the person's class chances, so no period is ever a row: a pass reads one
row per person and returns sums whose length depends on features, times and classes alone.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from epispan.operators.blocks import Blocks

#: Numbers that the chances of a class may take in a slice of rows; a slice with its work arrays stays in a core's cache.
SLICE_NUMBERS = 1 << 13
#: Largest exponent of one of two factors, so that their product stays finite.
SAFE_EXPONENT = 150.0
HALVINGS = 30
#: Fits that step side by side.
AT_ONCE = 16
#: Effect of a class that nobody has: it stays very unlikely.
NEVER = -30.0


@dataclass(frozen=True)
class Fitted:
    by_feature: np.ndarray  # classes x features
    by_time: np.ndarray  # classes x times, the intercept included
    steps: int
    converged: bool


def slices(matrix: np.ndarray, per_row: int):
    step = max(1, SLICE_NUMBERS // per_row)
    for k in range(0, len(matrix), step):
        yield matrix[k : k + step]


def chances(person: np.ndarray, time: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances ``(classes, persons, times)`` of all classes but class 0, and the logarithm of the sum of all odds against class 0.

    Odds are ``exp(person + time)``; the exponential is taken per person and per time where that is safe.
    """
    if max(np.abs(person).max(initial=0.0), np.abs(time).max(initial=0.0)) < SAFE_EXPONENT:
        share = np.exp(person)[:, :, None] * np.exp(time)[:, None, :]
        total = 1.0 + share.sum(axis=0)
        logs = np.log(total)
    else:
        share = person[:, :, None] + time[:, None, :]
        top = np.maximum(share.max(axis=0), 0.0)
        share = np.exp(share - top)
        total = np.exp(-top) + share.sum(axis=0)
        logs = np.log(total) + top
    share /= total
    return share, logs


class Periods:
    """Sums over periods; rows are (last period, class then, features)."""

    def __init__(self, blocks: Blocks, features: int, times: int, classes: int):
        self.blocks, self.p, self.t, self.c = blocks, features, times, classes

    def spread(self) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of periods, the standard deviation of every feature and every time indicator over them, periods per class, and the
        root mean square of every feature."""
        p, t, c = self.p, self.t, self.c

        def measure(rows: np.ndarray) -> np.ndarray:
            last, x = rows[:, 0].astype(int), rows[:, 2:]
            n = last + 1.0
            reached = np.cumsum(np.bincount(last, minlength=t)[::-1])[::-1]
            held = np.bincount(rows[:, 1].astype(int), minlength=c)
            held[0] += last.sum()
            return np.concatenate([[n.sum()], n @ x, n @ x**2, reached, held])

        sums = self.blocks.summed(measure, 1 + 2 * p + t + c)
        (n,), first, second, reached, held = np.split(sums, np.cumsum([1, p, p, t]))
        unbiased = n / max(n - 1, 1)
        of_features = np.sqrt(np.maximum(second / n - (first / n) ** 2, 0) * unbiased)
        return n, of_features, np.sqrt(reached / n * (1 - reached / n) * unbiased), held, np.sqrt(second / n)

    def derivatives(self, points: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Loss, gradient and curvature over features and times, class by class, at every point; one pass for all points."""
        p, t, c = self.p, self.t, self.c

        def measure(rows: np.ndarray) -> np.ndarray:
            return np.concatenate([period_sums(rows, p, t, c, *point) for point in points])

        lengths = (1, p * c, t * c, p * p * c * c, p * t * c * c, t * c * c)
        summed = self.blocks.summed(measure, len(points) * sum(lengths)).reshape(len(points), -1)
        return [self.assembled(np.split(sums, np.cumsum(lengths)[:-1])) for sums in summed]

    def assembled(self, sums: list[np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
        p, t, c = self.p, self.t, self.c
        gx, gt = sums[1].reshape(p, c), sums[2].reshape(t, c)
        gradient = np.concatenate([gx, gt]).T.ravel()
        curvature = np.zeros((c, p + t, c, p + t))
        curvature[:, :p, :, :p] = sums[3].reshape(p, p, c, c).transpose(2, 0, 3, 1)
        xt = sums[4].reshape(p, t, c, c)
        curvature[:, :p, :, p:] = xt.transpose(2, 0, 3, 1)
        curvature[:, p:, :, :p] = xt.transpose(2, 1, 3, 0)
        at = np.arange(p, p + t)
        curvature[:, at, :, at] = sums[5].reshape(t, c, c)
        return sums[0][0], gradient, curvature.reshape(c * (p + t), c * (p + t))


def period_sums(rows: np.ndarray, p: int, t: int, c: int, by_feature: np.ndarray, by_time: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature of the periods of some rows, as one array.

    The chances of all classes add up to one, so the sums of class 0 follow from those of the others, and pairs of classes are
    looked at once. A one before the features makes the sums over times come out of the same products.
    """
    loss, pairs = 0.0, [(a, b) for a in range(1, c) for b in range(a, c)]
    first, second = np.zeros((c, p + 1, t)), np.zeros((len(pairs), p + 1, t))
    seen_x, seen_t, xx = np.zeros((c, p)), np.zeros((c, t)), np.zeros((p, p, c, c))
    effects, times = by_feature[1:] - by_feature[0], by_time[1:] - by_time[0]
    for part in slices(rows, t):
        last, label, x = part[:, 0].astype(int), part[:, 1].astype(int), part[:, 2:]
        ones_x = np.ascontiguousarray(np.c_[np.ones(len(part)), x].T)
        at_risk = np.arange(t) <= last[:, None]
        lean = effects @ x.T
        share, logs = chances(lean, times)
        loss += logs[at_risk].sum()
        share *= at_risk
        for k in range(1, c):
            mine = np.flatnonzero(label == k)
            loss -= (lean[k - 1, mine] + times[k - 1, last[mine]]).sum()
            seen_x[k] += x[mine].sum(axis=0)
            seen_t[k] += np.bincount(last[mine], minlength=t)
            first[k] += ones_x @ share[k - 1]
        for k, (a, b) in enumerate(pairs):
            curve = -share[a - 1] * share[b - 1]
            if a == b:
                curve += share[a - 1]
            second[k] += ones_x @ curve
            xx[:, :, a, b] += (x.T * curve.sum(axis=1)) @ x
    gx, gt = first[:, 1:].sum(axis=2) - seen_x, first[:, 0] - seen_t
    gx[0], gt[0] = -gx[1:].sum(axis=0), -gt[1:].sum(axis=0)
    xt, tt = np.zeros((p, t, c, c)), np.zeros((t, c, c))
    for k, (a, b) in enumerate(pairs):
        tt[:, a, b] = tt[:, b, a] = second[k, 0]
        xt[:, :, a, b] = xt[:, :, b, a] = second[k, 1:]
        xx[:, :, b, a] = xx[:, :, a, b]
    for sums in (xx, xt, tt):
        sums[..., 0, 1:] = sums[..., 1:, 0] = -sums[..., 1:, 1:].sum(axis=-1)
        sums[..., 0, 0] = -sums[..., 0, 1:].sum(axis=-1)
    return np.concatenate([[loss], gx.T.ravel(), gt.T.ravel(), xx.ravel(), xt.ravel(), tt.ravel()])


def with_intercepts(gradient: np.ndarray, curvature: np.ndarray, p: int, t: int, c: int) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives with one intercept per class behind its features and times: it acts at all times alike."""
    lift = np.zeros((p + t + 1, p + t))
    lift[: p + t] = np.eye(p + t)
    lift[p + t, p:] = 1.0
    lift = np.kron(np.eye(c), lift)
    return lift @ gradient, lift @ curvature @ lift.T


def newton(theta: np.ndarray, free: np.ndarray, most: int, tolerance: float, size: np.ndarray | None = None):
    """Damped Newton steps as a generator: yields a point, is sent (value, gradient, curvature), returns (point, steps, converged).

    ``size`` is the size of what each effect multiplies. Without it, the curvatures of a feature of large numbers are so far above
    those of other effects that these count as nothing in the equations.
    """
    size = np.ones(len(theta))[free] if size is None else size[free]
    value, gradient, curvature = yield theta
    converged, steps = False, 0
    while steps < most and not converged:
        step = np.zeros(len(theta))
        sized = curvature[np.ix_(free, free)] / np.outer(size, size)
        step[free] = np.linalg.lstsq(sized, gradient[free] / size, rcond=1e-13)[0] / size
        steps += 1
        for halving in range(HALVINGS):
            moved = theta - step / 2**halving
            after = yield moved
            if after[0] <= value + 1e-14 * abs(value):
                break
        else:
            break
        converged = bool((np.abs(moved - theta) <= tolerance * np.maximum(1.0, np.abs(moved))).all())
        theta, (value, gradient, curvature) = moved, after
    return theta, steps, converged


def together(searches: Sequence, evaluate) -> list:
    """Run generators like ``newton`` side by side; ``evaluate`` answers the points of all that still run in one call."""
    asked, results = {k: next(search) for k, search in enumerate(searches)}, {}
    while asked:
        for k, answer in zip(list(asked), evaluate(list(asked.values())), strict=True):
            try:
                asked[k] = searches[k].send(answer)
            except StopIteration as end:
                results[k] = end.value
                del asked[k]
    return [results[k] for k in range(len(searches))]


def fit(blocks: Blocks, features: int, times: int, classes: int, reg_param: float, most: int = 50, tolerance: float = 1e-9) -> Fitted:
    """Minimum of the mean loss per period plus ``reg_param / 2`` times the squared effects per standard deviation.

    Intercepts are free; what does not vary has no effect, and a class that nobody has stays very unlikely. ``converged`` tells whether the last step changed no effect by more than
    ``tolerance`` (relative to 1 and the effect).
    """
    return fit_without(blocks, features, times, classes, reg_param, [], most, tolerance)[0]


def fit_without(
    blocks: Blocks, features: int, times: int, classes: int, reg_param: float, left_out: Sequence[Sequence[int]],
    most: int = 50, tolerance: float = 1e-9,
) -> list[Fitted]:
    """The fit on all features, then one for each set of features left out.

    The smaller fits start from the full one and step side by side: a pass over the rows returns the sums of up to ``AT_ONCE`` of
    them, and what is left out only loses its rows and columns in the equations.
    """
    sums = Periods(blocks, features, times, classes)
    n, sd_x, sd_t, held, rms = sums.spread()
    width = features + times + 1
    sd = np.r_[sd_x, sd_t, 0.0]
    free = np.r_[sd[:-1] > 1e-12, True] & (held > 0)[:, None]
    penalty = np.tile(reg_param * sd**2, classes)
    size = np.tile(np.r_[np.where(rms > 0, rms, 1.0), np.ones(times + 1)], classes)

    def split(theta):
        table = theta.reshape(classes, width)
        return table[:, :features], table[:, features:-1] + table[:, -1:]

    def evaluate(points):
        answers = []
        for theta, (loss, gradient, curvature) in zip(points, sums.derivatives([split(theta) for theta in points]), strict=True):
            gradient, curvature = with_intercepts(gradient, curvature, features, times, classes)
            answers.append((loss / n + (penalty * theta**2).sum() / 2, gradient / n + penalty * theta, curvature / n + np.diag(penalty)))
        return answers

    def fitted(theta, steps, converged):
        if not converged:
            logging.getLogger(__name__).warning("hazard fit: %d steps did not reach the tolerance %g", steps, tolerance)
        return Fitted(*split(theta), steps, converged)

    theta = np.zeros((classes, width))
    theta[held == 0, -1] = NEVER
    (full,) = together([newton(theta.ravel(), free.ravel(), most, tolerance, size)], evaluate)
    searches = []
    for places in left_out:
        start, open_to = full[0].reshape(classes, width).copy(), free.copy()
        start[:, list(places)], open_to[:, list(places)] = 0.0, False
        searches.append(newton(start.ravel(), open_to.ravel(), most, tolerance, size))
    results = [full]
    for k in range(0, len(searches), AT_ONCE):
        results += together(searches[k : k + AT_ONCE], evaluate)
    return [fitted(*result) for result in results]
