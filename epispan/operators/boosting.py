"""Boosted competing risks: trees on histograms, one drawn time per person and round, inverse censoring weights.

In each round every person is looked at one drawn grid time: event free so far, or after which event. Whoever was censored before
says nothing; the others stand for them by the inverse chance of not being censored. A softmax model over these states, with
the time among its features, thus learns cumulative incidences at all times without a row per person and time. Censoring itself
is learned by a second model beside it, in which events take the part of censoring.

Features are cut into at most 255 bins once, bin 0 for missing values. The trees of all states and of censoring grow together, level
by level: one pass per level sums gradients, curvatures and rows per (tree, node, feature, bin) and only these sums reach the driver.
Persons stay one row in blocks of bytes; what earlier trees say of them is worked out again in every pass, so nothing is
cached on executors and a lost one repeats tasks of a single pass.

A search fits many settings on the same few parts of the rows. There every fit is a task of its own (``fit_many``), as long as its
part is small enough for one: it grows the same trees, without passes, and walks every tree once.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispan.functions.hashing import stable_hash
from epispan.operators.blocks import Blocks
from epispan.session import fit_together

BINS = 256
MAX_LEAVES = 31
#: Least curvature of a child, and least chance by which a weight divides.
LEAST_CURVATURE = 1e-3
LEAST_CHANCE = 1e-3
DRAW_BITS = 60
DRAW_MASK = (1 << DRAW_BITS) - 1
SLICE_ROWS = 1 << 14
#: Features of at most as many bins are searched apart from the others, whose empty bins they would share.
FEW_BINS = 32
#: Rows up to which a fit is one task (372 MB in its Python worker at 600,000), and margins that it keeps in memory; more lie in its temp folder.
TASK_ROWS = 750_000
KEPT_MARGINS = 1 << 22
MODEL_DDL = "fit int, model binary"
MODEL = pa.schema([("fit", pa.int32()), ("model", pa.binary())])
#: Columns of a block before the binned features: draw (high and low half), first grid time not before the own time, event, weights.
HIGH, LOW, DUE, EVENT, EVENT_WEIGHT, CENSOR_WEIGHT, FIRST = range(7)


@dataclass
class Tree:
    """Nodes as lists; a leaf has feature -1. Bins up to ``cut`` go left, missing values where ``missing_left`` says."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, missing_left: bool, gain: float, values: Sequence[float]) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.missing_left[node], self.gain[node] = feature, cut, missing_left, gain
        self.left[node] = len(self.feature)
        for value in values:
            for column, start in ((self.feature, -1), (self.cut, 0), (self.missing_left, True), (self.left, 0), (self.value, value), (self.gain, 0.0)):
                column.append(start)
        return self.left[node], self.left[node] + 1

    def sides(self, bins: np.ndarray, but: int = -1) -> dict[int, np.ndarray]:
        """Which rows go left at every split, but those on one feature; quickest for bytes with a feature's bins side by side."""
        found = {}
        for node, f in enumerate(self.feature):
            if f >= 0 and f != but:
                value = bins[:, f]
                goes_left = value <= self.cut[node]
                found[node] = (goes_left if self.missing_left[node] else goes_left & (value != 0)).view(np.uint8)
        return found

    def parts(self, sides: dict[int, np.ndarray], nodes: Sequence[int], found: dict, place: int = 0) -> dict:
        """Adds to ``found`` where rows end below the nodes, from the last to the first; splits without sides are on time, asked at one place."""
        number = np.uint8 if len(self.feature) <= 256 else np.intp
        for node in reversed(nodes):  # children come behind their parents
            if self.feature[node] < 0:
                found[node] = np.full(1, node, number)
                continue
            left, right = found[self.left[node]], found[self.left[node] + 1]
            if node in sides:  # left where the side is 1
                gap = np.multiply(np.subtract(left, right), sides[node], dtype=number)
                found[node] = np.add(gap, right, out=gap)
            else:  # bins of times count from 1
                found[node] = left if place < self.cut[node] else right
        return found

    def ends(self, sides: dict[int, np.ndarray], rows: int) -> np.ndarray:
        """The node in which every row ends."""
        return np.broadcast_to(self.parts(sides, range(len(self.feature)), {})[0], rows)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node in which every row ends."""
        return self.ends(self.sides(bins), len(bins))

    def over_time(self, bins: np.ndarray, times: int, total: np.ndarray) -> None:
        """Adds the tree's values at all grid times to ``total (rows, times)``; time is the last feature, binned by its place."""
        time = bins.shape[1]
        sides, values = self.sides(bins, time), np.array(self.value)
        place, value = np.empty(len(bins), np.intp), np.empty(len(bins))
        cuts = sorted({c for c, f in zip(self.cut, self.feature, strict=True) if f == time and c < times})
        below: list[bool] = [f == time for f in self.feature]  # nodes with a split on time below, which alone change with it
        for node in range(len(below) - 1, -1, -1):
            below[node] |= self.feature[node] >= 0 and (below[self.left[node]] or below[self.left[node] + 1])
        found = self.parts(sides, [node for node, moves in enumerate(below) if not moves], {})
        moving = [node for node, moves in enumerate(below) if moves]
        for first, last in zip([0, *cuts], [*cuts, times], strict=True):
            place[:] = self.parts(sides, moving, dict(found), first)[0]
            total[:, first:last] += np.take(values, place, out=value, mode="clip")[:, None]


@dataclass(frozen=True)
class Boosted:
    """Edges of the bins, starting margins, and trees per round: one per state, then one for censoring."""

    edges: tuple[tuple[float, ...], ...]
    times: int
    start: np.ndarray
    rounds: tuple[tuple[Tree, ...], ...]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return bin_matrix(x, self.edges)

    def curves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cumulative incidences ``(rows, causes, times)`` and the chance of staying uncensored ``(rows, times)``, both monotone."""
        bins = self.binned(x)
        states = len(self.start) - 1
        margin = np.empty((states + 1, self.times, len(x))).transpose(0, 2, 1)  # the rows of a time side by side
        margin[:] = self.start[:, None, None]
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                tree.over_time(bins, self.times, margin[k])
        share = np.exp(margin[:states] - margin[:states].max(axis=0))
        share = np.maximum.accumulate((share / share.sum(axis=0))[1:].transpose(1, 0, 2), axis=2)
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1.0)
        staying = np.minimum.accumulate(1 / (1 + np.exp(margin[states])), axis=1)
        return np.maximum.accumulate(share, axis=2), staying


def bin_matrix(x: np.ndarray, edges: Sequence[Sequence[float]]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8, order="F")
    for k, own in enumerate(edges):
        out[:, k] = np.where(np.isnan(x[:, k]), 0, np.searchsorted(own, x[:, k]) + 1)
    return out


def bin_edges(frame: DataFrame, columns: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Values that end a bin, at most ``bins - 2`` per column: quantiles of the column, without its largest value."""
    shares = [k / (bins - 2) for k in range(1, bins - 1)]
    found = frame.agg(
        *[F.percentile_approx(F.col(f"`{c}`"), shares, 10_000).alias(f"q{k}") for k, c in enumerate(columns)],
        *[F.max(F.col(f"`{c}`")).alias(f"m{k}") for k, c in enumerate(columns)],
    ).first()
    return [sorted({float(v) for v in found[f"q{k}"] or () if v < found[f"m{k}"]}) for k in range(len(columns))]


def staying_chances(frame: DataFrame, time: str, event: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Days, and Kaplan-Meier chances on each of being uncensored and of being event free; events come before censoring of a day.

    As many rows as there are distinct days reach the driver.
    """
    daily = frame.groupBy(F.col(time).alias("t")).agg(F.count_if(F.col(event) > 0).alias("d"), F.count_if(F.col(event) == 0).alias("c"))
    rows = np.array([(float(r.t), r.d, r.c) for r in daily.orderBy("t").collect()]).reshape(-1, 3)
    days, d, c = rows.T
    at_risk = np.cumsum((d + c)[::-1])[::-1]
    uncensored = np.cumprod(1 - c / np.maximum(at_risk - d, 1))
    return days, uncensored, np.cumprod(1 - d / np.maximum(at_risk, 1))


def drawn(rows: np.ndarray, number: int, times: int, seed: int) -> np.ndarray:
    """The place of the grid time at which each person is looked at in a round: from the person's draw alone in the first."""
    key = (rows[:, HIGH].astype(np.uint64) << np.uint64(30)) | rows[:, LOW].astype(np.uint64)
    if number:
        odd = np.random.default_rng([seed, number]).integers(0, 1 << 59, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        with np.errstate(over="ignore"):
            key = (key * odd) & np.uint64(DRAW_MASK)
            key ^= key >> np.uint64(31)
    return ((key >> np.uint64(12)) % np.uint64(times)).astype(int)


class Fit:
    """One pass at a time over the blocks; the driver holds trees and histograms."""

    def __init__(self, blocks: Blocks, edges, times: int, causes: int, chances: tuple[np.ndarray, np.ndarray], params, seed: int):
        self.blocks, self.edges, self.times, self.states = blocks, tuple(map(tuple, edges)), times, causes + 1
        self.at_grid, self.params, self.seed = chances, params, seed
        self.least = max(1, params.min_samples_leaf) - 0.25  # rows of a leaf, which are summed as numbers
        self.rounds: list[tuple[Tree, ...]] = []
        self.start: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"blocks": None}  # tasks need all but the frame they run on

    def seen(self, rows: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Binned features with the drawn time, states ``(rows, states + 1)`` and weights of both models at that time."""
        place = drawn(rows, number, self.times, self.seed)
        bins = np.empty((len(rows), rows.shape[1] - FIRST + 1), np.uint8, order="F")
        bins[:, :-1], bins[:, -1] = rows[:, FIRST:], place + 1
        due, event = rows[:, DUE] <= place, rows[:, EVENT].astype(int)
        of = np.zeros((len(rows), self.states + 1))
        of[np.arange(len(rows)), np.where(due, event, 0)] = 1.0
        of[:, -1] = due & (event == 0)
        weights = np.zeros((len(rows), 2))
        weights[:, 0] = np.where(due, (event > 0) * rows[:, EVENT_WEIGHT], self.at_grid[0][place])
        weights[:, 1] = np.where(due, (event == 0) * rows[:, CENSOR_WEIGHT], self.at_grid[1][place])
        return bins, of, weights

    def begin(self) -> None:
        """Starting margins: logarithms of the weighted shares of the states, and the logit of censoring."""

        def measure(rows):
            _, of, weights = self.seen(rows, 0)
            return np.concatenate([weights[:, 0] @ of[:, :-1], [weights[:, 1] @ of[:, -1], weights[:, 1].sum()]])

        sums = np.maximum(self.blocks.summed(measure, self.states + 2), 1e-12)
        shares = sums[: self.states] / sums[: self.states].sum()
        censored = min(sums[-2] / sums[-1], 1 - 1e-9)
        self.start = np.r_[np.log(shares), np.log(censored / (1 - censored))]

    def margin(self, bins: np.ndarray) -> np.ndarray:
        """What the trees so far say of every row at its drawn time."""
        margin = np.tile(self.start[:, None], len(bins)).T
        place, value = np.empty(len(bins), np.intp), np.empty(len(bins))  # the same memory for every tree
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                place[:] = tree.leaves(bins)
                margin[:, k] += np.take(np.array(tree.value), place, out=value, mode="clip")
        return margin

    def slopes(self, margin: np.ndarray, of: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the loss in every margin."""
        share = np.exp(margin[:, :-1] - margin[:, :-1].max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        share = np.c_[share, 1 / (1 + np.exp(-margin[:, -1]))]
        weight = np.c_[np.repeat(weights[:, :1], self.states, axis=1), weights[:, 1]]
        return weight * (share - of), weight * share * (1 - share)

    def histograms(self, trees: Sequence[Tree], fronts: Sequence[Sequence[int]]) -> list[np.ndarray]:
        """Per tree ``(node of the front, feature, bin, 3)``: sums of gradient, curvature and rows that weigh."""
        number, features = len(self.rounds), len(self.edges) + 1
        shapes = [(len(front), features, BINS, 3) for front in fronts]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])

        def measure(rows):
            totals = [np.zeros(s) for s in shapes]
            for start in range(0, len(rows), SLICE_ROWS):
                bins, of, weights = self.seen(rows[start : start + SLICE_ROWS], number)
                gradient, curvature = self.slopes(self.margin(bins), of, weights)
                for k, (tree, front, total) in enumerate(zip(trees, fronts, totals, strict=True)):
                    if not len(front):
                        continue
                    place = np.full(len(tree.feature), -1)
                    place[list(front)] = np.arange(len(front))
                    weigh = weights[:, int(k == self.states)] > 0
                    node = place[tree.leaves(bins)]
                    own = np.flatnonzero((node >= 0) & weigh)
                    first, sums = node[own] * BINS, (gradient[own, k], curvature[own, k], None)
                    for f in range(features):
                        cell = first + bins[:, f][own]
                        for j, values in enumerate(sums):
                            total[:, f, :, j] += np.bincount(cell, values, len(front) * BINS).reshape(-1, BINS)
            return np.concatenate([t.ravel() for t in totals])

        sums = np.split(self.blocks.summed(measure, int(ends[-1])), ends[:-1])
        return [s.reshape(shape) for s, shape in zip(sums, shapes, strict=True)]

    def best_splits(self, histograms: np.ndarray) -> list[tuple | None]:
        """(gain, feature, cut, missing left, sums left, sums right) per node, the first of equal gains; None if none is allowed."""
        whole = list(histograms[:, 0].sum(axis=1).T[:, :, None, None])
        score = lambda s: s[0] ** 2 / np.maximum(s[1], 1e-300)
        base = score(whole)
        used = np.array([*(len(e) + 2 for e in self.edges), self.times + 1])  # bins beyond are empty
        groups = [np.flatnonzero(used <= FEW_BINS), np.flatnonzero(used > FEW_BINS)]
        best, nodes = [], np.arange(len(histograms))  # per node: gain, feature, cut, missing left, sums on both sides
        for missing_left in (True, False) if histograms[:, :, 0, 2].any() else (True,):
            offers = []
            for features in (g for g in groups if len(g)):
                parts = [np.ascontiguousarray(histograms[..., j][:, features, : used[features].max()]) for j in range(3)]
                left = [np.cumsum(part[:, :, 1:], axis=2) + (part[:, :, :1] if missing_left else 0) for part in parts]
                right = [w - l for w, l in zip(whole, left, strict=True)]
                fits = (np.minimum(left[2], right[2]) >= self.least) & (np.minimum(left[1], right[1]) >= LEAST_CURVATURE)
                gains = np.where(fits, score(left) + score(right) - base, -np.inf)
                first = gains.reshape(len(nodes), -1).argmax(axis=1)
                f, cut = np.unravel_index(first, gains.shape[1:])
                sums = [side[j][nodes, f, cut] for side in (left, right) for j in range(3)]
                offers.append(np.c_[gains[nodes, f, cut], features[f], cut + 1, np.full(len(nodes), missing_left), np.stack(sums, axis=1)])
            offer = offers[0]
            for other in offers[1:]:
                earlier = (other[:, 0] > offer[:, 0]) | ((other[:, 0] == offer[:, 0]) & (other[:, 1] < offer[:, 1]))
                offer = np.where(earlier[:, None], other, offer)
            best.append(offer)
        found = best[0]
        for offer in best[1:]:
            gain = np.where(found[:, 0] > 1e-12, found[:, 0] * (1 + 1e-12), 1e-12)
            found = np.where((offer[:, 0] > gain)[:, None], offer, found)
        return [(gain, int(f), int(cut), bool(missing), sums[:3], sums[3:]) if gain > 1e-12 else None for gain, f, cut, missing, *sums in found.tolist()]

    def grow(self) -> None:
        """One round: a tree per state and one for censoring, level by level up to the depth and the number of leaves allowed."""
        trees = [Tree() for _ in range(self.states + 1)]
        fronts: list[list[int]] = [[0] for _ in trees]
        for _ in range(self.params.max_depth):
            if not any(fronts):
                break
            best = iter(self.best_splits(np.concatenate(self.histograms(trees, fronts))))
            for k, tree in enumerate(trees):
                offers = [(next(best), node) for node in fronts[k]]
                offers = sorted((o for o in offers if o[0] is not None), key=lambda o: (-o[0][0], o[1]))
                room = MAX_LEAVES - sum(f < 0 for f in tree.feature)
                fronts[k] = []
                for (gain, f, cut, missing_left, *sides), node in offers[:room]:
                    values = [-self.params.learning_rate * s[0] / s[1] for s in sides]
                    children = tree.split(node, f, cut, missing_left, gain, values)
                    fronts[k] += [c for c, s in zip(children, sides, strict=True) if s[2] >= 2 * self.least]
                if room <= len(offers):
                    fronts[k] = []  # no leaf may be split any more
        self.rounds.append(tuple(trees))

    def result(self) -> Boosted:
        """The model after all rounds."""
        self.begin()
        for _ in range(self.params.n_iter):
            self.grow()
        return Boosted(self.edges, self.times, self.start, tuple(self.rounds))


class Margins:
    """What the trees say of the rows of every slice at all grid times, ``(states + 1, times, rows)``; in a file if it is much."""

    def __init__(self, sizes: Sequence[int], start: np.ndarray, times: int):
        self.shapes = [(len(start), times, rows) for rows in sizes]
        ends = np.cumsum([0, *(int(np.prod(s)) for s in self.shapes)])
        self.file = tempfile.TemporaryFile() if ends[-1] > KEPT_MARGINS else None
        self.places = [int(e) * 8 for e in ends]
        self.kept: list[np.ndarray | None] = [None] * len(self.shapes)
        for k, shape in enumerate(self.shapes):
            own = np.empty(shape)
            own[:] = start[:, None, None]
            self.put(k, own)

    def put(self, k: int, own: np.ndarray) -> None:
        if self.file is None:
            self.kept[k] = own
        else:
            self.file.seek(self.places[k])
            self.file.write(own.data)

    def get(self, k: int) -> np.ndarray:
        if self.file is None:
            return self.kept[k]
        own = np.empty(self.shapes[k])
        self.file.seek(self.places[k])
        self.file.readinto(own.data.cast("B"))
        return own


class TaskFit(Fit):
    """The same fit on rows that one task holds; a round puts its trees on the margins of all grid times, so each is walked once."""

    def __init__(self, rows: np.ndarray, *settings):
        super().__init__(None, *settings)
        order = np.lexsort(rows.T)  # sums do not depend on the order in which blocks come
        for column in rows.T:  # in place
            column[:] = column[order]
        self.slices = [rows[k : k + SLICE_ROWS] for k in range(0, len(rows), SLICE_ROWS)]
        self.rows, self.margins = len(rows), None

    def begin(self) -> None:
        self.blocks = self  # its own and only block
        super().begin()
        self.margins = Margins([len(s) for s in self.slices], self.start, self.times)

    def summed(self, measure: Callable[[np.ndarray], np.ndarray], length: int) -> np.ndarray:
        return sum((measure(s) for s in self.slices), np.zeros(length))

    def grow(self) -> None:
        """Draws the times of a round and takes the slopes there, then grows its trees."""
        number, states, features = len(self.rounds), self.states + 1, len(self.edges) + 1
        self.bins = np.empty((self.rows, features), np.uint8, order="F")
        self.gradient, self.curvature = (np.empty((self.rows, states), order="F") for _ in range(2))
        weigh = np.empty((self.rows, 2), bool, order="F")
        for k, rows in enumerate(self.slices):
            here = slice(k * SLICE_ROWS, k * SLICE_ROWS + len(rows))
            bins, of, weights = self.seen(rows, number)
            margin = self.margins.get(k)
            for own, tree in zip(margin, self.rounds[-1] if number else (), strict=False):
                tree.over_time(bins[:, :-1], self.times, own.T)
            if number:
                self.margins.put(k, margin)
            at_place = margin[:, bins[:, -1].astype(np.intp) - 1, np.arange(len(rows))].T
            self.bins[here], weigh[here] = bins, weights > 0
            self.gradient[here], self.curvature[here] = self.slopes(at_place, of, weights)
        self.inside = [{0: np.flatnonzero(weigh[:, int(k == self.states)])} for k in range(states)]  # rows of the front's nodes
        self.sums: list = [None] * states
        super().grow()

    def histograms(self, trees: Sequence[Tree], fronts: Sequence[Sequence[int]]) -> list[np.ndarray]:
        """Rows are counted in the smaller child of a split; the other has what is left of the parent's sums."""
        return [self.of_front(k, tree, list(front)) for k, (tree, front) in enumerate(zip(trees, fronts, strict=True))]

    def of_front(self, k: int, tree: Tree, front: list[int]) -> np.ndarray:
        shape = len(front), len(self.edges) + 1, BINS
        total = np.zeros((3, *shape))  # one kind of sum after the other
        if not front:
            return np.moveaxis(total, 0, -1)
        place, inside = {node: j for j, node in enumerate(front)}, {}
        counted, pairs = [], []  # nodes whose rows are counted; places of parent, counted and other child
        for j, (node, rows) in enumerate(self.inside[k].items()):
            children = [c for c in (tree.left[node], tree.left[node] + 1) if c in place]
            if node in place:  # the root
                counted, inside[node] = [node], rows
            elif children:
                value = self.bins[:, tree.feature[node]][rows]
                goes_left = value <= tree.cut[node]
                if not tree.missing_left[node]:
                    goes_left &= value != 0
                inside |= {c: rows[goes_left if c == tree.left[node] else ~goes_left] for c in children}
                children.sort(key=lambda c: len(inside[c]))
                counted.append(children[0])
                pairs += [(j, place[children[0]], place[c]) for c in children[1:]]
        own = np.concatenate([inside[node] for node in counted])
        first = np.repeat([place[node] * BINS for node in counted], [len(inside[node]) for node in counted])
        sums = self.gradient[:, k][own], self.curvature[:, k][own], None
        for f in range(shape[1]):
            cell = first + self.bins[:, f][own]
            for j, values in enumerate(sums):
                total[j, :, f] = np.bincount(cell, values, len(front) * BINS).reshape(-1, BINS)
        if pairs:
            parent, small, large = map(list, zip(*pairs, strict=True))
            total[:, large] = self.sums[k][:, parent] - total[:, small]
        self.inside[k], self.sums[k] = {node: inside[node] for node in front}, total
        return np.moveaxis(total, 0, -1)


@dataclass(frozen=True)
class Training:
    """Rows of one training part, written once for fits of any settings."""

    blocks: Blocks
    rows: int
    edges: Sequence[Sequence[float]]
    times: int
    causes: int
    chances: tuple[np.ndarray, np.ndarray]
    seed: int

    def fitted(self, params) -> Boosted:
        """Boost ``params.n_iter`` rounds pass by pass."""
        return Fit(self.blocks, self.edges, self.times, self.causes, self.chances, params, self.seed).result()

    def fitted_on(self, rows: np.ndarray, params) -> Boosted:
        """The same where all rows are at hand."""
        return TaskFit(rows, self.edges, self.times, self.causes, self.chances, params, self.seed).result()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"blocks": None}  # tasks need all but the frame


def training(frame: DataFrame, id_col: str | Column, columns: Sequence[str], time: str, event: str, grid: Sequence[float], causes: int, seed: int = 0) -> Training:
    """Bins, chances and written rows of a fit; events are 0 (censored) or 1 to ``causes``."""
    if len(grid) > BINS - 2:
        raise ValueError(f"more than {BINS - 2} grid times")
    edges = bin_edges(frame, columns)
    days, uncensored, event_free = staying_chances(frame, time, event)
    times = np.array(grid, float)

    def just_before(chance, t):  # the chance of still staying when the time comes
        return np.r_[1.0, chance][np.searchsorted(days, t)]

    def until(chance, t):
        return np.r_[1.0, chance][np.searchsorted(days, t, side="right")]

    def inverse(chance):
        return 1 / np.maximum(chance, LEAST_CHANCE)

    def shape(raw: np.ndarray) -> np.ndarray:
        t = raw[:, 2]
        due = np.searchsorted(times, t)
        return np.c_[raw[:, :2], due, raw[:, 3], inverse(just_before(uncensored, t)), inverse(until(event_free, t)), bin_matrix(raw[:, 4:], edges)]

    key = stable_hash(seed, F.lit("time"), id_col)
    numbers = [F.shiftright(key, 30), key.bitwiseAND(F.lit((1 << 30) - 1)), F.col(time), F.col(event), *[F.col(f"`{c}`") for c in columns]]
    blocks = Blocks.written(frame.select(F.array(*[n.cast("double") for n in numbers]).alias("row")), "row", shape)
    rows = blocks.frame.agg(F.sum("n")).first()[0] or 0
    return Training(blocks, rows, edges, len(grid), causes, (inverse(until(uncensored, times)), inverse(until(event_free, times))), seed)


def fit(frame: DataFrame, id_col: str | Column, columns: Sequence[str], time: str, event: str, grid: Sequence[float], causes: int, params, seed: int = 0) -> Boosted:
    """Boost ``params.n_iter`` rounds on all rows; events are 0 (censored) or 1 to ``causes``."""
    return training(frame, id_col, columns, time, event, grid, causes, seed).fitted(params)


def fit_many(parts: Sequence[Training], wanted: Sequence[tuple[int, object]]) -> list[Boosted]:
    """Models of ``(part, settings)``, each a task if its rows are few enough, else pass by pass side by side."""
    in_task = [k for k, (p, _) in enumerate(wanted) if 0 < parts[p].rows <= TASK_ROWS]
    found: dict[int, Boosted] = {}
    if in_task:
        frames = []
        for p in sorted({wanted[k][0] for k in in_task}):
            own = F.array(*[F.lit(slot) for slot, k in enumerate(in_task) if wanted[k][0] == p])
            frames.append(parts[p].blocks.frame.withColumn("fit", F.explode(own)))
        tasks = [(parts[p], params) for p, params in (wanted[k] for k in in_task)]

        def work(batches):
            whole: dict[int, np.ndarray] = {}
            filled: dict[int, int] = {}
            for batch in batches:
                for slot, n, data in zip(batch.column("fit").to_pylist(), batch.column("n").to_pylist(), batch.column("data"), strict=True):
                    own = np.frombuffer(data.as_buffer(), np.float64).reshape(n, -1)
                    if slot not in whole:
                        whole[slot], filled[slot] = np.empty((tasks[slot][0].rows, own.shape[1])), 0
                    whole[slot][filled[slot] : filled[slot] + n] = own
                    filled[slot] += n
            for slot in sorted(whole):
                part, params = tasks[slot]
                model = pickle.dumps(part.fitted_on(whole.pop(slot), params))
                yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([model])], schema=MODEL)

        dealt = reduce(DataFrame.unionByName, frames).repartitionById(len(in_task), F.col("fit"))
        found |= {in_task[r.fit]: pickle.loads(r.model) for r in dealt.mapInArrow(work, MODEL_DDL).collect()}
    rest = [k for k in range(len(wanted)) if k not in found]
    if rest:
        spark = parts[wanted[rest[0]][0]].blocks.frame.sparkSession
        found |= zip(rest, fit_together(spark, lambda k: parts[wanted[k][0]].fitted(wanted[k][1]), rest), strict=True)
    return [found[k] for k in range(len(wanted))]
