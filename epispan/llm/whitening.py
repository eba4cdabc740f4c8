"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

1. Usable vectors become whole numbers ``x = floor(64 c) + 1000000`` and are written once, as dense blocks of rows. Sums are
   exact; rows are centred on whole numbers plus a remainder below one, so that centring loses nothing.
2. One step of the bidiagonalisation is one pass over the blocks: every block gives ``u = X v`` and ``X' u`` at once and only sums
   of the length of a vector leave it. Right vectors are orthogonalised against all earlier ones, twice, on the driver.
   Left vectors, as long as the table, are never stored: each is ``X w`` for a short ``w``, since ``U = X V B^-1``, and is
   orthogonalised against all earlier ones through the ``X' u`` of the pass before. Nothing is shuffled but these sums.
3. The SVD of the small bidiagonal matrix gives components (``V P``) and deviations (singular values over the root of n). Steps
   end when all wanted triplets are resolved, at the latest after as many steps as dimensions; where a start vector finds only a
   part of the space, the next one starts in the rest of it, so repeated deviations are found too.
4. A last pass projects, after the covariance of the projections was measured in a pass of its own.

What the driver holds grows with the square of the dimensions, not with the rows. Every pass reads written files, so a lost
executor repeats tasks of one pass.

Defined results: a vector that is null, empty, or holds null or non-finite entries is left out, and no rows are returned for it.
Vectors of different lengths raise, as do entries so large that 64-bit whole numbers do not hold the results. Directions without
deviation cannot be whitened and give no component, so a table of one distinct vector gives no rows; nor does an empty table.
Rows are never joined, so ids may be null or repeat.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispan.llm.common import Batches, record
from epispan.session import cut

#: Fixed values of the contract: scale and offset of the whole numbers.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
SEED = 29
#: Deviations below this share of the greatest one count as none: what double precision leaves of a zero.
NOTHING = 1e-7
#: A triplet is resolved when its residual is below this share of the greatest deviation.
RESOLVED = 1e-15
#: Numbers in a block of rows, and numbers written per output batch.
BLOCK_NUMBERS = 1 << 19
BATCH_NUMBERS = 1 << 16

BLOCK_DDL = "ids array<bigint>, dims int, data binary"
BLOCK = pa.schema([("ids", pa.list_(pa.int64())), ("dims", pa.int32()), ("data", pa.binary())])
SUM_DDL = "place int, value double"
SUM = pa.schema([("place", pa.int32()), ("value", pa.float64())])
EXACT_DDL = "place int, value decimal(38,0)"
EXACT = pa.schema([("place", pa.int32()), ("value", pa.decimal128(38, 0))])
OUT_DDL = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
OUT = pa.schema(
    [
        ("vec_id", pa.int64()),
        ("component", pa.int32()),
        ("n", pa.int64()),
        ("deviation", pa.int64()),
        ("whitened", pa.float64()),
        ("explained", pa.float64()),
        ("identity_error", pa.float64()),
    ]
)


@dataclass(frozen=True)
class Centre:
    """Rows, exact sums, and the centre as whole numbers plus remainders below one."""

    n: int
    sums: tuple[int, ...]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], np.float64) / self.n


@dataclass(frozen=True)
class Whitening:
    """Components as columns by falling eigenvalue; ``explained`` are shares of the trace."""

    centre: Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def scaled(self) -> np.ndarray:
        return self.components / np.sqrt(self.eigenvalues)

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace


def whole_numbers(values: np.ndarray) -> np.ndarray:
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if len(scaled) and np.abs(scaled).max() >= 2.0**62:
        raise OverflowError("entries are too large for 64-bit whole numbers")
    return scaled.astype(np.int64) + OFFSET


def to_blocks(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Usable rows as blocks: ids and a dense matrix of whole numbers."""

    def work(batches: Batches) -> Batches:
        for batch in batches:
            lists = batch.column("v")
            flat = lists.flatten()
            numbers = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes not a number
            lengths = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            ends = np.cumsum(lengths)
            bad = np.r_[0, np.cumsum(~np.isfinite(numbers))]
            usable = (lengths > 0) & (bad[ends] == bad[ends - lengths])
            ids = batch.column("id")
            for dims in np.unique(lengths[usable]):
                rows = np.flatnonzero(usable & (lengths == dims))
                step = max(1, BLOCK_NUMBERS // int(dims))
                for k in range(0, len(rows), step):
                    own = rows[k : k + step]
                    matrix = whole_numbers(numbers[(ends[own] - dims)[:, None] + np.arange(dims)])
                    yield record(BLOCK, [ids.take(pa.array(own)).to_pylist()], [dims], [matrix.tobytes()])

    return vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).alias("v")).mapInArrow(work, BLOCK_DDL)


def matrices(batches: Batches):
    """Ids and matrix of every block."""
    for batch in batches:
        for k in range(batch.num_rows):
            dims, data = batch.column("dims")[k].as_py(), batch.column("data")[k].as_buffer()
            yield batch.column("ids")[k].values, np.frombuffer(data, np.int64).reshape(-1, dims)


def centre_of(blocks: DataFrame) -> Centre | None:
    """Exact number of rows and sums; None without rows."""
    dims = [r.dims for r in blocks.select("dims").distinct().limit(2).collect()]
    if not dims:
        return None
    if len(dims) > 1:
        raise ValueError("vectors have different lengths")

    def work(batches: Batches) -> Batches:
        total = np.zeros(dims[0] + 1, object)
        for _, x in matrices(batches):
            high, low = x >> 20, x & (2**20 - 1)  # sums of both parts stay exact in 64 bits
            total += np.r_[high.sum(axis=0).astype(object) * 2**20 + low.sum(axis=0).astype(object), [len(x)]]
        yield record(EXACT, np.arange(len(total)), pa.array([int(t) for t in total], pa.decimal128(38, 0)))

    sums = blocks.select("ids", "dims", "data").mapInArrow(work, EXACT_DDL).groupBy("place").agg(F.sum("value").alias("value"))
    exact = [int(r.value) for r in sums.orderBy("place").collect()]
    return Centre(exact[-1], tuple(exact[:-1]))


def summed(blocks: DataFrame, centre: Centre, measure: Callable[[np.ndarray], np.ndarray], length: int) -> np.ndarray:
    """Sum over all blocks of ``measure(centred rows)``, an array of ``length`` numbers."""
    whole, rest = centre.whole, centre.rest

    def work(batches: Batches) -> Batches:
        total = np.zeros(length)
        for _, x in matrices(batches):
            total += measure((x - whole) - rest)
        yield record(SUM, np.arange(length), total)

    sums = blocks.mapInArrow(work, SUM_DDL).groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(length)
    for r in sums.collect():
        out[r.place] = r.value
    return out


def products(blocks: DataFrame, centre: Centre, w: np.ndarray) -> tuple[np.ndarray, float]:
    """``X' X w`` and the square of the length of ``X w``, in one pass."""

    def measure(x: np.ndarray) -> np.ndarray:
        u = x @ w
        return np.r_[u @ x, u @ u]

    both = summed(blocks, centre, measure, len(w) + 1)
    return both[:-1], both[-1]


def apart(vector: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """The part of a vector that is orthogonal to an orthonormal basis, taken off twice."""
    if basis:
        q = np.array(basis)
        for _ in range(2):
            vector = vector - q.T @ (q @ vector)
    return vector


class Bidiagonal:
    """Right vectors ``v``, left vectors as ``X w`` with their ``X' u``, and the upper bidiagonal matrix of both."""

    def __init__(self, dims: int):
        self.draw = np.random.default_rng(SEED)
        self.dims = dims
        self.v: list[np.ndarray] = []
        self.w: list[np.ndarray] = []
        self.back: list[np.ndarray] = []  # X'u of every left vector

    def random_start(self) -> np.ndarray:
        start = apart(self.draw.standard_normal(self.dims), self.v)
        return start / np.linalg.norm(start)

    def matrix(self) -> np.ndarray:
        """``U' X V``. Every new start leaves its first column, and the row it broke off, with what couples it to the rest."""
        return np.triu(np.array(self.back) @ np.array(self.v).T)

    def step(self, v: np.ndarray, multiply: Callable, greatest: float) -> tuple[np.ndarray, float] | None:
        """Adds ``v`` and its left vector; returns the next right vector and its coupling, or None where the space ends."""
        self.v.append(v)
        w = v
        if self.w:  # X v without its parts along earlier left vectors: u'Xv = (X'u)'v
            w = w - np.array(self.w).T @ (np.array(self.back) @ v)
        back, square = multiply(w)
        if self.w:  # once more, by the products of this pass
            off = np.array(self.w) @ back
            w, back = w - np.array(self.w).T @ off, back - np.array(self.back).T @ off
            square = max(square - off @ off, 0.0)
        length = np.sqrt(square)
        if length <= NOTHING * greatest:
            return None  # X v lies in the span of earlier left vectors: a last column without a row of its own
        self.w.append(w / length)
        self.back.append(back / length)
        rest = apart(self.back[-1], self.v)
        size = np.linalg.norm(rest)
        return None if size <= RESOLVED * greatest else (rest / size, size)


def resolved(own: Bidiagonal, coupling: float, wanted: int) -> bool:
    """Whether the residuals of the wanted triplets are as small as rounding."""
    if len(own.w) < wanted:
        return False
    left, sizes, _ = np.linalg.svd(own.matrix())
    return bool((coupling * np.abs(left[-1, :wanted])).max() <= RESOLVED * sizes[0])


def fit(blocks: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components and deviations of the centred rows; None if there is no deviation at all."""
    centre = centre_of(blocks)
    if centre is None:
        return None
    dims = len(centre.sums)
    trace = summed(blocks, centre, lambda x: np.array([(x * x).sum()]), 1)[0]
    if not trace:
        return None
    greatest = np.sqrt(trace)  # at least the greatest deviation
    own = Bidiagonal(dims)
    multiply = lambda w: products(blocks, centre, w)
    searched = False  # whether the rest of the space was entered anew after the wanted triplets were resolved
    v = own.random_start()
    while True:
        after = own.step(v, multiply, greatest)
        if len(own.v) == dims:
            break
        if after is not None and resolved(own, after[1], components):
            if searched:
                break
            searched, after = True, None  # the rest of the space may repeat a deviation
        v = after[0] if after else own.random_start()
    _, sizes, right = np.linalg.svd(own.matrix())
    used = np.flatnonzero(sizes > NOTHING * sizes[0])[:components]
    found = np.array(own.v).T @ right[used].T
    return Whitening(centre, found, sizes[used] ** 2 / centre.n, trace / centre.n)


def whitened_covariance(blocks: DataFrame, fitted: Whitening) -> np.ndarray:
    """Covariance of the whitened rows, measured in a pass over them."""
    scaled = fitted.scaled
    k = scaled.shape[1]

    def measure(x: np.ndarray) -> np.ndarray:
        y = x @ scaled
        return np.r_[(y.T @ y).ravel(), y.sum(axis=0)]

    sums = summed(blocks, fitted.centre, measure, k * k + k) / fitted.centre.n
    return sums[: k * k].reshape(k, k) - np.outer(sums[k * k :], sums[k * k :])


def deviations(x: np.ndarray, centre: Centre) -> np.ndarray:
    """Exact sums of squares of ``n x - S``."""
    parts = x - centre.whole
    rest = np.array([s % centre.n for s in centre.sums], np.int64)
    rough = ((parts - centre.rest) ** 2).sum(axis=1) * float(centre.n) ** 2
    if len(rough) and rough.max() >= 2.0**63 - 2.0**40:
        raise OverflowError("deviations do not fit 64-bit whole numbers")
    return ((centre.n * parts - rest) ** 2).sum(axis=1)


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """A row per usable vector and component: the whitened value, with exact deviation, explained share and measured error."""
    spark = vectors.sparkSession
    blocks = cut(to_blocks(vectors, vec_id, embedding), "whitening-blocks")
    fitted = fit(blocks, components)
    if fitted is None:
        return spark.createDataFrame([], OUT_DDL)
    error = float(np.abs(whitened_covariance(blocks, fitted) - np.eye(len(fitted.eigenvalues))).max())
    k, centre = len(fitted.eigenvalues), fitted.centre
    whole, rest, scaled, explained = centre.whole, centre.rest, fitted.scaled, fitted.explained

    def work(batches: Batches) -> Batches:
        for ids, x in matrices(batches):
            step = max(1, BATCH_NUMBERS // k)
            for a in range(0, len(x), step):
                part = x[a : a + step]
                m = len(part)
                y = ((part - whole) - rest) @ scaled
                own = ids.slice(a, m).take(pa.array(np.repeat(np.arange(m), k)))
                yield record(
                    OUT,
                    own,
                    np.tile(np.arange(1, k + 1, dtype=np.int32), m),
                    np.full(m * k, centre.n),
                    np.repeat(deviations(part, centre), k),
                    y.ravel(),
                    np.tile(explained, m),
                    np.full(m * k, error),
                )

    return blocks.mapInArrow(work, OUT_DDL)
