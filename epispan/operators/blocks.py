"""Dense blocks of rows for iterative fits: written once, read in every pass, and only sums of fixed length leave a task."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from epispan.session import cut

BLOCK_DDL = "n int, data binary"
BLOCK = pa.schema([("n", pa.int32()), ("data", pa.binary())])
PART_DDL = "slot int, sums binary"
PART = pa.schema([("slot", pa.int32()), ("sums", pa.binary())])
#: Numbers of a block.
BLOCK_NUMBERS = 1 << 18
#: Partial sums that the driver takes from tasks directly; of more tasks, groups are summed on executors first.
DIRECT_PARTS = 32


def matrix(lists: pa.Array) -> np.ndarray:
    """The rows of a column of lists of one length as a matrix; a null entry is not a number."""
    if lists.null_count:
        raise ValueError("a row has no list")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def nullable(values: np.ndarray) -> pa.Array:
    """A column in which what is not a number is null, so that sums and quantiles pass over it."""
    return pa.array(values, from_pandas=True)


def lists(rows: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as a column of lists."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), nullable(np.ascontiguousarray(rows, np.float64).ravel()))


class Blocks:
    """Rows of numbers of one length, as blocks in the shared folder."""

    def __init__(self, frame: DataFrame):
        self.frame = frame
        self.tasks = frame.rdd.getNumPartitions()

    @classmethod
    def written(cls, rows: DataFrame, column: str, shape: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> Blocks:
        """Blocks of an array column; ``shape`` turns a matrix of its rows into the matrix of doubles that is stored."""

        def work(batches):
            for batch in batches:
                lists = batch.column(0)
                flat = lists.flatten().to_numpy(zero_copy_only=False)  # null becomes not a number
                if not len(flat):
                    continue
                matrix = flat.astype(np.float64).reshape(len(lists), -1)
                step = max(1, BLOCK_NUMBERS // matrix.shape[1])
                for k in range(0, len(matrix), step):
                    part = np.ascontiguousarray(shape(matrix[k : k + step]), np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int32()), pa.array([part.tobytes()])], schema=BLOCK)

        return cls(cut(rows.select(column).mapInArrow(work, BLOCK_DDL), "blocks"))

    def summed(self, measure: Callable[[np.ndarray], np.ndarray], length: int) -> np.ndarray:
        """Sum of ``measure(matrix)``, arrays of ``length`` numbers, over all blocks."""
        slots = max(1, math.isqrt(self.tasks))

        def work(batches):
            total = np.zeros(length)
            for batch in batches:
                for n, data in zip(batch.column("n").to_pylist(), batch.column("data"), strict=True):
                    total += measure(np.frombuffer(data.as_buffer(), np.float64).reshape(n, -1))
            slot = TaskContext.get().partitionId() % slots
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()])], schema=PART)

        def merge(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(b.as_buffer(), np.float64) for b in table.column("sums"))
            return pa.table([table.column("slot")[:1], pa.array([total.tobytes()])], schema=PART)

        parts = self.frame.mapInArrow(work, PART_DDL)
        if self.tasks > DIRECT_PARTS:
            parts = parts.groupBy("slot").applyInArrow(merge, PART_DDL)
        return sum((np.frombuffer(bytes(r.sums), np.float64) for r in parts.collect()), np.zeros(length))
