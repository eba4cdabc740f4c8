"""Isotonic regression by pooling blocks: in score cells first, then over neighbouring cells, level by level.

Rows become counts per distinct score. Every cell of scores pools its own adjacent violators; what is left are blocks of rising
means. Pooling the blocks of two neighbouring runs gives what pooling all their rows at once would, so runs double in length
until one is left, and only the steps of the result reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispan.operators.ranking import assign_cells, value_splits
from epispan.session import cut

CELL_SCORES = 200_000
BLOCK_DDL = "cell int, first double, last double, n double, total double"


def pool(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Starts of the blocks that pooling leaves: their means rise strictly."""
    starts, sizes, sums = [], [], []
    for k in range(len(n)):
        start, size, value = k, float(n[k]), float(total[k])
        while starts and sums[-1] * size >= value * sizes[-1]:
            start = starts.pop()
            size += sizes.pop()
            value += sums.pop()
        starts.append(start)
        sizes.append(size)
        sums.append(value)
    return np.array(starts, int)


def pooled(blocks: pd.DataFrame) -> pd.DataFrame:
    """Blocks of one run after pooling."""
    blocks = blocks.sort_values("first", kind="stable")
    starts = pool(blocks["n"].to_numpy(), blocks["total"].to_numpy())
    ends = np.r_[starts[1:], len(blocks)] - 1
    return pd.DataFrame(
        {
            "cell": np.int32(blocks["cell"].iloc[0]),
            "first": blocks["first"].to_numpy()[starts],
            "last": blocks["last"].to_numpy()[ends],
            "n": np.add.reduceat(blocks["n"].to_numpy(), starts),
            "total": np.add.reduceat(blocks["total"].to_numpy(), starts),
        }
    )


@dataclass(frozen=True)
class Steps:
    """Ends of the blocks and their means; values between two blocks are interpolated, beyond the ends they stay."""

    places: tuple[float, ...]
    values: tuple[float, ...]

    def value(self, score: Column) -> Column:
        places, values = np.array(self.places), np.array(self.values)

        @F.pandas_udf("double")
        def read(x: pd.Series) -> pd.Series:
            return pd.Series(np.interp(x.to_numpy(np.float64), places, values)).where(x.notna().to_numpy())

        return read(score)


def fit(frame: DataFrame, score: str, label: str, cell_scores: int = CELL_SCORES) -> Steps:
    """Non-decreasing means of a numeric label along the score; rows without a score or label are ignored."""
    known = frame.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = known.groupBy(F.col(score).cast("double").alias("first")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(label).cast("double")).alias("total")
    )
    counts = cut(counts, "isotonic-scores")
    size = counts.count()
    if not size:
        raise ValueError("no row has a score and a label")
    splits = value_splits(counts, "first", max(1, math.ceil(size / cell_scores)))
    blocks = assign_cells(counts, "first", splits, "cell").select("cell", "first", F.col("first").alias("last"), "n", "total")
    cells = len(splits) - 1
    blocks = cut(blocks.groupBy("cell").applyInPandas(pooled, BLOCK_DDL), "isotonic-blocks")
    while cells > 1:
        blocks = blocks.withColumn("cell", F.shiftright("cell", 1))
        blocks = cut(blocks.groupBy("cell").applyInPandas(pooled, BLOCK_DDL), "isotonic-blocks")
        cells = math.ceil(cells / 2)
    found = blocks.orderBy("first").collect()
    places = [p for r in found for p in ((r["first"],) if r["first"] == r["last"] else (r["first"], r["last"]))]
    values = [r["total"] / r["n"] for r in found for _ in range(1 if r["first"] == r["last"] else 2)]
    return Steps(tuple(places), tuple(values))
