"""Exact ranks, positions and quantiles that never put a whole group into one task.

Rows are spread over order-preserving cells, ranked inside their cell, and shifted by the counts
of the cells before.  Only the cell counts (a few thousand rows per group) meet in one place.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epispan.functions.hashing import hash_cell
from epispan.session import cut

TIE_CELLS = 256
#: Most cells taken from one sketch; its accuracy is fixed, so it stays small at any number of rows.
SKETCH_CELLS = 500
SKETCH_ACCURACY = 20 * SKETCH_CELLS


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def cell_offsets(frame: DataFrame, by: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """Rows per cell and rows in the cells before it, within each group.

    One row per (group, cell): the caller's cell count bounds its size.
    """
    counts = frame.groupBy(*by, *cells).agg(F.count(F.lit(1)).alias("cell_rows"))
    before = Window.partitionBy(*by).orderBy(*cells).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    return counts.select(
        *by,
        *cells,
        F.coalesce(F.sum("cell_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("cell_rows").over(whole).alias("group_rows"),
    )


def rank_in_cells(
    frame: DataFrame, by: Sequence[str], cells: Sequence[str], order: Sequence[str], out: str
) -> DataFrame:
    """Zero-based rank within ``by`` ordered by (cells, order); adds ``out`` and ``group_rows``."""
    offsets = cell_offsets(frame, by, cells)
    inside = Window.partitionBy(*by, *cells).orderBy(*order)
    return (
        frame.withColumn("_in_cell", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), [*by, *cells])
        .withColumn(out, F.col("rows_before") + F.col("_in_cell"))
        .drop("_in_cell", "rows_before", *cells)
    )


def hash_rank(
    frame: DataFrame, hashed: Column, id_col: str, by: Sequence[str] = (), out: str = "hash_rank"
) -> DataFrame:
    """Zero-based rank by (hash, id) within each group, e.g. a reproducible random order."""
    keyed = frame.withColumn("_hash", hashed).withColumn("_cell", hash_cell(F.col("_hash")))
    return rank_in_cells(keyed, list(by), ["_cell"], ["_hash", id_col], out).drop("_hash")


def _sketch(value: str, probs: Sequence[float], accuracy: int) -> Column:
    return F.percentile_approx(value, F.array(*[F.lit(p) for p in probs]), accuracy).alias("edges")


def _splits(edges: Sequence[float]) -> list[float]:
    """Sorted cell borders from minus to plus infinity."""
    return [-math.inf, *inner_edges(edges), math.inf]


def inner_edges(edges: Sequence[float]) -> list[float]:
    """Sorted borders between cells; an edge that is met several times is a frequent value with a cell of its own."""
    splits: set[float] = set()
    for edge, repeats in Counter(edges).items():
        splits.add(edge)
        if repeats > 1:
            splits.add(math.nextafter(edge, math.inf))
    return sorted(splits)


def value_splits(frame: DataFrame, value: str, n_cells: int, shift: float = 0.0) -> list[float]:
    """Cell edges for a double column from mergeable quantile sketches.

    A value that spans several edges is frequent; it gets a cell of its own.  ``shift`` moves the
    edges by a share of a cell.  Above ``SKETCH_CELLS`` cells, one sketch cuts the values coarsely
    and one sketch per coarse cell cuts them finely, so no sketch grows with the rows.
    """
    coarse = min(n_cells, SKETCH_CELLS)
    move = shift if n_cells == coarse else 0.0
    probs = [(k + move) / coarse for k in range(1, coarse) if k + move < coarse]
    if not probs:
        return [-math.inf, math.inf]
    splits = _splits(frame.agg(_sketch(value, probs, 20 * coarse)).first()["edges"] or [])
    if n_cells == coarse:
        return splits
    fine = math.ceil(n_cells / coarse)
    inner = [(k + shift) / fine for k in range(fine)]
    celled = assign_cells(frame, value, splits, "_coarse")
    # one short array of edges per coarse cell
    cells = celled.groupBy("_coarse").agg(_sketch(value, inner, SKETCH_ACCURACY)).collect()
    return _splits([edge for cell in cells for edge in cell["edges"]])


def assign_cells(frame: DataFrame, value: str, splits: Sequence[float], out: str) -> DataFrame:
    """Cell number of each value by binary search on the edges."""
    if len(splits) == 2:
        return frame.withColumn(out, F.lit(0))
    bucketed = Bucketizer(
        splits=list(splits), inputCol=value, outputCol=out, handleInvalid="error"
    ).transform(frame)
    return bucketed.withColumn(out, F.col(out).cast("int"))


def value_rank(
    frame: DataFrame, value: str, tie_hash: Column, id_col: str, n_cells: int, out: str = "position"
) -> DataFrame:
    """Zero-based position over all rows ordered by (value, tie cell, id).

    The tie cell comes from a hash of the id, so a value shared by many rows still spreads.  The
    frame, which should hold only the needed columns, is written out because it is read three times.
    """
    frame = cut(frame, "ranked")
    splits = value_splits(frame, value, n_cells)
    celled = assign_cells(frame, value, splits, "_cell").withColumn(
        "_tie", hash_cell(tie_hash, int(math.log2(TIE_CELLS)))
    )
    narrow = [math.nextafter(a, math.inf) >= b for a, b in zip(splits, splits[1:])]
    frequent = [i for i, flag in enumerate(narrow) if flag]
    sub = F.when(F.col("_cell").isin(frequent), F.col("_tie")).otherwise(0) if frequent else F.lit(0)
    celled = celled.withColumn("_sub", sub.cast("int"))
    ranked = rank_in_cells(celled, [], ["_cell", "_sub"], [value, "_tie", id_col], out)
    return ranked.drop("_tie")


def exact_quantiles(
    frame: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = 10000,
) -> DataFrame:
    """Exact linear-interpolation quantiles per group: columns ``by``, ``prob``, ``quantile``.

    A mergeable sketch brackets every requested rank; one more scan counts what lies below the
    bracket and keeps only the values inside, so at most a small share of each group is ordered.
    """
    by = list(by)
    kept = frame.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    slack = 2.0 / accuracy
    lows = [max(0.0, p - slack) for p in probs]
    highs = [min(1.0, p + slack) for p in probs]
    edges = F.percentile_approx("_v", F.array(*[F.lit(p) for p in (*lows, *highs)]), accuracy)
    k = len(probs)
    grouped = kept.groupBy(*by) if by else kept
    brackets = grouped.agg(
        edges.alias("_edges"),
        F.count(F.lit(1)).alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
    )
    # small groups keep every value: one rank there is more than the slack of the sketch
    whole = F.col("_n") < 2 * accuracy
    specs = F.array(
        *[
            F.struct(
                F.lit(float(p)).alias("prob"),
                (F.lit(float(p)) * (F.col("_n") - 1)).alias("rank"),
                F.when(whole | F.lit(lows[i] <= 0), F.col("_min"))
                .otherwise(F.col("_edges")[i])
                .alias("lo"),
                F.when(whole | F.lit(highs[i] >= 1), F.col("_max"))
                .otherwise(F.col("_edges")[k + i])
                .alias("hi"),
            )
            for i, p in enumerate(probs)
        ]
    )
    brackets = brackets.select(*by, F.inline(specs))
    if by:
        # one row per group and requested quantile
        joined = kept.join(F.broadcast(brackets), by)
    else:
        # a single group's few brackets become constants
        found = [tuple(r[c] for c in ("prob", "rank", "lo", "hi")) for r in brackets.collect()]
        rows = [
            F.struct(*[F.lit(v).cast("double").alias(c) for c, v in zip(("prob", "rank", "lo", "hi"), r)])
            for r in found
        ]
        joined = kept.select("_v", F.inline(F.array(*rows)))
    grouped = (
        joined.where(F.col("_v") <= F.col("hi"))
        .withColumn("_at", F.when(F.col("_v") >= F.col("lo"), F.col("_v")))
        .groupBy(*by, "prob", "rank", "_at")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    upto = (
        Window.partitionBy(*by, "prob")
        .orderBy(F.col("_at").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    counted = grouped.withColumn("_cum", F.sum("_c").over(upto)).where(F.col("_at").isNotNull())
    at_or_above = counted.groupBy(*by, "prob", "rank").agg(
        F.min(F.when(F.col("_cum") > F.floor("rank"), F.col("_at"))).alias("_low"),
        F.min(F.when(F.col("_cum") > F.ceil("rank"), F.col("_at"))).alias("_high"),
    )
    share = F.col("rank") - F.floor("rank")
    return at_or_above.select(
        *by,
        "prob",
        (F.col("_low") + (F.col("_high") - F.col("_low")) * share).alias("quantile"),
    )
