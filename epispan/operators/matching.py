"""One-to-one nearest neighbour matching on a score within a caliper, and match diagnostics.

The matching is the global greedy one: pairs are taken in the strict order (distance, lower score
of the pair, treated rank, control rank), where ranks number the persons of one score.  Persons
of one score are interchangeable up to their rank, so the work runs on distinct scores with
counts.  Score cells are worked off independently; a pair is taken only when neither side can
have a better partner outside its cell, which never changes the greedy result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epispan.functions.hashing import hash_cell, stable_hash
from epispan.operators.ranking import TIE_CELLS, assign_cells, value_rank, value_splits
from epispan.session import cut

CELL_VALUES = 200_000
#: Share of a cell by which the edges move per round: no two rounds have the same edges.
EDGE_MOVE = 0.6180339887
IDLE_ROUNDS = 20
HEAVY_SCORE = 100_000
PAIR_CHUNK = 10_000
ROUND_SCHEMA = (
    "matched boolean, t_score double, t_start bigint, c_score double, c_start bigint, n bigint"
)


def smaller_arm(frame: DataFrame, treated: str) -> DataFrame:
    """Arm sizes and which arm is matched from; equal arms match from the controls."""
    sizes = frame.agg(
        F.count_if(F.col(treated)).alias("n_treated"), F.count_if(~F.col(treated)).alias("n_control")
    )
    fewer = F.when(F.col("n_treated") < F.col("n_control"), "treated").otherwise("control")
    return sizes.withColumn("minority", fewer)


def balanced_weights(frame: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Inverse-frequency class weights ``n / (2 * n_class)``; the joined table has two rows."""
    sizes = frame.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(Window.partitionBy())
    weights = sizes.select(label, (total / (2 * F.col("_n"))).alias(out))
    return frame.join(F.broadcast(weights), label)


def ranked_by_score(frame: DataFrame, id_col: str, treated: str, score: str) -> DataFrame:
    """Zero-based rank of every person within (score, arm), in the order (hash of the id, id).

    The order is the same for rare and frequent scores; ``HEAVY_SCORE`` only decides which scores
    are ranked by several tasks.
    """
    rows = frame.select(
        F.col(id_col).alias("id"), F.col(treated).alias("treated"), F.col(score).alias("score")
    )
    heavy = (
        rows.groupBy("score", "treated")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > HEAVY_SCORE)
    )
    tie = hash_cell(stable_hash(0, F.lit("tie"), "id"), int(math.log2(TIE_CELLS)))
    # at most one heavy score per HEAVY_SCORE persons
    keyed = (
        rows.withColumn("_order", tie)
        .join(F.broadcast(heavy), ["score", "treated"], "left")
        .withColumn(
            "_tie", F.when(F.col("_n").isNotNull(), F.col("_order")).otherwise(F.lit(0).cast("bigint"))
        )
    )
    # only heavy scores have more than one tie cell, so only they need offsets
    counts = (
        keyed.where(F.col("_n").isNotNull())
        .groupBy("score", "treated", "_tie")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    before = (
        Window.partitionBy("score", "treated").orderBy("_tie").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        "score", "treated", "_tie", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("score", "treated", "_tie").orderBy("_order", "id")
    return (
        keyed.withColumn("_r", F.row_number().over(inside) - 1)
        .join(offsets, ["score", "treated", "_tie"], "left")
        .select(
            "id", "treated", "score", (F.coalesce("_before", F.lit(0)) + F.col("_r")).alias("rank")
        )
    )


def greedy_cell(
    score: np.ndarray,
    is_treated: np.ndarray,
    count: np.ndarray,
    outside: dict[str, float],
    caliper: float,
) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """Greedy matching of sorted distinct scores, each with ``count`` persons of one arm.

    ``outside`` holds the nearest scores beyond the cell per side and arm (nan when none).
    Returns the taken blocks (left node, right node, persons) in order, and the persons left over.
    """
    size = len(score)
    free = count.astype("int64").copy()
    before, after = np.arange(size) - 1, np.arange(1, size + 1)
    # a border is a node and its right neighbour of the other arm; borders form a list of their own
    borders = np.flatnonzero(is_treated[1:] != is_treated[:-1])
    border_before = dict(zip(borders.tolist(), [-1, *borders.tolist()]))
    border_after = dict(zip(borders.tolist(), [*borders[1:].tolist(), -1]))
    heap: list[tuple] = []
    blocks: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        gap = score[after[i]] - score[i]
        if gap <= caliper:
            heapq.heappush(heap, (gap, score[i], i, int(after[i])))

    def unlink(border: int) -> None:
        left, right = border_before.pop(border), border_after.pop(border)
        if left >= 0:
            border_after[left] = right
        if right >= 0:
            border_before[right] = left

    def beyond(side: str, node: int) -> float:
        edge = outside[f"{side}_{'control' if is_treated[node] else 'treated'}"]
        return math.inf if math.isnan(edge) else abs(score[node] - edge)

    for border in borders.tolist():
        offer(border)
    while heap:
        gap, _, i, j = heapq.heappop(heap)
        if i not in border_after or after[i] != j:
            continue
        left, right = border_before[i], border_after[i]
        # the nearest other partner of i sits at the border before, that of j at the border after
        rival_i = score[i] - score[left] if left >= 0 else beyond("left", i)
        rival_j = score[after[right]] - score[j] if right >= 0 else beyond("right", j)
        if rival_i <= gap or rival_j < gap:
            continue  # undecided until the neighbouring cell is known
        taken = int(min(free[i], free[j]))
        blocks.append((i, j, taken))
        free[i] -= taken
        free[j] -= taken
        unlink(i)
        if free[i] == 0 and left >= 0 and after[left] == i:
            left, gone = border_before[left], left
            unlink(gone)
        if free[j] == 0 and right == j:
            right, gone = border_after[right], right
            unlink(gone)
        for node in (i, j):
            if free[node] == 0:
                if before[node] >= 0:
                    after[before[node]] = after[node]
                if after[node] < size:
                    before[after[node]] = before[node]
        a = i if free[i] else int(before[i])
        b = j if free[j] else int(after[j])
        if a >= 0 and b < size and is_treated[a] != is_treated[b]:
            border_before[a], border_after[a] = left, right
            if left >= 0:
                border_after[left] = a
            if right >= 0:
                border_before[right] = a
            offer(a)
    return blocks, free


def still_hopeful(
    score: np.ndarray,
    is_treated: np.ndarray,
    free: np.ndarray,
    outside: dict[str, float],
    caliper: float,
) -> np.ndarray:
    """Nodes with persons left and any opposite person within the caliper, inside or outside."""
    hopeful = np.zeros(len(score), dtype=bool)
    for own, arm in ((is_treated, "control"), (~is_treated, "treated")):
        other = ~own & (free > 0)
        left = np.maximum.accumulate(np.where(other, score, -np.inf))
        left = np.fmax(left, outside[f"left_{arm}"])
        right = np.minimum.accumulate(np.where(other, score, np.inf)[::-1])[::-1]
        right = np.fmin(right, outside[f"right_{arm}"])
        near = (score - left <= caliper) | (right - score <= caliper)
        hopeful |= own & (free > 0) & near
    return hopeful


def _match_cell(caliper: float):
    """Per-cell task: blocks taken and nodes left over, as rows of the round schema."""
    sides = ("left_treated", "left_control", "right_treated", "right_control")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score")
        score = pdf["score"].to_numpy()
        treated = pdf["treated"].to_numpy(dtype=bool)
        outside = {side: float(pdf[side].iloc[0]) for side in sides}
        blocks, free = greedy_cell(score, treated, pdf["n"].to_numpy(), outside, caliper)
        start = pdf["start"].to_numpy().astype("int64").copy()
        rows = []
        for i, j, taken in blocks:
            t, c = (i, j) if treated[i] else (j, i)
            rows.append((True, score[t], int(start[t]), score[c], int(start[c]), taken))
            start[t] += taken
            start[c] += taken
        for k in np.flatnonzero(still_hopeful(score, treated, free, outside, caliper)):
            own = (score[k], int(start[k]))
            none = (None, None)
            pair = (*own, *none) if treated[k] else (*none, *own)
            rows.append((False, *pair, int(free[k])))
        names = ["matched", "t_score", "t_start", "c_score", "c_start", "n"]
        out = pd.DataFrame(rows, columns=names)
        types = {"matched": "bool", "t_score": "float64", "c_score": "float64", "n": "int64"}
        return out.astype({**types, "t_start": "Int64", "c_start": "Int64"})

    return work


def _with_outside(cells: DataFrame) -> DataFrame:
    """Add the nearest scores of both arms beyond each cell; one summary row per cell is shared."""
    arms = {"treated": F.col("treated"), "control": ~F.col("treated")}
    ends = cells.groupBy("cell").agg(
        *[F.min(F.when(cond, F.col("score"))).alias(f"lo_{arm}") for arm, cond in arms.items()],
        *[F.max(F.when(cond, F.col("score"))).alias(f"hi_{arm}") for arm, cond in arms.items()],
    )
    earlier = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy("cell").rowsBetween(1, Window.unboundedFollowing)
    missing = F.lit(float("nan"))
    edges = ends.select(
        "cell",
        *[F.coalesce(F.max(f"hi_{arm}").over(earlier), missing).alias(f"left_{arm}") for arm in arms],
        *[F.coalesce(F.min(f"lo_{arm}").over(later), missing).alias(f"right_{arm}") for arm in arms],
    )
    return cells.join(F.broadcast(edges), "cell")


def _round(nodes: DataFrame, n_cells: int, shift: float, caliper: float) -> DataFrame:
    splits = value_splits(nodes, "score", n_cells, shift) if n_cells > 1 else [-math.inf, math.inf]
    cells = _with_outside(assign_cells(nodes, "score", splits, "cell"))
    return cells.groupBy("cell").applyInPandas(_match_cell(caliper), ROUND_SCHEMA)


def _left_over(result: DataFrame) -> DataFrame:
    is_treated = F.col("t_score").isNotNull()
    return result.where(~F.col("matched")).select(
        F.coalesce("t_score", "c_score").alias("score"),
        is_treated.alias("treated"),
        F.coalesce("t_start", "c_start").alias("start"),
        "n",
    )


def match_blocks(scores: DataFrame, caliper: float, cell_values: int = CELL_VALUES) -> DataFrame:
    """Blocks of pairs ``(t_score, t_start, c_score, c_start, n)`` from counts per score.

    ``scores`` has one row per distinct score with ``n_t`` and ``n_c``.  Equal scores pair up
    first; the surplus goes through rounds of independent score cells until nobody is left who
    could find a partner. Cell edges move from round to round. A pair waits while a closer partner of either side is
    undecided beyond an edge, so a chain of ever closer partners over many cells takes about a round per cell; cells
    stay as small as ``cell_values`` for all that.
    """
    equal = F.least("n_t", "n_c")
    zero = F.lit(0).cast("bigint")
    same = scores.where(equal > 0).select(
        F.col("score").alias("t_score"),
        zero.alias("t_start"),
        F.col("score").alias("c_score"),
        zero.alias("c_start"),
        equal.alias("n"),
    )
    nodes = scores.where(F.col("n_t") != F.col("n_c")).select(
        "score",
        (F.col("n_t") > F.col("n_c")).alias("treated"),
        equal.alias("start"),
        F.abs(F.col("n_t") - F.col("n_c")).alias("n"),
    )
    blocks = same
    size, idle, turn = nodes.count(), 0, 0
    while size > 0:
        n_cells = max(1, math.ceil(size / cell_values))
        result = _round(nodes, n_cells, turn * EDGE_MOVE % 1, caliper)
        if n_cells > 1:
            result = cut(result, "match-round")
        blocks = blocks.unionByName(result.where("matched").drop("matched"))
        if n_cells == 1:
            break
        nodes = _left_over(result)
        left = nodes.count()
        # the closest pair of all is taken as soon as no cell edge parts it, so rounds without a pair are rare
        idle = idle + 1 if left == size else 0
        if idle > IDLE_ROUNDS:
            raise RuntimeError(f"no pair was found in {idle} rounds over {left} scores")
        size, turn = left, turn + 1
    return blocks


def _pair_rows(blocks: DataFrame) -> DataFrame:
    """One row per pair; a large block is cut into chunks that spread over tasks."""
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / PAIR_CHUNK))
    large = F.col("n") > PAIR_CHUNK
    small = blocks.where(~large).withColumn("_chunk", F.lit(0).cast("bigint"))
    spread = blocks.where(large).withColumn("_chunk", F.explode(chunks))
    chunked = small.unionByName(spread.repartition(F.col("t_score"), F.col("c_score"), F.col("_chunk")))
    first = F.col("_chunk") * PAIR_CHUNK
    last = F.least(first + PAIR_CHUNK, F.col("n")) - 1
    unrolled = chunked.withColumn("_k", F.explode(F.sequence(first, last)))
    return unrolled.select(
        "t_score",
        "c_score",
        (F.col("t_start") + F.col("_k")).alias("t_rank"),
        (F.col("c_start") + F.col("_k")).alias("c_rank"),
    )


def nearest_neighbor_match(
    frame: DataFrame,
    id_col: str,
    treated: str,
    score: str,
    caliper: float = 0.2,
    caliper_unit: str = "absolute",
    cell_values: int = CELL_VALUES,
) -> DataFrame:
    """Matched pairs ``(treated_id, control_id, distance)``; each person appears at most once.

    ``caliper_unit='sd'`` measures the caliper in standard deviations of the score.
    """
    if caliper_unit == "sd":
        caliper = caliper * (frame.agg(F.stddev_samp(score)).first()[0] or 0.0)
    elif caliper_unit != "absolute":
        raise ValueError(f"Unknown caliper unit: {caliper_unit}")
    frame = cut(frame.select(id_col, treated, score), "match-input")
    scores = frame.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(treated)).alias("n_t"), F.count_if(~F.col(treated)).alias("n_c")
    )
    scores = cut(scores, "match-scores")
    pairs = _pair_rows(cut(match_blocks(scores, caliper, cell_values), "match-blocks"))
    ranked = ranked_by_score(frame, id_col, treated, score)
    side = {
        prefix: ranked.where(cond).select(
            F.col("score").alias(f"{prefix}_score"),
            F.col("rank").alias(f"{prefix}_rank"),
            F.col("id").alias(f"{arm}_id"),
        )
        for prefix, arm, cond in (
            ("t", "treated", F.col("treated")),
            ("c", "control", ~F.col("treated")),
        )
    }
    return (
        pairs.join(side["t"], ["t_score", "t_rank"])
        .join(side["c"], ["c_score", "c_rank"])
        .select("treated_id", "control_id", F.abs(F.col("t_score") - F.col("c_score")).alias("distance"))
    )


def matched_ids(pairs: DataFrame, id_col: str) -> DataFrame:
    both = F.explode(F.array("treated_id", "control_id"))
    return pairs.select(both.alias(id_col))


def match_filter(frame: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    """Rows of the matched persons."""
    return frame.join(matched_ids(pairs, id_col), id_col, "left_semi")


def rolling_rate(
    frame: DataFrame,
    value: str,
    outcome: str,
    id_col: str,
    window: int = 50,
    n_cells: int = 200,
    block: int = 10_000,
) -> DataFrame:
    """Mean outcome of each row and the ``window - 1`` rows before it in score order.

    Null until the window is full.  Positions are cut into blocks; the last rows of a block are
    also sent to the next one.
    """
    tie = stable_hash(0, F.lit("tie"), id_col)
    placed = value_rank(
        frame.select(id_col, value, outcome), value, tie, id_col, n_cells
    ).drop("group_rows")
    number = F.floor(F.col("position") / block)
    overlap = F.col("position") % block >= block - (window - 1)
    spread = placed.withColumn("_own", number).withColumn(
        "_block", F.explode(F.when(overlap, F.array(number, number + 1)).otherwise(F.array(number)))
    )
    span = Window.partitionBy("_block").orderBy("position").rowsBetween(-(window - 1), 0)
    rate = F.when(F.count(F.lit(1)).over(span) == window, F.avg(F.col(outcome).cast("double")).over(span))
    return (
        spread.withColumn("rate", rate)
        .where(F.col("_own") == F.col("_block"))
        .select(id_col, value, "position", "rate")
    )


def calibration_table(
    frame: DataFrame, value: str, outcome: str, id_col: str, bins: int = 10, n_cells: int = 200
) -> DataFrame:
    """Mean prediction and observed rate in equally filled bins of the prediction."""
    tie = stable_hash(0, F.lit("tie"), id_col)
    placed = value_rank(frame.select(id_col, value, outcome), value, tie, id_col, n_cells)
    slot = F.floor(F.col("position") * bins / F.col("group_rows")).cast("int")
    return placed.groupBy(slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("predicted"),
        F.avg(F.col(outcome).cast("double")).alias("observed"),
    )
