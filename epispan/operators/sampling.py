"""Reproducible folds, splits and subsamples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epispan.functions.hashing import HASH_BITS, hash_cell, stable_hash
from epispan.operators.ranking import hash_rank


def stratified_folds(
    frame: DataFrame, id_col: str, stratum: str, k: int, seed: int, out: str = "fold"
) -> DataFrame:
    """Deal each stratum over ``k`` folds in hashed order; fold sizes differ by at most one."""
    order = stable_hash(seed, F.lit("fold"), id_col)
    ranked = hash_rank(frame, order, id_col, [stratum], out="_rank")
    return ranked.withColumn(out, F.pmod("_rank", F.lit(k)).cast("int")).drop("_rank", "group_rows")


def in_training(id_col: str, seed: int, share: float = 0.75) -> Column:
    """True for a reproducible random share of the ids."""
    limit = int(share * 2**HASH_BITS)
    return stable_hash(seed, F.lit("split"), id_col) < F.lit(limit)


def take_hashed(frame: DataFrame, id_col: str, seed: int, n: int) -> DataFrame:
    """Exactly ``n`` rows (or all) in hashed order, without one global sort.

    Whole leading cells are kept; only the cell in which the limit falls is ranked.
    """
    order = stable_hash(seed, F.lit("subsample"), id_col)
    celled = frame.withColumn("_hash", order).withColumn("_cell", hash_cell(F.col("_hash")))
    counts = celled.groupBy("_cell").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.select(
        "_cell", "_rows", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    ).where(F.col("_before") < n)
    kept = celled.join(F.broadcast(cells), "_cell")
    whole = kept.where(F.col("_before") + F.col("_rows") <= n)
    inside = Window.partitionBy("_cell").orderBy("_hash", id_col)
    partial = (
        kept.where(F.col("_before") + F.col("_rows") > n)
        .withColumn("_rank", F.row_number().over(inside))
        .where(F.col("_before") + F.col("_rank") <= n)
        .drop("_rank")
    )
    return whole.unionByName(partial).select(*frame.columns)


def subsample_controls(
    frame: DataFrame, id_col: str, exposed: str, factor: float, seed: int
) -> DataFrame:
    """Keep ``int(factor * n_exposed)`` random controls when there are more than that."""
    sizes = frame.agg(
        F.count_if(F.col(exposed)).alias("n1"), F.count_if(~F.col(exposed)).alias("n0")
    ).first()
    if sizes["n0"] <= factor * sizes["n1"]:
        return frame
    controls = take_hashed(frame.where(~F.col(exposed)), id_col, seed, int(factor * sizes["n1"]))
    return frame.where(F.col(exposed)).unionByName(controls)


def best_trial(trials: DataFrame, params: str, metric: str, minimize: bool) -> DataFrame:
    pick = F.min_by if minimize else F.max_by
    edge = F.min if minimize else F.max
    return trials.agg(
        pick(params, F.col(metric)).alias("best_params"), edge(metric).alias("best_value")
    )


def mean_over_folds(results: DataFrame, trial: str, metric: str) -> DataFrame:
    return results.groupBy(trial).agg(F.avg(metric).alias(metric))
