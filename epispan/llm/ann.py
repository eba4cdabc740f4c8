"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, best-bin-first, calibrated.

1. Vectors get one more coordinate that makes all of them equally long (from the greatest norm of all rows), so that the largest
   inner product is the nearest point. The tree is fitted on a sample that grows with the rows up to a bound, and its leaves
   with the sample; every row is put into a leaf.
2. A query walks the tree with a priority queue: the nearest unexplored centre first, whatever branch it is on. That gives the
   order in which it visits leaves.
3. Calibration: some queries are answered exactly over all rows, and the number of leaf visits is widened until the wanted share of
   true neighbours is in visited leaves. All queries then visit that many leaves.
4. Rows and queries of a leaf are dealt into blocks, and every pair of blocks is a group: a leaf with a third of all rows, or one
   that all queries visit, is many groups of fixed size. Scores are in double precision on the original vectors, and the best
   of each block are merged per query.

Defined results: vectors that are null, empty or zero, hold null or non-finite numbers, or differ in length from most others
take no part; rows that share a vec_id are separate candidates; a query with fewer candidates than k returns all of them; an
empty table gives no rows. Ties go to the smaller vec_id.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epispan.llm.common import Batches, record
from epispan.session import cut

NEIGHBOURS = 20
SAMPLE_ROWS = 20_000
#: One row in so many is sampled where that is more than ``SAMPLE_ROWS``, up to so many numbers in all (the driver holds them).
SAMPLED_ONE_IN, MOST_SAMPLE_NUMBERS = 20, 8_000_000
BRANCHES = 8
LEAF_ROWS = 128
MOST_LEAVES = 2_048
ROUNDS = 8
CALIBRATION_QUERIES = 200
CALIBRATED_RECALL = 0.97
BLOCK_ROWS = 4_096
QUERY_ROWS = 2_048
SEED = 5
SAMPLE_STEPS = 1_000_000

LEAF_DDL = "vec_id bigint, vector array<double>, leaf int"
LEAF = pa.schema([("vec_id", pa.int64()), ("vector", pa.list_(pa.float64())), ("leaf", pa.int32())])
VISIT_DDL = "query_id bigint, query array<double>, leaves array<int>"
VISIT = pa.schema([("query_id", pa.int64()), ("query", pa.list_(pa.float64())), ("leaves", pa.list_(pa.int32()))])
BEST_DDL = "query_id bigint, vec_id bigint, score double, leaf int"
BEST = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("leaf", pa.int32())])


@dataclass
class Node:
    """Centres of a node's children; a child is a node or the number of a leaf."""

    centres: np.ndarray
    children: list = field(default_factory=list)


@dataclass
class Tree:
    root: Node | int
    leaves: int
    longest: float


def lengthened(vectors: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))
    return np.c_[vectors, rest]


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances less the points' own squares, which change no order."""
    return (centres**2).sum(axis=1) - 2 * points @ centres.T


def k_means(points: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    centres = points[draw.choice(len(points), k, replace=False)]
    for _ in range(ROUNDS):
        nearest = distances(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        sizes = np.bincount(nearest, minlength=k)[:, None]
        centres = np.where(sizes > 0, sums / np.maximum(sizes, 1), centres)
    return np.unique(centres, axis=0)


def grow(points: np.ndarray, longest: float, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS) -> Tree:
    """A tree over sampled points (already lengthened). Points that no centre tells apart share a leaf."""
    draw = np.random.default_rng(SEED)
    leaf_rows = max(leaf_rows, len(points) // MOST_LEAVES)
    leaves = 0

    def node(own: np.ndarray) -> Node | int:
        nonlocal leaves
        if len(own) > leaf_rows:
            centres = k_means(own, branches, draw)
            nearest = distances(own, centres).argmin(axis=1)
            parts = [own[nearest == c] for c in range(len(centres))]
            if sum(len(p) > 0 for p in parts) > 1:
                held = [c for c, p in enumerate(parts) if len(p)]
                return Node(centres[held], [node(parts[c]) for c in held])
        leaves += 1
        return leaves - 1

    return Tree(node(points), leaves, longest)


def leaf_of(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The leaf of each point, nearest centre by nearest centre."""
    out = np.zeros(len(points), np.int32)
    waiting = [(tree.root, np.arange(len(points)))]
    while waiting:
        node, rows = waiting.pop()
        if isinstance(node, int):
            out[rows] = node
            continue
        nearest = distances(points[rows], node.centres).argmin(axis=1)
        waiting += [(child, rows[nearest == c]) for c, child in enumerate(node.children) if (nearest == c).any()]
    return out


def leaf_order(tree: Tree, point: np.ndarray, visits: int) -> list[int]:
    """Leaves in best-bin-first order: always go on from the nearest centre not yet explored."""
    queue, found, count = [(0.0, 0, tree.root)], [], 1
    while queue and len(found) < visits:
        _, _, node = heapq.heappop(queue)
        if isinstance(node, int):
            found.append(node)
            continue
        for near, child in zip(distances(point[None], node.centres)[0].tolist(), node.children, strict=True):
            heapq.heappush(queue, (near, count, child))
            count += 1
    return found


def matrix(column) -> np.ndarray:
    """Rows of equally long lists as a matrix, from an Arrow column or a pandas one."""
    if isinstance(column, pa.Array):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return np.array(column.tolist(), np.float64)


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, vector array<double>)`` of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(
        F.col("vec_id").isNotNull()
        & F.forall("vector", lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False)))
        & F.exists("vector", lambda x: x != 0)
    )
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("vector") == lengths[0].n) if lengths else rows


def in_leaves(rows: DataFrame, tree: Tree) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def work(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                points = lengthened(matrix(batch.column("vector")), shared.value.longest)
                yield record(LEAF, batch.column("vec_id"), batch.column("vector"), leaf_of(shared.value, points))

    return rows.mapInArrow(work, LEAF_DDL)


def visits_of(queries: DataFrame, tree: Tree, visits: int) -> DataFrame:
    """The leaves that each query visits."""
    shared = queries.sparkSession.sparkContext.broadcast(tree)

    def work(batches: Batches) -> Batches:
        for batch in batches:
            found = [leaf_order(shared.value, np.r_[v, 0.0], visits) for v in batch.column("vector").to_pylist()]
            yield record(VISIT, batch.column("vec_id"), batch.column("vector"), found)

    return queries.mapInArrow(work, VISIT_DDL)


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """The k best candidates of each query, its own row left out. A matrix product picks them, with room for its rounding."""
    rough = queries @ vectors.T
    out = []
    for row, (query_id, query) in enumerate(zip(query_ids.tolist(), queries, strict=True)):
        near = np.flatnonzero(ids != query_id)
        if len(near) > k:
            own = rough[row, near]
            # ties and rounding at the edge: keep all that may belong to the best k
            edge = np.partition(own, len(near) - k)[len(near) - k]
            near = near[own >= edge - 1e-9 * max(1.0, abs(edge))]
        scores = np.cumsum(vectors[near] * query, axis=1)[:, -1]  # summed in the order of the components
        order = np.lexsort((ids[near], -scores))[:k]
        out += [(query_id, int(ids[near[i]]), float(scores[i]), int(near[i])) for i in order]
    return out


def exact_best(rows: DataFrame, queries: list, k: int) -> DataFrame:
    """True neighbours of a few queries: the best of every task, then the best of those. ``rows`` carry their leaf."""
    ids = np.array([q.vec_id for q in queries], np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((ids, np.array([q.vector for q in queries], np.float64)))

    def work(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                own, leaves = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("leaf").to_pylist()
                found = best(*shared.value, own, matrix(batch.column("vector")), k)
                yield record(BEST, *([f[c] for f in found] for c in range(3)), [leaves[f[3]] for f in found])

    return ranked(rows.mapInArrow(work, BEST_DDL), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def calibrated_visits(rows: DataFrame, tree: Tree, sample: list, k: int, recall: float) -> int:
    """The fewest leaf visits with which the sampled queries find ``recall`` of their true neighbours."""
    truth = exact_best(rows, sample, k).select("query_id", "leaf").collect()
    leaves_of: dict[int, list[int]] = {}
    for row in truth:
        leaves_of.setdefault(row.query_id, []).append(row.leaf)
    needed = []
    for q in sample:
        place = {leaf: n for n, leaf in enumerate(leaf_order(tree, np.r_[q.vector, 0.0], tree.leaves), 1)}
        needed += [place[leaf] for leaf in leaves_of.get(q.vec_id, [])]
    return int(np.quantile(needed, recall, method="higher")) if needed else tree.leaves


def of_about(rows: DataFrame, total: int, wanted: int) -> DataFrame:
    """About ``wanted`` rows, chosen by hash of the id."""
    share = min(1.0, wanted / max(total, 1))
    return rows.where(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(SAMPLE_STEPS)) < share * SAMPLE_STEPS)


def sample_size(total: int, length: int, least: int = SAMPLE_ROWS) -> int:
    """Rows to fit the tree on: ``least``, or a share of the rows if that is more and the driver can hold it."""
    return max(least, min(total // SAMPLED_ONE_IN, MOST_SAMPLE_NUMBERS // max(length, 1)))


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = NEIGHBOURS,
    sample_rows: int = SAMPLE_ROWS,
    calibration_queries: int = CALIBRATION_QUERIES,
    recall: float = CALIBRATED_RECALL,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the nearest found for every usable row that ``is_query`` holds for."""
    rows = cut(usable(vectors), "vectors")
    spark = vectors.sparkSession
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    total, longest, length = rows.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("vector"))).first()
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    chosen = of_about(rows, total, sample_size(total, length, sample_rows)).select("vec_id", "vector").orderBy("vec_id").toArrow()
    sample = (chosen if chosen.num_rows else rows.limit(1).toArrow()).column("vector").combine_chunks()
    tree = grow(lengthened(matrix(sample), longest), longest)
    placed = cut(in_leaves(rows, tree), "leaves")
    queries = rows.where(is_query)
    n_queries = queries.count()
    asked = of_about(queries, n_queries, calibration_queries).select("vec_id", "vector").orderBy("vec_id").collect()
    visits = calibrated_visits(placed, tree, asked, k, recall) if asked else tree.leaves

    found = cut(answered(queries, placed, tree, visits, k), "found")
    enough = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k, total - 1))
    short = cut(queries.join(enough, "vec_id", "left_anti"), "short")
    if short.limit(1).count():  # too few candidates in the visited leaves: these queries visit all
        found = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti")
        found = found.union(answered(short, placed, tree, tree.leaves, k))
    return ranked(found, k).select("query_id", "rank", "vec_id", "score")


def dealt(queries: DataFrame, placed: DataFrame, tree: Tree, visits: int) -> tuple[DataFrame, DataFrame]:
    """Queries and rows of every (leaf, query block, row block); each side of a group has about a fixed number at most."""
    visited = cut(visits_of(queries, tree, visits), "visits")
    by_leaf = visited.select("query_id", "query", F.explode("leaves").alias("leaf"))
    blocks = lambda frame, rows, name: frame.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))
    sizes = blocks(placed, BLOCK_ROWS, "blocks").join(blocks(by_leaf.select("leaf"), QUERY_ROWS, "query_blocks"), "leaf")
    sizes = F.broadcast(cut(sizes, "sizes"))  # a row per leaf of the tree, whose sample is bounded
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    one = lambda key, count: F.pmod(F.xxhash64(key), count).cast("int")
    asking = by_leaf.join(sizes, "leaf").withColumn("query_block", one("query_id", "query_blocks")).withColumn("block", every("blocks"))
    rows = placed.join(sizes, "leaf").withColumn("block", one("vec_id", "blocks")).withColumn("query_block", every("query_blocks"))
    return asking.drop("blocks", "query_blocks"), rows.drop("blocks", "query_blocks")


def answered(queries: DataFrame, placed: DataFrame, tree: Tree, visits: int, k: int) -> DataFrame:
    """The best of every visited block of a leaf."""
    asking, rows = dealt(queries, placed, tree, visits)

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            ids, points = right["vec_id"].to_numpy(np.int64), matrix(right["vector"])
            for start in range(0, len(left), QUERY_ROWS):
                part = left.iloc[start : start + QUERY_ROWS]
                found += best(part["query_id"].to_numpy(np.int64), matrix(part["query"]), ids, points, k)
        frame = pd.DataFrame([f[:3] for f in found], columns=["query_id", "vec_id", "score"])
        return frame.astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    group = ["leaf", "query_block", "block"]
    pairs = asking.groupBy(*group).cogroup(rows.groupBy(*group))
    return pairs.applyInPandas(answer, "query_id bigint, vec_id bigint, score double")
