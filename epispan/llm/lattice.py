"""Near-duplicate embeddings by lattice hashing: random projections decoded to E8 points, verified by cosine.

1. Usable vectors with equal label and equal entries are one class, so exact copies never meet each other again.
2. In each of ``tables`` tables a unit vector is projected to ``8 * lattices`` numbers; every eight are decoded to the nearest point of
   the E8 lattice, and the points of a table, with the label, are its cell. A class also probes the cells that differ by the
   ``probes`` lattice steps nearest to its projection. Two classes meet where one's own cell is an own or probed cell of the
   other: at a cosine of 0.93 in one table in two, so that 16 tables miss about one such pair in 20,000, and closer ones less.
3. Classes of one cell that lie within half the angle of the threshold around the cell's smallest class form a ball: all of
   them are linked with each other, which is counted and not listed. Cells hold balls from here on.
4. The centres of the balls in a cell are compared by cosine, in blocks of fixed size. Two balls are linked throughout, or not at
   all, where their radii leave no doubt; else their members are compared, block by block in numpy, and only counts per
   member leave a block. No cell is capped and no pair that is not linked is written.
5. Links of balls join into components by large-star and small-star.

Rows written per class are ``tables * (probes + 1)`` keys without vectors; a vector travels only to cells that hold several balls.
Groups of different, near vectors cost what their balls cost: pairs of balls, not of vectors, unless radii leave a doubt.

Defined results: a vector that is null, empty, zero or holds null or non-finite entries links with nothing, nor does one without
label or without id; it is a component of its own (null without id, and not kept). Vectors of different lengths do not link.
Rows that repeat an id are vectors of their own. An empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispan.llm.common import Batches, mix64, record
from epispan.llm.components import components
from epispan.session import cut

COSINE = 0.93
TABLES = 16
LATTICES = 2
PROBES = 4
#: Lattice step of the projections, in which a unit vector has a standard deviation of one.
STEP = 2.0
SEED = 8
#: Angles that differ by less are left to the exact comparison of members.
DOUBT = 1e-6
BLOCK_CENTRES = 512
BLOCK_MEMBERS = 512
#: Groups up to this size are compared side by side, larger ones by a matrix product each.
SMALL_GROUP = 48
#: Vectors projected at once.
CHUNK = 1024

KEY_DDL = "place int, label bigint, key bigint, class bigint, home boolean"
KEYS = pa.schema([("place", pa.int32()), ("label", pa.int64()), ("key", pa.int64()), ("class", pa.int64()), ("home", pa.bool_())])
PAIR_DDL = "a bigint, b bigint, whole boolean"
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("whole", pa.bool_())])
COUNT_DDL = "class bigint, more bigint, a bigint, b bigint"


def steps() -> np.ndarray:
    """The 240 shortest vectors of E8, times two: whole numbers."""
    pairs = [
        [2 * (a if k == i else b if k == j else 0) for k in range(8)]
        for i, j in itertools.combinations(range(8), 2)
        for a, b in itertools.product((1, -1), repeat=2)
    ]
    halves = [s for s in itertools.product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(pairs + halves, np.int64)


def even_points(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of an even sum."""
    near = np.rint(x)
    off = x - near
    rows = np.arange(len(x))
    worst = np.abs(off).argmax(axis=1)
    near[rows, worst] += np.where(near.sum(axis=1) % 2 != 0, np.where(off[rows, worst] >= 0, 1, -1), 0)
    return near


def nearest_points(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of rows of eight numbers, times two: the better of the even points and the shifted even points."""
    plain, shifted = even_points(x), even_points(x - 0.5) + 0.5
    nearer = ((x - plain) ** 2).sum(axis=1) <= ((x - shifted) ** 2).sum(axis=1)
    return (2 * np.where(nearer[:, None], plain, shifted)).astype(np.int64)


class Lattice:
    """Projections of all tables for vectors of one length, the same in every task."""

    def __init__(self, dims: int, tables: int, lattices: int, probes: int):
        draw = np.random.default_rng([SEED, dims])
        self.tables, self.lattices, self.probes = tables, lattices, probes
        self.project = draw.standard_normal((tables * lattices * 8, dims)) / STEP
        self.shift = draw.random(tables * lattices * 8) * 2
        self.steps = steps()
        # the hash of a point is linear in it, so a step changes it by a number known beforehand
        self.weights = draw.integers(0, 2**63, (tables, lattices, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        with np.errstate(over="ignore"):
            self.moves = (self.weights[:, :, None, :] * self.steps.astype(np.uint64)).sum(axis=3)

    def keys(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(rows, tables)`` own keys and ``(rows, tables, probes)`` probed keys."""
        rows = len(unit)
        x = (unit @ self.project.T + self.shift).reshape(-1, 8)
        point = nearest_points(x)
        off = x - point / 2
        # squared distance to the neighbour cells minus that to the own one
        farther = (2 - off @ self.steps.T.astype(np.float64)).reshape(rows, self.tables, -1)
        best = np.argpartition(farther, self.probes - 1, axis=2)[:, :, : self.probes]
        with np.errstate(over="ignore"):
            shaped = point.astype(np.uint64).reshape(rows, self.tables, self.lattices, 8)
            own = (shaped * self.weights).sum(axis=(2, 3))
            moves = np.broadcast_to(self.moves.reshape(self.tables, -1), (rows, *farther.shape[1:]))
            probed = own[:, :, None] + np.take_along_axis(moves, best, axis=2)
            salt = mix64(np.arange(1, self.tables + 1) + self.project.shape[1] * 2**20)
            return mix64(own + salt).view(np.int64), mix64(probed + salt[:, None]).view(np.int64)


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as doubles of length one."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def usable(embedding: Column) -> Column:
    """Whether a vector has a direction."""
    finite = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(embedding, lambda c: c != 0), F.lit(False))


def classes_of(rows: DataFrame) -> DataFrame:
    """``(class, label, embedding, copies, least)``: equal vectors of a label, numbered."""
    sizes = rows.groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    return cut(sizes.select(F.monotonically_increasing_id().alias("class"), "*"), "vector-classes")


def cell_keys(classes: DataFrame, tables: int, lattices: int, probes: int) -> DataFrame:
    """``(place, label, key, class, home)``: own and probed cells in every table; a key stands for table, length and cell."""

    def work(batches: Batches) -> Batches:
        known: dict[int, Lattice] = {}
        for batch in batches:
            lengths = batch.column("embedding").value_lengths().to_numpy()
            for dims in np.unique(lengths):
                lattice = known.setdefault(int(dims), Lattice(int(dims), tables, lattices, probes))
                same = np.flatnonzero(lengths == dims)
                for k in range(0, len(same), CHUNK):
                    part = batch.take(pa.array(same[k : k + CHUNK]))
                    label, ids = part.column("label").to_numpy(), part.column("class").to_numpy()
                    own, probed = lattice.keys(unit_rows(part.column("embedding")))
                    places = np.arange(tables, dtype=np.int32)
                    for home, keys in ((True, own[:, :, None]), (False, probed)):
                        each = tables * keys.shape[2]
                        yield record(
                            KEYS,
                            np.tile(np.repeat(places, keys.shape[2]), len(part)),
                            np.repeat(label, each),
                            keys.ravel(),
                            np.repeat(ids, each),
                            np.full(keys.size, home),
                        )

    return classes.select("class", F.col("label").cast("bigint"), "embedding").mapInArrow(work, KEY_DDL)


def cosine(a: str, b: str):
    """Cosine of two vector columns in double precision, as a column."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x))
        for k, (p, q) in enumerate(zip(x, y, strict=True)):
            p, q = np.asarray(p, np.float64), np.asarray(q, np.float64)
            out[k] = p @ q / np.sqrt((p @ p) * (q @ q)) if len(p) == len(q) else -1.0
        return pd.Series(out)

    return of(F.col(a), F.col(b))


def angle(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1.0, 1.0))


def balls_of(classes: DataFrame, homes: DataFrame, least_cosine: float) -> DataFrame:
    """``(class, ball, apart)`` of classes in balls of several: the smallest class of a cell, and the angle from it.

    Members lie so close to the centre that any two of them are linked.
    """
    cells = homes.groupBy("label", "key").agg(F.min("class").alias("ball"), F.max("class").alias("last")).where("ball < last")
    inside = homes.join(cells.drop("last"), ["label", "key"]).where("class <> ball").select("class", "ball")
    members = inside.join(classes.select("class", F.col("embedding").alias("v")), "class")
    centres = classes.select(F.col("class").alias("ball"), F.col("embedding").alias("centre"))
    apart = members.join(centres, "ball").select("class", "ball", F.acos(F.least(cosine("v", "centre"), F.lit(1.0))).alias("apart"))
    near = cut(apart.where(F.col("apart") <= float(np.arccos(least_cosine)) / 2 - DOUBT), "ball-members")
    return near.union(near.select(F.col("ball").alias("class"), "ball", F.lit(0.0).alias("apart")).distinct())


def in_blocks(frame: DataFrame, size: Column, own: Column, most: int) -> DataFrame:
    """Rows of a group dealt to all pairs of its blocks, ``low`` and ``high``; a block has about ``most`` rows."""
    n_blocks = F.ceil(size / most).cast("int")
    return (
        frame.withColumn("own", F.pmod(F.xxhash64(own, F.lit(SEED)), n_blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
        .drop("other")
    )


def stacked(column: pd.Series) -> np.ndarray:
    """Unit rows of vectors of one length."""
    x = np.stack([np.asarray(v, np.float64) for v in column])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def pair_rows(group: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of rows of one group, with their cosine; rows of a group are neighbours."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    left = np.repeat(starts + sizes, sizes) - np.arange(len(group)) - 1  # rows of the group after this one
    small = np.repeat(sizes <= SMALL_GROUP, sizes)
    found = []
    for d in range(1, SMALL_GROUP):
        i = np.flatnonzero(small & (left >= d))
        if not len(i):
            break
        found.append((i, i + d, np.einsum("ij,ij->i", unit[i], unit[i + d])))
    for start, size in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP], strict=True):
        own = unit[start : start + size]
        i, j = np.triu_indices(size, 1)
        found.append((start + i, start + j, (own @ own.T)[i, j]))
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3


def near_pairs(rows: pa.RecordBatch, least_cosine: float) -> pa.RecordBatch:
    """Near balls of whole groups: pairs with linked members, ``whole`` if all of them surely are."""
    most = float(np.arccos(least_cosine))
    column = {name: rows.column(name).to_numpy(zero_copy_only=False) for name in ("group", "ball", "home", "own", "low", "high", "radius")}
    lengths = rows.column("centre").value_lengths().to_numpy()
    out = []
    for dims in np.unique(lengths):
        at = np.flatnonzero(lengths == dims)
        i, j, cos = pair_rows(column["group"][at], unit_rows(rows.column("centre").take(pa.array(at))))
        i, j = at[i], at[j]
        radii = column["radius"][i] + column["radius"][j]
        apart = angle(cos)
        whole = np.where(radii == 0, cos >= least_cosine, apart + radii <= most - DOUBT)
        near = whole | ((radii > 0) & (apart - radii <= most + DOUBT))
        near &= (column["home"][i] | column["home"][j]) & (column["ball"][i] != column["ball"][j])
        near &= (column["own"][i] != column["own"][j]) | (column["low"][i] == column["high"][i])
        a, b = column["ball"][i[near]], column["ball"][j[near]]
        out.append(record(PAIRS, np.minimum(a, b), np.maximum(a, b), whole[near]))
    return pa.Table.from_batches(out, PAIRS).combine_chunks().to_batches()[0] if sum(map(len, out)) else record(PAIRS, [], [], [])


def near_balls(crowded: DataFrame, least_cosine: float) -> DataFrame:
    """``(a, b, whole)``: pairs of balls that meet in a cell and have linked members, all of them if ``whole``, else perhaps.

    ``crowded`` has ``label, key, ball, home, size, centre, radius``.
    """

    def work(batches: Batches) -> Batches:
        held = None  # rows of the last group, which the next batch may continue
        for batch in batches:
            rows = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0]
            marks = [rows.column(name).to_numpy() for name in ("label", "key", "low", "high")]
            change = np.r_[True, np.any([m[1:] != m[:-1] for m in marks], axis=0)]
            last = int(np.flatnonzero(change)[-1])
            held = rows.slice(last)
            if last:
                yield near_pairs(rows.slice(0, last).append_column("group", pa.array(np.cumsum(change)[:last])), least_cosine)
        if held is not None:
            yield near_pairs(held.append_column("group", pa.array(np.zeros(len(held), np.int64))), least_cosine)

    dealt = in_blocks(crowded, F.col("size"), F.col("ball"), BLOCK_CENTRES).drop("size")
    groups = ["label", "key", "low", "high"]
    pairs = dealt.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(work, PAIR_DDL)
    return pairs.groupBy("a", "b").agg(F.max("whole").alias("whole"))


def member_links(pairs: DataFrame, members: DataFrame, least_cosine: float) -> DataFrame:
    """Linked copies per member over all pairs of balls in doubt: ``(class, more, a, b)``.

    ``members`` has ``ball, class, embedding, copies``. Members of a ball come in blocks, and each pair of blocks is one row of work.
    """
    n_blocks = F.ceil(F.col("size") / BLOCK_MEMBERS).cast("int")
    sizes = members.groupBy("ball").agg(F.count(F.lit(1)).alias("size"))
    wanted = pairs.select(F.col("a").alias("ball")).union(pairs.select(F.col("b").alias("ball"))).distinct()
    blocks = (
        members.join(wanted, "ball", "left_semi")
        .join(sizes, "ball")
        .withColumn("block", F.pmod(F.xxhash64("class", F.lit(SEED)), n_blocks))
        .groupBy("ball", "block")
        .agg(F.collect_list(F.struct("class", "copies", "embedding")).alias("own"))
    )
    blocks = cut(blocks, "ball-blocks")

    def compare(frames):
        for frame in frames:
            for a, b, left, right in zip(frame["a"], frame["b"], frame["of_a"], frame["of_b"], strict=True):
                hit = stacked([m["embedding"] for m in left]) @ stacked([m["embedding"] for m in right]).T >= least_cosine
                x, y = (np.array([m["copies"] for m in side], np.int64) for side in (left, right))
                more = np.r_[hit @ y, x @ hit]
                ids = np.array([m["class"] for m in itertools.chain(left, right)], np.int64)
                yield pd.DataFrame({"class": ids, "more": more, "a": a, "b": b})[more > 0]

    work = pairs.join(blocks.select(F.col("ball").alias("a"), F.col("own").alias("of_a")), "a")
    work = work.join(blocks.select(F.col("ball").alias("b"), F.col("own").alias("of_b")), "b")
    return work.select("a", "b", "of_a", "of_b").mapInPandas(compare, COUNT_DDL)


def near_duplicates(
    vectors: DataFrame, least_cosine: float = COSINE, tables: int = TABLES, lattices: int = LATTICES, probes: int = PROBES
) -> DataFrame:
    """``(vec_id, n_links, component_id)``, a row per row of ``vectors (vec_id, embedding, label)``."""
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), "embedding")
    fit = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    classes = classes_of(rows.where(fit))
    keys = cut(cell_keys(classes, tables, lattices, probes), "cell-keys", by=("place",))
    members = cut(
        classes.join(balls_of(classes, keys.where("place = 0 and home"), least_cosine), "class", "left")
        .withColumn("ball", F.coalesce("ball", "class"))
        .withColumn("apart", F.coalesce("apart", F.lit(0.0))),
        "members",
    )
    totals = members.groupBy("ball").agg(
        F.sum("copies").alias("total"), F.max("apart").alias("radius"), F.min("least").alias("least")
    )
    balls = cut(totals.join(members.where("class = ball").select("ball", F.col("embedding").alias("centre")), "ball"), "balls")

    held = keys.join(members.where("class <> ball").select("class", "ball"), "class", "left")
    held = held.select("label", "key", F.coalesce("ball", "class").alias("ball"), "home")
    held = cut(held.groupBy("label", "key", "ball").agg(F.max("home").alias("home")), "cells")
    cells = held.groupBy("label", "key").agg(F.count(F.lit(1)).alias("size"), F.max("home").alias("any"))
    crowded = held.join(cells.where("size > 1 and any").drop("any"), ["label", "key"])
    pairs = cut(near_balls(crowded.join(balls.select("ball", "centre", "radius"), "ball"), least_cosine), "near-balls")

    doubted = cut(member_links(pairs.where("not whole"), members, least_cosine), "member-links")
    whole = pairs.where("whole").select("a", "b")
    found = components(whole.union(doubted.select("a", "b")))
    both = whole.union(whole.select("b", "a"))
    of_balls = both.join(balls.select(F.col("ball").alias("b"), "total"), "b").groupBy(F.col("a").alias("ball")).agg(F.sum("total").alias("across"))
    of_members = doubted.groupBy("class").agg(F.sum("more").alias("more"))
    named = balls.join(found.withColumnRenamed("id", "ball"), "ball", "left").withColumn("component", F.coalesce("component", "ball"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_ball = named.join(least, "component").join(of_balls, "ball", "left")
    result = (
        members.join(of_ball.select("ball", "total", "across", "component_id"), "ball")
        .join(of_members, "class", "left")
        .withColumn("links", F.col("total") - 1 + F.coalesce("across", F.lit(0)) + F.coalesce("more", F.lit(0)))
        .where("links > 0")  # the others need no join: they are their own component
        .select("label", "embedding", "links", "component_id")
    )
    known = F.when(F.col("vec_id").isNotNull(), F.col("links"))
    return rows.join(result, ["label", "embedding"], "left").select(
        "vec_id",
        F.coalesce(known, F.lit(0)).cast("bigint").alias("n_links"),
        F.when(known > 0, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    )


#: All pairs of equal label; fine for the small tables that SQL is run on.
ORACLE = f"""
WITH RECURSIVE usable AS (
  SELECT row_number() OVER () AS place, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (
  SELECT x.place AS a, x.vec_id AS a_id, y.place AS b, y.vec_id AS b_id FROM usable x JOIN usable y
  ON x.label = y.label AND x.place <> y.place AND len(x.v) = len(y.v)
  WHERE list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v) * list_dot_product(y.v, y.v)) >= {COSINE}),
reach AS (
  SELECT place AS a, place AS b FROM usable
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT reach.a, min(vec_id) AS component_id FROM reach JOIN usable ON reach.b = usable.place GROUP BY reach.a),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a),
found AS (
  SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id
  FROM usable JOIN least ON least.a = place LEFT JOIN counts ON counts.a = place
  UNION ALL
  SELECT vec_id, 0, vec_id FROM embeddings
  WHERE NOT coalesce(vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0, false))
SELECT vec_id, n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM found
"""
