"""Lattice hashing against all pairs."""

import math

import duckdb
import numpy as np

from epispan.llm import lattice

DDL = "vec_id bigint, embedding array<float>, label int, key string, ball int, class string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "k", 1, "c") for i, v, label in rows], DDL).repartition(3)


def near(draw, centre, cosine):
    """A vector of random length at the given cosine from ``centre``."""
    centre = centre / np.linalg.norm(centre)
    off = draw.standard_normal(len(centre))
    off -= off @ centre * centre
    off /= np.linalg.norm(off)
    return (cosine * centre + math.sqrt(1 - cosine**2) * off) * draw.uniform(0.5, 3)


def plain(rows, least=lattice.COSINE):
    """Links and components by all pairs, per place in ``rows``."""
    vectors = [None if v is None or i is None or label is None or any(c is None for c in v) else np.float32(v).astype(float) for i, v, label in rows]
    fit = [k for k, v in enumerate(vectors) if v is not None and len(v) and np.isfinite(v).all() and v.any()]
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for x in fit:
        for y in fit:
            a, b = vectors[x], vectors[y]
            if x < y and rows[x][2] == rows[y][2] and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                links[x], links[y] = links[x] + 1, links[y] + 1
                root[top(x)] = top(y)
    least_id = {}
    for k in fit:
        least_id[top(k)] = min(least_id.get(top(k), rows[k][0]), rows[k][0])
    return sorted((rows[k][0] is None, rows[k][0] or 0, links[k], least_id[top(k)] if k in fit else rows[k][0]) for k in range(len(rows)))


def found(frame):
    return sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id) for r in lattice.near_duplicates(frame).collect())


def agree(got, want):
    """Same components and no link too many; of the links, few near the threshold may be missing."""
    assert [(*g[:2], g[3]) for g in got] == [(*w[:2], w[3]) for w in want]
    assert all(g[2] <= w[2] for g, w in zip(got, want, strict=True))
    assert sum(g[2] for g in got) >= 0.9995 * sum(w[2] for w in want)


def fixture():
    draw = np.random.default_rng(3)
    rows = []
    for label in range(3):
        rows += [(len(rows) + k, draw.standard_normal(64), label) for k in range(100)]
    hub = draw.standard_normal(64)
    rows += [(1000 + k, near(draw, hub, 0.995), 1) for k in range(150)]  # a tight group: balls that are linked throughout
    loose = draw.standard_normal(64)
    rows += [(2000 + k, near(draw, loose, draw.uniform(0.94, 0.99)), 2) for k in range(150)]  # radii leave doubts
    rows += [(3000 + k, hub * (1 + k % 2), 1) for k in range(60)]  # two groups of exact copies
    rows += [(4000 + k, near(draw, rows[k][1], 0.97), rows[k][2]) for k in range(0, 300, 3)]
    rows += [(5000 + k, rows[k][1], 5) for k in range(10)]  # the same vectors under another label
    rows = [(i, np.float32(v).tolist(), label) for i, v, label in rows]
    rows += [(6000, None, 1), (6001, [], 1), (6002, [0.0] * 64, 1), (6003, [math.nan] * 64, 1), (6004, [None] * 64, 1)]
    rows += [(6005, [math.inf] * 64, 1), (6006, rows[0][1], None), (None, rows[0][1], 0), (None, None, None), (6007, [1.0, 2.0], 1), (6008, [2.0, 4.0], 1)]
    rows += [(7, rows[7][1], 0), (7, rows[8][1], 0)]  # ids that repeat
    return rows


def test_links_and_components_equal_all_pairs(spark):
    rows = fixture()
    agree(found(frame(spark, rows)), plain(rows))


def test_sql_equals_all_pairs(spark):
    rows = fixture()
    duck = duckdb.connect()
    duck.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    duck.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    got = duck.execute(lattice.ORACLE).fetchall()
    assert sorted((i is None, i or 0, n, c) for i, n, c, _ in got) == plain(rows)


def test_pairs_at_the_threshold_are_found(spark):
    draw = np.random.default_rng(5)
    rows = []
    for k in range(1000):
        centre = draw.standard_normal(64)
        rows += [(2 * k, centre.tolist(), 0), (2 * k + 1, near(draw, centre, 0.9301).tolist(), 0)]
    got = lattice.near_duplicates(frame(spark, rows)).where("n_links > 0").count()
    assert 0.998 * 2000 <= got <= 2000


def test_empty_table(spark):
    assert lattice.near_duplicates(frame(spark, [])).collect() == []


def test_nearest_points_are_nearest():
    draw = np.random.default_rng(6)
    x = draw.standard_normal((500, 8)) * 3
    points = lattice.nearest_points(x)
    off = x - points / 2
    assert ((off**2).sum(axis=1) <= 1 + 1e-12).all()  # the covering radius
    farther = 2 - off @ lattice.steps().T
    assert (farther >= -1e-12).all()  # no neighbour is nearer
    assert len(np.unique(lattice.steps(), axis=0)) == 240 and (points.sum(axis=1) % 4 == 0).all()


def test_pair_rows_give_all_pairs_of_small_and_large_groups():
    draw = np.random.default_rng(7)
    group = np.repeat(np.arange(5), [1, 3, lattice.SMALL_GROUP, lattice.SMALL_GROUP + 1, 70])
    unit = draw.standard_normal((len(group), 4))
    i, j, cos = lattice.pair_rows(group, unit)
    want = {(a, b) for a in range(len(group)) for b in range(a + 1, len(group)) if group[a] == group[b]}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)
    assert np.allclose(cos, (unit[i] * unit[j]).sum(axis=1))


def test_groups_that_span_batches_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK_CENTRES", 16)
    monkeypatch.setattr(lattice, "BLOCK_MEMBERS", 16)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        rows = fixture()
        agree(found(frame(spark, rows)), plain(rows))
    finally:
        spark.conf.set(size, before)
