"""Groups of the vector search have a bounded number of queries and rows, and the blocks lose nothing."""

import collections

import numpy as np
from pyspark.sql import functions as F

from epispan.llm import ann
from epispan.llm.common import prepared


def hot_table(spark):
    """A third of the rows is one vector, so that its leaf is hot for rows and for queries."""
    draw = np.random.default_rng(2)
    points = draw.normal(size=(900, 6))
    points[::3] = points[0]
    return points, prepared(spark).createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "vec_id bigint, embedding array<double>")


def test_both_sides_of_a_group_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
    monkeypatch.setattr(ann, "QUERY_ROWS", 20)
    points, frame = hot_table(spark)
    longest = float(np.sqrt((points**2).sum(axis=1)).max())
    tree = ann.grow(ann.lengthened(points, longest), longest)
    rows = ann.usable(frame)
    asking, held = ann.dealt(rows, ann.in_leaves(rows, tree), tree, tree.leaves)
    group = ["leaf", "query_block", "block"]
    assert asking.groupBy(*group).count().agg(F.max("count")).first()[0] <= 50
    assert held.groupBy(*group).count().agg(F.max("count")).first()[0] <= 90
    # every query meets every row once
    met = asking.join(held, group).select("query_id", "vec_id")
    assert met.count() == met.distinct().count() == 900 * 900


def test_blocks_change_no_neighbour(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
    monkeypatch.setattr(ann, "QUERY_ROWS", 5)
    points, frame = hot_table(spark)
    got = collections.defaultdict(dict)
    for r in ann.search(frame, F.col("vec_id") % 5 == 0, k=7, recall=1.0, calibration_queries=900).collect():
        got[r.query_id][r["rank"]] = r.score
    assert sorted(got) == list(range(0, 900, 5))
    for i, found in got.items():
        scores = np.delete(points @ points[i], i)
        assert np.allclose([found[k] for k in range(1, 8)], np.sort(scores)[::-1][:7], atol=1e-9)


def test_sample_grows_with_the_rows_up_to_a_bound():
    assert ann.sample_size(1_000, 64) == ann.sample_size(400_000, 64) == ann.SAMPLE_ROWS
    assert ann.sample_size(1_000_000, 64) == 50_000
    assert ann.sample_size(10_000_000, 64) == ann.sample_size(10**9, 64) == 125_000
    assert ann.sample_size(10**9, 4_096) == ann.SAMPLE_ROWS
