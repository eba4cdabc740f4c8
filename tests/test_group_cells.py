"""Score cells belong to groups: their number follows a group's rows, not the rows of all groups."""

import itertools

import pytest
from pyspark.sql import functions as F

from epispan.operators import hazards as H
from epispan.operators import metrics as E

SCHEMA = "g int, score double, t int, event boolean"


def rows_of(n=60):
    return [(g if g < 3 else None, g * 10.0 + (7 * k % n) // 2, 13 * k % 11, k % 3 == 0) for g in range(4) for k in range(n)]


def by_pairs(rows):
    hits = pairs = 0
    for (_, s, t, e), (_, s2, t2, e2) in itertools.product(rows, rows):
        if e and (t2 > t or (t2 == t and not e2)):
            pairs += 1
            hits += 1.0 if s2 < s else 0.5 if s2 == s else 0.0
    return hits / pairs


@pytest.mark.parametrize("cell_rows", [7, 30, 1000])
def test_groups_have_cells_of_their_own(spark, cell_rows):
    rows = rows_of()
    frame = spark.createDataFrame(rows, SCHEMA)
    cells, most = E._celled(frame, ["g"], cell_rows)
    assert cells.count() == len(rows)
    held = [r["count"] for r in cells.groupBy("g", "cell").count().collect()]
    assert len(held) <= 4 * most and min(held) >= cell_rows / 4 or most == 1
    assert sum(held) / len(held) >= cell_rows / 2 or most == 1
    found = E.concordance(frame, ["g"], F.col("score"), "t", "event", cell_rows=cell_rows).collect()
    assert len(found) == 4
    for row in found:
        assert row["c_index"] == pytest.approx(by_pairs([r for r in rows if r[0] == row["g"]]), abs=1e-12)


def test_training_counts_are_read_without_the_curves(spark, monkeypatch):
    """Of the written frames, only the panel itself is worked out from curves."""
    plans = {}
    plain = H.cut

    def noted(frame, label, **more):
        plans[label] = frame._jdf.queryExecution().executedPlan().toString()
        return plain(frame, label, **more)

    monkeypatch.setattr(H, "cut", noted)
    curve = [0.9, 0.8, 0.7]
    people = [(k, k % 2, k % 4 < 2, 1 + k % 5, k % 3, *[[0.05, 0.1, 0.1]] * 4, curve, curve) for k in range(40)]
    schema = "id int, fold int, treated boolean, t int, e int, " + ", ".join(f"{c} array<double>" for c in H.curve_columns((1, 2)))
    panel = H.metric_panel(spark.createDataFrame(people, schema), "treated", "t", "e", (0.0, 2.0, 4.0))
    assert "MapInArrow" in plans["panel"] and "MapIn" not in plans["training-counts"]
    assert {r["metric"] for r in panel.collect()} == set(H.METRIC_FAMILIES)
