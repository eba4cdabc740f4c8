"""Matching against a brute-force greedy pass, and its invariants."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from epispan.operators import matching as X


def rank_key(i):
    """Persons of one score rank by eight bits of a hash, then by id."""
    return int(hashlib.md5(f"0:tie:{i}".encode()).hexdigest()[:2], 16), i


def brute_force(rows, caliper):
    """Greedy pass over all pairs in the strict order (distance, lower score, treated rank, control rank)."""
    pairs = sorted(
        (abs(s - u), min(s, u), rank_key(i), rank_key(j))
        for i, t, s in rows
        for j, v, u in rows
        if t and not v and abs(s - u) <= caliper
    )
    used, out = set(), set()
    for _, _, (_, i), (_, j) in pairs:
        if i not in used and j not in used:
            used |= {i, j}
            out.add((i, j))
    return out


def grouped(rows):
    """Distinct scores with the surplus of one arm, as the cell task sees them."""
    scores = sorted({s for _, _, s in rows})
    out = []
    for s in scores:
        n_t = sum(1 for _, t, u in rows if u == s and t)
        n_c = sum(1 for _, t, u in rows if u == s and not t)
        if n_t != n_c:
            out.append((s, n_t > n_c, abs(n_t - n_c)))
    return out


def random_rows(rng, n, levels=None, share=0.3):
    scores = rng.normal(size=n)
    if levels:
        scores = np.round(scores * levels) / levels
    return [(int(i), bool(rng.random() < share), float(s)) for i, s in enumerate(scores)]


NOTHING = dict.fromkeys(("left_treated", "left_control", "right_treated", "right_control"), math.nan)


@pytest.mark.parametrize("seed", range(60))
def test_cell_greedy_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    rows = random_rows(rng, int(rng.integers(2, 60)), share=float(rng.uniform(0.1, 0.9)))
    caliper = float(rng.choice([0.05, 0.3, 10.0]))
    nodes = grouped(rows)
    score, treated, count = (np.array(c) for c in zip(*nodes))
    blocks, free = X.greedy_cell(score, treated.astype(bool), count, NOTHING, caliper)
    ids = {s: i for i, _, s in rows}
    got = {
        (ids[score[i]], ids[score[j]]) if treated[i] else (ids[score[j]], ids[score[i]])
        for i, j, _ in blocks
    }
    assert got == brute_force(rows, caliper)
    hopeful = X.still_hopeful(score, treated.astype(bool), free, NOTHING, caliper)
    assert not hopeful.any()


def as_frame(spark, rows):
    return spark.createDataFrame(rows, "id long, treated boolean, score double")


@pytest.mark.parametrize(
    ("seed", "levels", "cell_values", "caliper"),
    [(1, None, 10**6, 0.1), (2, 4, 10**6, 0.6), (3, None, 7, 0.2), (4, 3, 2, 0.7), (5, None, 3, 5.0), (6, 20, 4, 0.2)],
)
def test_match_equals_brute_force(spark, seed, levels, cell_values, caliper):
    rng = np.random.default_rng(seed)
    rows = random_rows(rng, 80, levels)
    pairs = X.nearest_neighbor_match(
        as_frame(spark, rows), "id", "treated", "score", caliper, cell_values=cell_values
    ).collect()
    assert {(p["treated_id"], p["control_id"]) for p in pairs} == brute_force(rows, caliper)
    ids = [p[k] for p in pairs for k in ("treated_id", "control_id")]
    assert len(ids) == len(set(ids))
    assert all(p["distance"] <= caliper for p in pairs)


def test_nested_runs_across_cells(spark):
    """A run of treated next to a run of controls pairs up from the inside out."""
    rows = [(i, i < 20, i / 100) for i in range(40)]
    pairs = X.nearest_neighbor_match(
        as_frame(spark, rows), "id", "treated", "score", 1.0, cell_values=6
    ).collect()
    assert {(p["treated_id"], p["control_id"]) for p in pairs} == {(i, 39 - i) for i in range(20)}


def test_heavy_score_is_ranked_in_tie_cells(spark, monkeypatch):
    monkeypatch.setattr(X, "HEAVY_SCORE", 10)
    monkeypatch.setattr(X, "PAIR_CHUNK", 7)
    rows = [(i, i % 3 == 0, 0.5) for i in range(300)] + [(1000 + i, True, 1.0) for i in range(5)]
    ranked = X.ranked_by_score(as_frame(spark, rows), "id", "treated", "score").collect()
    for arm in (True, False):
        ranks = sorted(r["rank"] for r in ranked if r["score"] == 0.5 and r["treated"] is arm)
        assert ranks == list(range(len(ranks)))
    pairs = X.nearest_neighbor_match(as_frame(spark, rows), "id", "treated", "score", 0.6)
    assert pairs.where(F.col("distance") == 0).count() == 100
    assert pairs.where(F.col("distance") > 0).count() == 5


@pytest.mark.parametrize("heavy", [1, 10, 100_000])
def test_pairs_do_not_depend_on_the_heavy_score_limit(spark, monkeypatch, heavy):
    monkeypatch.setattr(X, "HEAVY_SCORE", heavy)
    rows = random_rows(np.random.default_rng(9), 60, levels=1)
    pairs = X.nearest_neighbor_match(as_frame(spark, rows), "id", "treated", "score", 1.5).collect()
    assert {(p["treated_id"], p["control_id"]) for p in pairs} == brute_force(rows, 1.5)


def test_rolling_rate_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), float(s), bool(rng.random() < s)) for i, s in enumerate(rng.random(95))]
    frame = spark.createDataFrame(rows, "id long, score double, y boolean")
    got = {
        r["id"]: (r["position"], r["rate"])
        for r in X.rolling_rate(frame, "score", "y", "id", window=5, n_cells=4, block=10).collect()
    }
    order = sorted(rows, key=lambda r: r[1])
    for place, (i, _, _) in enumerate(order):
        position, rate = got[i]
        assert position == place
        if place < 4:
            assert rate is None
        else:
            assert rate == pytest.approx(np.mean([y for _, _, y in order[place - 4 : place + 1]]))


def test_chain_of_closer_partners_across_cells_keeps_cells_small(spark, monkeypatch):
    """Every pair waits for the next one, so the chain is decided from its end, cell by cell."""
    gaps = [1 - k / 100 for k in range(47)]
    rows = [(i, i % 2 == 0, float(sum(gaps[:i]))) for i in range(48)]
    rounds = []
    one_round = X._round
    monkeypatch.setattr(X, "_round", lambda nodes, n_cells, *a: rounds.append((nodes.count(), n_cells)) or one_round(nodes, n_cells, *a))
    pairs = X.nearest_neighbor_match(as_frame(spark, rows), "id", "treated", "score", 2.0, cell_values=8).collect()
    assert {(p["treated_id"], p["control_id"]) for p in pairs} == brute_force(rows, 2.0)
    assert len(rounds) > 3 and all(n_cells >= size / 8 for size, n_cells in rounds)
