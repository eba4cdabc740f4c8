"""Whitening against eigenvectors of the covariance by plain linear algebra."""

import math

import numpy as np
import pytest

from epispan.llm import whitening
from epispan.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
DDL = "vec_id bigint, embedding array<float>, label int, id string, data int, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 3, "n") for i, v in rows], DDL).repartition(3)


def plain(rows):
    """Per id (of usable rows): deviations and whitened values up to sign, by whole numbers and an eigenvalue routine."""
    usable = [(i, [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, dims = len(usable), len(usable[0][1])
    sums = [sum(x[j] for _, x in usable) for j in range(dims)]
    exact = [[n * x[j] - sums[j] for j in range(dims)] for _, x in usable]
    centred = np.array(exact, float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    return [i for i, _ in usable], [sum(e * e for e in row) for row in exact], centred @ vectors / np.sqrt(np.maximum(values, 1e-300)), values


def compare(got, rows, components):
    ids, deviation, white, values = plain(rows)
    k = min(components, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == len(ids) * k
    table = {}
    for r in got:
        table.setdefault(r.vec_id, {})[r.component] = r
    signs = [np.sign(table[ids[np.abs(white[:, c]).argmax()]][c + 1].whitened * white[np.abs(white[:, c]).argmax(), c]) for c in range(k)]
    for place, i in enumerate(ids):
        for c in range(k):
            r = table[i][c + 1]
            assert (r.n, r.deviation) == (len(ids), deviation[place])
            assert r.whitened == pytest.approx(signs[c] * white[place, c], abs=1e-7)
            assert r.explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
            assert r.identity_error < 1e-9


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    compare(QUERIES["op11_whitening"](spark, SF_DIR).collect(), rows, 32)


def test_unusable_rows_and_few_dimensions(spark):
    draw = np.random.default_rng(1)
    rows = [(k, (draw.standard_normal(5) * [9, 5, 3, 1, 0.5]).tolist()) for k in range(60)]
    rows += [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [math.nan] * 5), (104, [1.0, math.inf, 0.0, 0.0, 0.0])]
    compare(whitening.whiten(frame(spark, rows)).collect(), rows, 32)


def test_leading_components_of_many_dimensions_stop_early(spark, monkeypatch):
    draw = np.random.default_rng(2)
    scales = np.r_[40, 20, 10, 5, np.full(56, 0.05)]
    rows = [(k, (draw.standard_normal(60) * scales).tolist()) for k in range(300)]
    passes = []
    products = whitening.products
    monkeypatch.setattr(whitening, "products", lambda *a: passes.append(1) or products(*a))
    compare(whitening.whiten(frame(spark, rows), components=4).collect(), rows, 4)
    assert len(passes) <= 60


def test_repeated_deviations_are_all_found(spark):
    corners = [[float(a), float(b), float(c), 0.0] for a in (-1, 1) for b in (-1, 1) for c in (-2, 2)]
    got = whitening.whiten(frame(spark, list(enumerate(corners)))).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append((r.component, r.whitened, r.explained, r.identity_error))
    assert all([c for c, *_ in sorted(v)] == [1, 2, 3] for v in by_id.values())  # the dimension without deviation gives none
    white = np.array([[w for _, w, _, _ in sorted(by_id[i])] for i in range(8)])
    assert np.allclose(white.T @ white / 8, np.eye(3), atol=1e-9)
    assert np.allclose([e for _, _, e, _ in sorted(by_id[0])], [4 / 6, 1 / 6, 1 / 6])


def test_no_deviation_no_rows_and_null_ids(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])] * 3)).collect() == []
    got = whitening.whiten(frame(spark, [(None, [0.0]), (1, [2.0]), (1, [4.0])])).collect()
    assert sorted((r.vec_id is None, r.deviation) for r in got) == [(False, 0), (False, (3 * 128) ** 2), (True, (3 * 128) ** 2)]


def test_different_lengths_raise(spark):
    with pytest.raises(ValueError):
        whitening.whiten(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
