"""Whitening against the same in numpy and Python integers."""

from __future__ import annotations

import numpy as np
import pytest

from ledgertally.llm.whitening import Whitening, whitened

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, `index` int, deviation string"


def brute(rows, components=16):
    """(vec_id, deviation, whitened up to signs) of each usable row, n, explained."""
    x = [(i, tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v)) for i, v in rows]
    fit = sorted({v for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    out = {}
    for i, v in x:
        apart = [n * c - s for c, s in zip(v, sums)]
        out.setdefault(i, []).append((sum(d * d for d in apart), np.abs(np.array(apart) / n @ directions[:, :components] / np.sqrt(values[:components]))))
    return out, n, values / values.sum()


@pytest.mark.parametrize("block_values, blocks", [(1 << 19, 16), (600, 3)])
def test_equals_numpy(spark, block_values, blocks):
    rng = np.random.default_rng(5)
    base = (rng.standard_normal((300, 20)) * np.linspace(0.2, 3, 20)).astype(np.float32)
    good = [(k, v.tolist()) for k, v in enumerate(base)] + [(7, base[7].tolist())] + [(1000 + k, base[3].tolist()) for k in range(60)] + [(None, base[0].tolist())]
    odd = [(500, None), (501, []), (502, [1.0, None] * 10), (503, [float("nan")] * 20), (504, [float("inf")] + [0.0] * 19), (505, [1.0] * 7), (506, [3e38] * 20)]
    frame = spark.createDataFrame([(i, v, 1, "clash", 2, "clash") for i, v in good + odd], SCHEMA).repartition(5)
    got = whitened(frame, Whitening(block_values=block_values, blocks=blocks)).collect()
    expected, n, explained = brute(good)
    assert len(got) == 16 * len(good) and {r.n for r in got} == {n} == {300}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    for r in got:
        assert r.deviation == expected[r.vec_id][0][0]
        assert abs(r.whitened) == pytest.approx(expected[r.vec_id][0][1][r.component - 1], rel=1e-8, abs=1e-9)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
    one = {}
    for r in got:  # the covariance of what comes out, over the distinct vectors
        one.setdefault(expected[r.vec_id][0][0], {})[r.component] = r.whitened
    w = np.array([[v[k] for k in range(1, 17)] for v in one.values()])
    assert np.abs(w.T @ w / n - np.eye(16)).max() < 1e-6


def test_tables_without_components(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitened(spark.createDataFrame([(i, v, 1, "", 1, "") for i, v in rows], SCHEMA)).collect() == []


def test_flat_directions_make_no_component(spark):
    rows = [(k, [float(k), float(2 * k), 1.0], 1, "", 1, "") for k in range(10)]
    got = whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in got} == {1} and len(got) == 10 and got[0].explained == pytest.approx(1)
