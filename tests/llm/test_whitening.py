import math

import numpy as np
import pytest

from hazardgrid.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def found(spark, rows, schema=SCHEMA, **more):
    return whitening.whiten(spark.createDataFrame(rows, schema), **more).collect()


def brute(rows, components=4):
    """``{(id, component): (n, deviation, |whitened|, explained)}`` by a full eigendecomposition of exact integers."""
    kept = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows]
    fit = np.array(sorted({x for _, x in kept}), object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit - sums / n).astype(float)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in kept:
        for k in range(min(components, len(x))):
            w = float(((np.array(x, object) - sums / n).astype(float) @ vectors[:, k]) / math.sqrt(values[k]))
            out[i, k + 1] = (n, int(((n * np.array(x, object) - sums) ** 2).sum()), abs(w), values[k] / np.trace(cov))
    return out


def agree(rows, result, components=4):
    want = brute(rows, components)
    assert {(r.vec_id, r.component) for r in result} == set(want) and len(result) == len(want)
    for r in result:
        n, deviation, w, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(w, abs=1e-7)
        assert r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error < 1e-9
    assert len({r.identity_error for r in result}) <= 1


def vectors(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    spread = np.linspace(1, 0.3, dim)
    return [(i, (rng.standard_normal(dim) * spread * 0.1).astype(np.float32).tolist()) for i in range(n)]


def test_matches_a_full_decomposition(spark):
    rows = vectors(900, 48)
    rows += [(1000 + i, rows[3][1]) for i in range(400)]          # copies count once in the fit
    agree(rows, found(spark, rows))


def test_small_block_needs_filters(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 8)
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    agree(vectors(300, 40, 5), found(spark, vectors(300, 40, 5)))


def test_pairs_with_close_and_far_eigenvalues():
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.standard_normal((90, 90)))[0]
    for values in ([1e6, 1.3, 1.2, 1.1] + [1.0] * 86, [5, 4, 3, 2] + [0] * 86, list(range(90, 0, -1))):
        matrix = turn * np.array(values, float) @ turn.T
        got, q = whitening.leading_pairs(lambda m: matrix @ m, 90, 4)
        assert np.allclose(got, values[:4], rtol=1e-8)
        assert np.linalg.norm(matrix @ q - q * got) < 1e-9 * values[0]


def test_rows_left_out_and_odd_rows(spark):
    rows = vectors(40, 3)
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1.0, 2.0]), (106, [3e38, 0.0, 0.0])]
    agree(rows + [(None, rows[0][1])], found(spark, rows + bad + [(None, rows[0][1])]))


def test_no_variance_and_no_rows(spark):
    same = found(spark, [(i, [0.5, -0.25]) for i in range(5)])
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same) == sorted(
        (i, k, 1, 0, None, 0.0, 0.0) for i in range(5) for k in (1, 2))
    assert found(spark, []) == [] and found(spark, [(1, None)]) == []


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(1 << (8 + i % 11)), float(-i)]) for i in range(30)]
    agree(rows, found(spark, rows))
    wide = found(spark, [(0, [1e15, 0.0]), (1, [-1e15, 0.0])])
    assert all(r.deviation is None for r in wide)


def test_clashing_columns_are_ignored(spark):
    rows = [(i, v, 1, 2, "x") for i, v in vectors(30, 5)]
    agree([r[:2] for r in rows], found(spark, rows, SCHEMA + ", id int, n int, x string"))
