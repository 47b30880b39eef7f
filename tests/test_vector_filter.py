"""Vectors ruled out by a matrix product, against exact distances of all pairs."""

import numpy as np
import pytest

from lacuna.operators.impute import neighbour as N


@pytest.mark.parametrize("case", ["plain", "ties", "far from zero", "not finite", "few"])
def test_filter_keeps_the_nearest(case):
    rng = np.random.default_rng(1)
    q, d = rng.normal(size=(60, 16)), rng.normal(size=(900, 16))
    if case == "ties":
        q, d = np.round(q), np.repeat(np.round(d[:90]), 10, axis=0)
    if case == "far from zero":
        q, d = 1e6 + q * 1e-3, 1e6 + d * 1e-3
    if case == "not finite":
        d[5, 3] = np.inf
    if case == "few":
        d = d[:2]
    ids = rng.permutation(len(d))
    want, got = N._best(N._euclid(q, d), ids, 3), N.vector_topk(q, d, ids, 3)
    assert np.array_equal(want[0], got[0]) and np.array_equal(want[1], got[1])


def test_few_pairs_are_left_to_exact_distances(monkeypatch):
    rng, seen = np.random.default_rng(2), []
    exact = N._pair_euclid
    monkeypatch.setattr(N, "_pair_euclid", lambda qm, dm, i, j: seen.append(len(i)) or exact(qm, dm, i, j))
    N.vector_topk(rng.normal(size=(50, 64)), rng.normal(size=(5000, 64)), np.arange(5000), 3)
    assert sum(seen) <= 50 * 4


def test_extremes_of_repairs():
    rng = np.random.default_rng(4)
    q, d, start = rng.normal(size=(7, 5)), rng.normal(size=(9, 5)), np.array([0, 1, 4, 5, 8])
    sim = 1.0 / (1.0 + N._euclid(q, d))
    i, j = np.divmod(np.arange(35), 5)
    low, high, every, first = N.repair_extremes(q, d, start, i, j)
    assert np.array_equal(low.reshape(7, 5), np.minimum.reduceat(sim, start, axis=1))
    assert np.array_equal(high.reshape(7, 5), np.maximum.reduceat(sim, start, axis=1))
    assert np.array_equal(every[first], sim[:, start].reshape(-1))
