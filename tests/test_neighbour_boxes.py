"""Boxes of neighbours against all pairs."""

import numpy as np
import pytest

from lacuna.operators.impute import neighbour as N


@pytest.mark.parametrize("seed,ties,cats", [(0, False, 0), (1, True, 0), (2, True, 2), (3, False, 1)])
def test_boxes_give_what_all_pairs_give(seed, ties, cats):
    rng = np.random.default_rng(seed)
    q, d = rng.normal(size=(300, 3)), rng.normal(size=(2000, 3))
    if ties:
        q, d = np.round(q), np.round(d, 1)
    q[rng.random(q.shape) < 0.15] = np.nan
    qc, dc = rng.integers(0, 3, (300, cats)).astype(float), rng.integers(0, 3, (2000, cats)).astype(float)
    qc[rng.random(qc.shape) < 0.2] = np.nan
    ids, width = rng.permutation(2000), [3] * cats
    want = N._best(N._pair_dist(q, qc, d, dc, 3.0 + 3 * cats, width), ids, 5)
    bd, bi, _ = N.boxed_topk(q, qc, d, dc, ids, 5, 3.0 + 3 * cats, width)
    assert np.array_equal(want[0], bd) and np.array_equal(want[1], bi)


def test_few_donors_and_equal_donors():
    q, d = np.zeros((4, 2)), np.ones((700, 2))
    none, ids = np.zeros((4, 0)), np.arange(700)[::-1].copy()
    bd, bi, _ = N.boxed_topk(q, none, d, np.zeros((700, 0)), ids, 3, 2.0, [])
    assert bi.tolist() == [[0, 1, 2]] * 4 and np.allclose(bd, np.sqrt(2))
    bd, bi, _ = N.boxed_topk(q, none, d[:2], np.zeros((2, 0)), ids[:2], 5, 2.0, [])
    assert bi.tolist() == [[698, 699]] * 4


def test_pairs_fall_on_clustered_data():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 50, (20, 3))
    d, q = centres[rng.integers(20, size=8000)] + rng.normal(size=(8000, 3)), centres[rng.integers(20, size=1000)] + rng.normal(size=(1000, 3))
    *_, evaluated = N.boxed_topk(q, np.zeros((1000, 0)), d, np.zeros((8000, 0)), np.arange(8000), 5, 3.0, [])
    assert evaluated < 0.15 * 1000 * 8000
