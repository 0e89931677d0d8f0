"""Close pairs of two blocks by a look in single precision, and least forests, against brute force."""

import numpy as np
import pytest

from motioncat.operators import blocks, sweep


@pytest.mark.parametrize("n, m, dim", [(1300, 700, 64), (513, 5, 3), (3, 1025, 200), (1, 1, 2)])
def test_pairs_of_two_blocks(monkeypatch, n, m, dim):
    """Pairs just above and just below the floor are told apart as by double precision, in runs of bounded size."""
    monkeypatch.setattr(blocks, "CLOSE_AT_ONCE", 100)
    rng = np.random.default_rng(n)
    floor = 0.88
    left = blocks.unit_rows(rng.normal(size=(n, dim)))
    right = blocks.unit_rows(left[rng.integers(0, n, m)] + rng.normal(scale=0.5 / np.sqrt(dim), size=(m, dim)))
    aside = blocks.unit_rows(rng.normal(size=(m, dim)))
    for k in range(0, min(n, m), 3):  # cosines within 1e-7 of the floor
        side = blocks.unit_rows((aside[k] - (aside[k] @ left[k]) * left[k])[None])[0]
        c = floor + (k % 7 - 3) * 3e-8
        right[k] = c * left[k] + np.sqrt(1 - c * c) * side
    runs = list(blocks.close_pairs(left, right, floor, False))
    found = {(int(a), int(b)): x for i, j, sims in runs for a, b, x in zip(i, j, sims)}
    sims = left @ right.T
    unsure = np.abs(sims - floor) < 1e-13
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero((sims >= floor) & ~unsure))}
    assert want <= set(found) <= want | {(int(a), int(b)) for a, b in zip(*np.nonzero(unsure))}
    assert sum(len(i) for i, _, _ in runs) == len(found) and all(len(i) <= 100 for i, _, _ in runs)
    assert all(x == pytest.approx(sims[p], abs=1e-12) for p, x in found.items())


def test_pairs_of_one_block_come_once():
    rng = np.random.default_rng(2)
    v = blocks.unit_rows(np.repeat(rng.normal(size=(40, 16)), 30, axis=0) + rng.normal(scale=0.05, size=(1200, 16)))
    v[5] = 0
    found = [(int(a), int(b)) for i, j, _ in blocks.close_pairs(v, v, 0.9, True) for a, b in zip(i, j)]
    assert len(found) == len(set(found)) and set(found) == {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(v @ v.T >= 0.9, k=1)))}
    assert sum(len(i) for i, _, _ in blocks.close_pairs(v[:9], v[:9], blocks.near_floor(1.0), True)) == 36


@pytest.mark.parametrize("seed", range(5))
def test_least_forest_is_that_of_kruskal(seed):
    rng = np.random.default_rng(seed)
    n, m = 60, 150
    a, b, w = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 5, m) / 4
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = []
    for e in np.argsort(w, kind="stable"):
        x, y = root(a[e]), root(b[e])
        if x != y:
            parent[x] = y
            want.append(int(e))
    assert sorted(sweep.least_forest(n, a, b, w).tolist()) == sorted(want)
