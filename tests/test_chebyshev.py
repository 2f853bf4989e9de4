"""Chebyshev neighbours by codes of one byte, against brute force, and how many pairs the written formula still sees."""

import numpy as np
import pytest

from panelloom.operators import vectors


def brute(a, b, ia, ib, k, unit, loops):
    with np.errstate(invalid="ignore"):
        d = np.abs(a[:, None, :] - b[None]).max(axis=2)
    d[~np.isfinite(d)] = np.inf
    if not loops:
        d[ia[:, None] == ib[None]] = np.inf
    kth = np.sort(d, axis=1)[:, k - 1] if len(b) >= k else np.full(len(a), np.inf)
    return {(i, j) for i, j in zip(*np.nonzero((d <= kth[:, None] + unit) & np.isfinite(d)))}


@pytest.mark.parametrize("kind", ["normal", "ties", "outliers", "missing", "few", "same", "huge"])
@pytest.mark.parametrize("loops", [False, True])
def test_against_brute_force(kind, loops):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(150, 9))
    if kind == "ties":
        a = np.round(a)
    elif kind == "outliers":
        a[::17] *= 1e6
    elif kind == "missing":
        a[3, 2], a[5, 1], a[7] = np.nan, np.inf, np.nan
    elif kind == "few":
        a = a[:4]
    elif kind == "same":
        a[:] = a[0]
    elif kind == "huge":
        a *= 1e300
    ids = np.arange(len(a))
    for k in (1, 5):
        found = {(int(i), int(j)) for part in vectors._chebyshev_best(a, a, ids, ids, k, 1e-9, loops) for i, j in zip(*part[:2])}
        want = brute(a, a, ids, ids, k, 1e-9, loops)
        assert want <= found
        assert len(found) <= len(want) + (0 if kind == "huge" else 2 * len(a))


def test_few_pairs_reach_the_formula(monkeypatch):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(3000, 32))
    seen = []
    exact = vectors._exact
    monkeypatch.setattr(vectors, "_exact", lambda x, y, metric: seen.append(len(x)) or exact(x, y, metric))
    ids = np.arange(len(a))
    list(vectors._chebyshev_best(a, a, ids, ids, 5, 1e-9, False))
    assert sum(seen) < 0.05 * len(a) ** 2
