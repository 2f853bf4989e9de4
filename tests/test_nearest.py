"""Nearest neighbours by cells against all pairs, and Cao's ratios through both ways."""

import random

import numpy as np
import pytest

from panelloom.operators import nearest, temporal


def _series(spark, table):
    return spark.createDataFrame([(s, t, float(v)) for s, xs in table.items() for t, v in enumerate(xs)], "series string, t long, x double")


def _chaotic(n, x=0.4):
    out = []
    for _ in range(n):
        out.append(x)
        x = 3.8 * x * (1 - x)
    return out


def _all_pairs(x, lag, d):
    x, m = np.array(x, float), len(x) - d * lag
    dist = np.max([np.abs(x[k * lag : k * lag + m][:, None] - x[k * lag : k * lag + m][None, :]) for k in range(d)], axis=0)
    np.fill_diagonal(dist, np.inf)
    at = dist.argmin(axis=1)
    return {t: (float(dist[t, at[t]]), int(at[t]), float(abs(x[t + d * lag] - x[at[t] + d * lag]))) for t in range(m)}


@pytest.mark.parametrize("block, tile, together", [(7, 3, 2), (64, 512, 16)])
@pytest.mark.parametrize("lag", [1, 2])
def test_neighbours_equal_all_pairs(spark, monkeypatch, block, tile, together, lag):
    for name, value in (("BLOCK", block), ("TILE", tile), ("TOGETHER", together)):
        monkeypatch.setattr(nearest, name, value)
    rng = random.Random(4)
    table = {"chaos": _chaotic(230), "noise": [rng.gauss(0, 1) for _ in range(150)], "ties": [rng.randrange(3) for _ in range(120)], "flat": [1.0] * 40, "few": [1.0, 4.0, 2.0, 7.0]}
    found, dims = nearest.nearest_ahead(_series(spark, table), lag, 5, worth=1.0)
    got = {}
    for r in found.collect():
        got.setdefault((r.series, r.dim), {})[r.t] = (r.near, r.at, r.more)
    want = {(s, d): near for s, x in table.items() for d in range(1, 6) if len(x) - d * lag >= 2 and (near := _all_pairs(x, lag, d))}
    assert got == want
    assert {r.dims for r in dims.collect()} == {0b111110}


def test_cao_is_the_same_by_cells_and_without(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 16)
    rng = random.Random(5)
    series = _series(spark, {"chaos": _chaotic(500), "noise": [rng.gauss(0, 1) for _ in range(300)], "short": _chaotic(90, 0.3), "flat": [2.0] * 200})
    whole = {(r.series, r.dim): (r.e, r.e_star) for r in temporal.cao_ratios(series, 1, 8).collect()}
    cells = {(r.series, r.dim): (r.e, r.e_star) for r in temporal.cao_ratios(series, 1, 8, short=100).collect()}
    assert set(whole) == set(cells)
    for k, (e, star) in whole.items():
        assert cells[k][0] == (None if e is None else pytest.approx(e, rel=1e-9)) and cells[k][1] == pytest.approx(star, rel=1e-9)
    _, sought = nearest.nearest_ahead(series.filter("series IN ('chaos', 'noise')"), 1, 8)
    left = {r.series: r.dims for r in sought.collect()}
    assert left["chaos"] & 0b1110 == 0b1110 and not left["noise"] >> 8 & 1  # noise in many dimensions is sought without cells


def test_no_series(spark):
    found, dims = nearest.nearest_ahead(_series(spark, {"a": [1.0]}).limit(0), 1, 3)
    assert found.count() == 0 and dims.count() == 0
    with pytest.raises(ValueError):
        temporal.cao_ratios(_series(spark, {"a": [1.0]}), max_dim=61)
