"""Whole visibility graphs, paths and centralities, weighted paths, spectra, communities, order statistics, drawn graphs, streams."""

import datetime as dt
import heapq
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import draws, louvain, paths, profile, spatial, spectrum, temporal, visibility
from panelloom.sources import panels
from panelloom.streaming import state_panel


def graph(spark, edges):
    return spark.createDataFrame([r for a, b, w in edges for r in ((a, b, float(w)), (b, a, float(w)))], "src long, dst long, weight double")


def rings(seed=1, size=14, bases=(0, 100)):
    """Rings with chords, one component each."""
    rng = random.Random(seed)
    out = {}
    for base in bases:
        for a in range(size):
            out[base + a, base + (a + 1) % size] = rng.randint(1, 9) / 4
        for _ in range(size // 2):
            a, b = sorted(rng.sample(range(size), 2))
            out.setdefault((base + a, base + b), rng.randint(1, 9) / 4)
    return [(min(a, b), max(a, b), w) for (a, b), w in out.items() if (b, a) not in out or a < b]


def test_visibility_by_blocks(spark):
    rng = np.random.default_rng(0)
    shapes = {
        "random": rng.standard_normal(150), "steps": rng.integers(0, 4, 120).astype(float), "line": np.arange(60) * 0.1, "flat": np.ones(40), "walk": np.cumsum(rng.standard_normal(120)),
        "valley": np.arange(60.0) ** 2 / 7, "hill": -((np.arange(80.0) - 40) ** 2), "falls": -np.arange(50.0) ** 1.5, "one": np.array([1.0]), "two": np.array([1.0, 2.0]),
    }
    df = spark.createDataFrame([(k, t, float(v)) for k, x in shapes.items() for t, v in enumerate(x)], "series string, t long, x double")
    for kind in ("natural", "horizontal"):
        want = {
            (k, i, j)
            for k, x in shapes.items()
            for i, j in itertools.combinations(range(len(x)), 2)
            if (all(x[i + 1 : j] < min(x[i], x[j])) if kind == "horizontal" else visibility._formula(x, i, j))
        }
        got = [(r.series, r.src, r.dst) for r in visibility.whole_visibility(df, kind, block=16).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert sum(k == "line" for k, *_ in [w for w in got]) == 59
    assert visibility.whole_visibility(df.limit(0), "natural").count() == 0


def test_a_long_series_shuffles_little(spark):
    long = spark.range(40_000).select(F.lit("a").alias("series"), F.col("id").alias("t"), F.rand(3).alias("x"))
    assert 40_000 < visibility.whole_visibility(long, "horizontal").count() < 80_000


def _between(nodes, near):
    """Betweenness by counting paths through each node of each pair."""
    dist, count = {}, {}
    for s in nodes:
        d, c, front = {s: 0}, {s: 1}, [s]
        while front:
            nxt = []
            for v in front:
                for w in near[v]:
                    if w not in d:
                        d[w], c[w] = d[v] + 1, 0
                        nxt.append(w)
                    if d[w] == d[v] + 1:
                        c[w] += c[v]
            front = nxt
        dist[s], count[s] = d, c
    out = {}
    for v in nodes:
        n = len(dist[v])
        total = sum(count[s][v] * count[v][t] / count[s][t] for s in dist[v] for t in dist[v] if s != t and v not in (s, t) and dist[s][v] + dist[v][t] == dist[s][t])
        out[v] = (n - 1, (n - 1) / sum(dist[v].values()), max(dist[v].values()), total / max((n - 1) * (n - 2), 1))
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_centralities_against_counted_paths(spark, batches):
    edges = [*rings(size=9), (500, 501, 1.0), (600, 600, 1.0)]
    near = {}
    for a, b, _ in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = _between(sorted(near), near)
    got = {r.node: r for r in paths.node_centralities(graph(spark, edges), batches).collect()}
    assert set(got) == set(want)
    for v, (reach, close, ecc, through) in want.items():
        r = got[v]
        assert (r.reach, r.eccentricity) == (reach, ecc) and r.closeness == pytest.approx(close) and r.betweenness == pytest.approx(through)


def _dijkstra(edges):
    near = {}
    for a, b, w in edges:
        if w > 0 and a != b:
            near.setdefault(a, []).append((b, 1 / w))
            near.setdefault(b, []).append((a, 1 / w))
    out = {}
    for s in near:
        seen, heap = {}, [(0.0, s)]
        while heap:
            d, v = heapq.heappop(heap)
            if v not in seen:
                seen[v] = d
                for w, x in near[v]:
                    heapq.heappush(heap, (d + x, w))
        out |= {(s, t): d for t, d in seen.items() if t != s}
    return out


@pytest.mark.parametrize("batches", [1, 2])
def test_weighted_paths_against_dijkstra(spark, batches):
    edges = [*rings(3), (500, 501, 0.01), (501, 502, 50.0), (502, 503, 0.0), (504, 504, 2.0)]
    want = _dijkstra(edges)
    got = {(r.src, r.dst): r.length for r in paths.weighted_paths(graph(spark, edges), batches).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert paths.weighted_paths(graph(spark, [(1, 1, 1.0)])).count() == 0


def test_spectrum_and_communities_by_joins(spark):
    edges = [*rings(5, size=10), (500, 501, 2.0)]
    g = graph(spark, edges)
    comps = profile.components(g)
    got = {r.component: r for r in spectrum.laplacian_ends(g, comps).collect()}
    for base, size in ((0, 10), (100, 10), (500, 2)):
        a = np.zeros((size, size))
        for u, v, w in edges:
            if base <= u < base + size:
                a[u - base, v - base] = a[v - base, u - base] = w
        d = a.sum(axis=1)
        values = np.linalg.eigvalsh(np.eye(size) - a / np.sqrt(d[:, None] * d[None, :]))
        r = got[base]
        assert (r.gap, r.largest, r.energy) == pytest.approx((values[1], values[-1], np.abs(values).sum()), abs=1e-6) and r.error < 1e-6
    of = lambda parts: profile.modularity(g, parts.select("node", F.col("community").alias("part"))).first()[0]
    assert of(louvain.louvain(g)) >= of(profile.communities(g, comps)) - 1e-9


def test_order_statistics(spark, monkeypatch):
    monkeypatch.setattr(temporal, "PARTS", 8)
    rng = np.random.default_rng(2)
    values = {"a": rng.exponential(size=3000).tolist(), "ties": [1.0] * 500 + [2.0] * 500 + [7.5], "one": [3.0]}
    ranks = {"a": [0, 1, 1499, 2998, 2999, 5000], "ties": [0, 499, 500, 999, 1000], "one": [0]}
    df = spark.createDataFrame([(k, v) for k, x in values.items() for v in x], "series string, d double")
    want = spark.createDataFrame([(k, r) for k, x in ranks.items() for r in x], "series string, rank long")
    got = {(r.series, r["rank"]): r.value for r in temporal.order_statistics(df, want, few=40).collect()}
    assert got == {(k, r): sorted(values[k])[r] for k, x in ranks.items() for r in x if r < len(values[k])}


def test_drawn_graphs_have_exactly_their_edges(spark):
    for n, m in ((9, 36), (40, 100), (2, 1), (5, 0)):
        rows = draws.random_graphs(spark, n, m, draws=3, seed=4).collect()
        by = {}
        for r in rows:
            assert 0 <= r.src < n and 0 <= r.dst < n and r.src != r.dst
            by.setdefault(r.draw, set()).add((r.src, r.dst))
        assert all(len(x) == 2 * m and {(b, a) for a, b in x} == x for x in by.values()) and (len(by) == 3 or not m)
    assert len({frozenset(x) for x in (by or {})}) == 0
    with pytest.raises(ValueError):
        draws.random_graphs(spark, 4, 7)
    spread = draws.random_graphs(spark, 30, 87, draws=40).filter("src < dst").groupBy("src").agg(F.count("*").alias("n")).agg(F.sum("n")).first()[0]
    assert spread == 40 * 87


def test_small_world_against_brute_force(spark):
    g = graph(spark, rings(7, size=12, bases=(0,)))
    rows = draws.small_world_drawn(g, draws=2, seed=1).collect()
    known = profile.counts(g).first()
    for r in rows:
        near = {}
        for e in draws.random_graphs(spark, known.nodes, known.edges, draws=2, seed=1).filter(F.col("draw") == r.draw).collect():
            near.setdefault(e.src, set()).add(e.dst)
        local = [2 * sum(b in near[a] for a, b in itertools.combinations(near[v], 2)) / (len(near[v]) * (len(near[v]) - 1)) if len(near.get(v, ())) > 1 else 0.0 for v in range(known.nodes)]
        assert r.c_random == pytest.approx(np.mean(local))
        hops = {v: x for v, x in _between(sorted(near), near).items()}
        assert r.path_random == pytest.approx(sum(x[0] / x[1] for x in hops.values()) / sum(x[0] for x in hops.values()))


def test_stream_with_state_goes_on_after_restarts_and_counts_late_rows(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rng = random.Random(2)
    rows = [(k % 2, start + dt.timedelta(minutes=37 * k + rng.randrange(30)), rng.randrange(64) / 8) for k in range(200) if not 60 < k < 90]
    late = [(0, start + dt.timedelta(minutes=5), 100.0), (0, start + dt.timedelta(minutes=6), 100.0)]
    parts = [rows[:60], rows[60:120] + late, rows[120:] + [(0, rows[-1][1] + dt.timedelta(hours=3), None)]]
    folder = tmp_path / "in"
    schema = "user_id long, ts timestamp, value double"
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        cells, dropped = state_panel.run_available(state_panel.gap_filled(state_panel.events_stream(spark, str(folder)), "2 hours"), f"file://{tmp_path}/out")
        got = cells.collect()
        if k == 0:
            first = len(got)
        assert dropped == (len(late) if k == 1 else 0)
    assert len(got) > first
    mark = max(t for _, t, v in rows) - dt.timedelta(hours=2)
    cells = {}
    for node, t, v in rows:
        cells.setdefault((node, t.replace(minute=0)), []).append(v)
    want = []
    for node in (0, 1):
        hours = sorted(h for n, h in cells if n == node and h + dt.timedelta(hours=1) <= mark)
        h, last = hours[0], None
        while h <= hours[-1]:
            cell = round(sum(cells[node, h]) / len(cells[node, h]) * 64) / 64 if (node, h) in cells else None
            last = cell if cell is not None else last
            want.append((node, h, cell is not None, last))
            h += dt.timedelta(hours=1)
    assert sorted((r.node, r.ts, r.observed) for r in got) == sorted(w[:3] for w in want)
    assert all(abs(r.filled - {w[:2]: w[3] for w in want}[r.node, r.ts]) <= 1 / 64 for r in got)


def test_series_checks(spark):
    df = spark.createDataFrame([("a", 0, 1.0, "x"), ("a", 1, 2.0, "y")], "series string, t long, x double, s string")
    assert panels.as_series(df, "x", "series").count() == 2
    with pytest.raises(KeyError):
        panels.as_series(df, "value")
    with pytest.raises(TypeError):
        panels.as_series(df, "s")
    with pytest.raises(TypeError):
        panels.as_series(df, "x", step="x")
    for bad in ([("a", 0, None)], [("a", 0, float("nan"))], [("a", 0, 1.0), ("a", 2, 1.0)], [("a", 0, 1.0), ("a", 0, 1.0)]):
        with pytest.raises(Exception, match="series"):
            panels.as_series(spark.createDataFrame(bad, "series string, t long, x double"), "x", "series").collect()


def test_adjacency_and_numbered_hops(spark):
    adj = spark.createDataFrame([(7, [[0.0, 2.0], [None, 1.0]])], "sample int, adj array<array<double>>")
    assert sorted(map(tuple, panels.adjacency_to_edges(adj).collect())) == [(7, 0, 1, 2.0), (7, 1, 1, 1.0)]
    series = spark.createDataFrame([(s, t, 0.0) for s in ("b", "a") for t in range(4)], "series string, t long, x double")
    assert sorted((r.src, r.dst) for r in temporal.khop_numbered(series, 2).collect()) == [(n + a, n + b) for n in (0, 4) for a, b in ((0, 1), (0, 2), (1, 2), (1, 3), (2, 3))]


def test_cao_of_the_middle_and_noise(spark):
    x = [0.37]
    for _ in range(199):
        x.append(3.8 * x[-1] * (1 - x[-1]))
    series = spark.createDataFrame([("s", t, v) for t, v in enumerate(x)], "series string, t long, x double")
    z = (np.array(x) - np.mean(x)) / np.std(x)
    scaled = spark.createDataFrame([("s", t, float(v)) for t, v in enumerate(z[50:150])], "series string, t long, x double")
    assert [r.x for r in temporal.central(series, 100).orderBy("t").collect()] == x[50:150]
    middle = {r.dim: r.e for r in temporal.cao_ratios(series, 1, 4, points=100).collect()}
    own = {r.dim: r.e for r in temporal.cao_ratios(scaled, 1, 4).collect()}  # E is a ratio: scaling the segment changes nothing
    assert all(middle[d] == pytest.approx(own[d], rel=1e-9) for d in middle)
    with_noise = {r.dim: r.e for r in temporal.cao_ratios(series, 1, 4, noise="auto").collect()}
    plain = {r.dim: r.e for r in temporal.cao_ratios(series, 1, 4).collect()}
    assert all(with_noise[d] == pytest.approx(plain[d], rel=1e-3) for d in plain)
    a, b = (sorted(map(tuple, temporal.noisy(series, 0.1, seed=k).collect())) for k in (1, 1))
    assert a == b and np.std([v[2] - x[v[1]] for v in a]) == pytest.approx(0.1 * np.std(x), rel=0.3)
    with pytest.raises(ValueError):
        temporal.cao_dimension(series, max_dim=2)


def test_spatial_limits(spark, monkeypatch):
    with pytest.raises(ValueError, match="negative"):
        spatial.SimilarityGraph(distance="signed_correlation")
    panel = spark.createDataFrame([(t, n, float(t * (1 if n else -1)), True) for t in range(5) for n in (0, 1, 2)], "t long, node long, value double, observed boolean")
    assert {(r.src, r.dst): round(r.d, 9) for r in spatial.signed_correlation(panel).collect()}[0, 1] == 1.0
    monkeypatch.setattr(spatial, "PAIR_BLOCK", 3)
    nodes = spark.range(25).select(F.col("id").alias("node"))
    assert sorted((r.src, r.dst) for r in spatial.complete_graph(nodes).filter("src < dst").collect()) == list(itertools.combinations(range(25), 2))
    monkeypatch.setattr(spatial, "DENSE_NODES", 5)
    with pytest.raises(ValueError, match="dense"):
        spatial.dense(spatial.complete_graph(nodes), nodes)
