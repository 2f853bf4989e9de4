"""Small fixtures with known answers for the panel and graph operators."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from panelloom.operators import cells, profile, propagate, scores, spatial, split, temporal
from panelloom.sources import panels


def series(spark, xs, name="s"):
    return spark.createDataFrame([(name, i, float(x)) for i, x in enumerate(xs)], "series string, t long, x double")


def pairs(df):
    return sorted((r.src, r.dst) for r in df.collect())


def test_takens(spark):
    assert [r.v for r in temporal.takens(series(spark, range(1, 9)), 3).orderBy("t").collect()] == [[float(a + k) for k in range(3)] for a in range(1, 7)]
    assert [r.v for r in temporal.takens(series(spark, range(1, 9)), 3, 2).orderBy("t").collect()] == [[float(a), a + 2.0, a + 4.0] for a in range(1, 5)]
    assert temporal.takens(series(spark, [1, 2, 3]), 5, 2).count() == 0
    with pytest.raises(ValueError):
        temporal.takens(series(spark, [1]), 0)


def test_visibility(spark):
    s = series(spark, [1, 3, 2, 4, 1])
    want = [(0, 1), (1, 2), (1, 3), (2, 3), (3, 4)]
    assert pairs(temporal.visibility(s, "horizontal")) == want
    assert pairs(temporal.visibility(s, "natural")) == want
    assert len(pairs(temporal.visibility(s, "natural", undirected=True))) == 2 * len(want)
    assert pairs(temporal.visibility(series(spark, [5, 4, 3, 2, 1]), "natural", limit=1)) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    line = series(spark, [0.1 * t for t in range(60)])
    assert temporal.visibility(line, "horizontal", limit=60).count() == 59
    assert temporal.visibility(line, "natural", limit=60).count() == 65


def test_horizontal_inside_natural(spark):
    rng = random.Random(5)
    s = series(spark, [rng.randint(0, 9) for _ in range(80)])
    assert set(pairs(temporal.visibility(s, "horizontal"))) <= set(pairs(temporal.visibility(s, "natural")))


def test_neighbours_match_brute_force(spark):
    rng = random.Random(1)
    pts = [[rng.uniform(-1, 1) for _ in range(3)] for _ in range(120)]
    df = spark.createDataFrame([("a", i, p) for i, p in enumerate(pts)], "series string, t long, v array<double>")
    for w in (-1, 5):
        want = sorted((i, j) for i, j in itertools.combinations(range(120), 2) if j - i > w and max(abs(a - b) for a, b in zip(pts[i], pts[j])) < 0.4)
        assert pairs(temporal.neighbours(df, 0.4, w)) == want


def test_neighbour_fixtures(spark):
    def points(rows):
        return spark.createDataFrame([("a", i, [float(x) for x in p]) for i, p in enumerate(rows)], "series string, t long, v array<double>")

    assert pairs(temporal.neighbours(points([[0, 0], [0.05, 0.05], [0.15, 0.15], [1, 1], [0.02, 0.03]]), 0.1)) == [(0, 1), (0, 4), (1, 2), (1, 4)]
    assert pairs(temporal.neighbours(points([[0, 0], [0.05, 0.05], [0.1, 0.1], [0.15, 0.15], [0.5, 0.5]]), 0.12)) == [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)]
    assert pairs(temporal.neighbours(points([[0, 0], [0.01, 0.01], [0.02, 0.02], [0.03, 0.03], [1, 1]]), 0.05, 2)) == [(0, 3)]
    assert len(pairs(temporal.neighbours(points([[1, 2]] * 3), 0.1))) == 3


def test_khop(spark):
    s = series(spark, range(5))
    assert pairs(temporal.khop(s, 2)) == [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (2, 4), (3, 4)]
    assert temporal.khop(s, 0).count() == 0
    with pytest.raises(ValueError):
        temporal.khop(s, -1)
    with pytest.raises(ValueError):
        temporal.khop(s, 1, "sideways")


def test_quantiles_and_transitions(spark):
    s = series(spark, [1, 2, 3, 4, 1, 2, 3, 4])
    bins = [r.bin for r in temporal.quantile_bins(s, 2).orderBy("t").collect()]
    assert bins == [0, 0, 1, 1, 0, 0, 1, 1]
    moves = {(r.src, r.dst): r.weight for r in temporal.transitions(temporal.quantile_bins(s, 2)).collect()}
    assert moves[(0, 0)] == moves[(0, 1)] == 0.5


def test_top_k_and_symmetry(spark):
    e = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.5), (1, 0, 0.9), (1, 2, 0.1), (2, 0, 0.5), (2, 1, 0.1)], "src long, dst long, weight double")
    assert pairs(spatial.top_k(e, 1)) == [(0, 1), (0, 2), (1, 0), (2, 0)]
    once = spatial.symmetrize(e)
    assert sorted(once.collect()) == sorted(spatial.symmetrize(once).collect())
    assert spatial.resolve_k(0.5, 6) == 2 and spatial.resolve_k(9, 4) == 3
    with pytest.raises(ValueError):
        spatial.resolve_k(1.5, 6)
    with pytest.raises(ValueError):
        spatial.SimilarityGraph(distance="unheard of")
    spec = spatial.SimilarityGraph(sparsifier_args={"k": 2})
    assert spatial.SimilarityGraph.from_dict(spec.to_dict()).to_dict() == spec.to_dict()


def panel_rows(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [("a", day + dt.timedelta(hours=h), v) for h, v in enumerate([1.0, None, 3.0, float("nan"), 5.0])] + [("b", day + dt.timedelta(hours=2), 7.0)]
    return panels.panel(spark.createDataFrame(rows, "node string, ts timestamp_ntz, value double"))


def test_panel_grid_and_fill(spark):
    p = panel_rows(spark)
    assert p.count() == 10 and p.filter("observed").count() == 4
    filled = {(r.node, r.t): r.value for r in cells.fill_gaps(p).collect()}
    assert [filled[("a", t)] for t in range(5)] == [1.0, 1.0, 3.0, 3.0, 5.0] and filled[("b", 0)] == 7.0
    assert cells.hierarchical_fill(p).filter("filled IS NULL").count() == 0


def test_scaling_round_trip(spark):
    p = panel_rows(spark).filter("observed AND node = 'a'")
    back = cells.unscale(cells.scale(p, cells.standard_scaler(p, ["node"]), ["node"]))
    assert sorted(round(r.value, 9) for r in back.collect()) == [1.0, 3.0, 5.0]


def test_samples(spark):
    s = split.samples(panel_rows(spark), 3)
    assert [(r.first_t, r.last_t) for r in s.orderBy("sample").collect()] == [(0, 2), (1, 3), (2, 4)]
    assert split.overlapping(s.filter("sample = 0"), s.filter("sample = 2")).count() == 1


def graph(spark, edges):
    rows = [(a, b, float(w)) for a, b, w in edges] + [(b, a, float(w)) for a, b, w in edges]
    return spark.createDataFrame(rows, "src long, dst long, weight double")


def test_profile(spark):
    g = graph(spark, [(0, 1, 1), (1, 2, 1), (0, 2, 1), (2, 3, 1), (8, 9, 1)])
    assert profile.triangles(g).count() == 1
    comps = {r.node: r.component for r in profile.components(g).collect()}
    assert comps == {0: 0, 1: 0, 2: 0, 3: 0, 8: 8, 9: 8}
    hops = {(r.src, r.dst): r.hops for r in profile.hop_paths(g).collect()}
    assert hops[(0, 3)] == 2 and (0, 8) not in hops
    c = {r.node: r.clustering for r in profile.clustering(g).collect()}
    assert c[0] == 1.0 and round(c[2], 6) == round(1 / 3, 6) and c[8] == 0.0
    dense = {r.component: r for r in profile.dense_profile(g, profile.components(g)).collect()}
    assert dense[8].largest == pytest.approx(2.0) and dense[0].betweenness == pytest.approx(1 / 6)


def test_diffusion_rows_sum_to_one(spark):
    g = graph(spark, [(0, 1, 2), (1, 2, 3)])
    sums = propagate.supports(g).groupBy("way", "src").agg(F.sum("weight").alias("s")).collect()
    assert all(r.s == pytest.approx(1, abs=1e-5) for r in sums)


def test_scores(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (None, 1.0), (5.0, 0.0)], "prediction double, target double")
    r = scores.errors(rows).first()
    assert r.n == 3 and r.mae == pytest.approx(2.0) and r.mape == pytest.approx(0.25) and r.wape == pytest.approx(6 / 5)
    assert scores.correlations(rows.filter("prediction = 3")).first().pearson == 0.0
    p = spark.createDataFrame([(0, 0, "a", 1.0), (1, 0, "a", 2.0), (2, 0, "a", 6.0)], "sample long, t long, node string, prediction double")
    value = lambda how: scores.overlap(p, how).first().prediction
    assert (value("mean"), value("last"), value("central")) == (3.0, 1.0, 2.0)
    with pytest.raises(ValueError):
        scores.overlap(p, "median")


def test_stream_equals_batch(spark, tmp_path):
    from panelloom.streaming.panel_stream import hourly_stream, run_available

    day = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([(k % 3, day + dt.timedelta(minutes=17 * k), float(k)) for k in range(60)], "user_id long, ts timestamp_ntz, value double")
    events.write.parquet(str(tmp_path / "events"))
    got = run_available(hourly_stream(spark, str(tmp_path / "events")), "hourly_test", str(tmp_path / "cp"))
    want = events.groupBy((F.col("user_id") % 36).alias("node"), F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("value"))
    assert sorted((r.node, r.value) for r in got.collect()) == sorted((r.node, r.value) for r in want.collect())


def test_visibility_of_any_length(spark):
    rng = random.Random(4)
    x = [float(rng.randrange(-40, 40)) for _ in range(300)]
    x[10] = x[280] = 90.0
    for kind in ("horizontal", "natural"):
        want = []
        for i in range(300):
            for j in range(i + 1, 300):
                if all((x[k] < min(x[i], x[j])) if kind == "horizontal" else x[k] < x[j] + (x[i] - x[j]) * (j - k) / (j - i) for k in range(i + 1, j)):
                    want.append((i, j))
        assert pairs(temporal.visibility(series(spark, x), kind)) == sorted(want) and (10, 280) in want


def test_cao_query_takes_every_dimension(monkeypatch):
    from panelloom.plans import catalog

    monkeypatch.setattr(catalog, "_series", lambda spark, sf: None)
    monkeypatch.setattr(temporal, "cao_dimension", lambda series, lag=1, max_dim=15: max_dim)
    assert catalog.cao_dimension(None, None) == 15
