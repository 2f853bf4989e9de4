"""What SQL can't say or isn't compared: Cao's ratios, communities, sinks, options and their errors."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom import session
from panelloom.operators import cells, profile, spatial, split, temporal, vectors, windows
from panelloom.sources import panels, sinks


def chaotic(n, x=0.4):
    out = []
    for _ in range(n):
        out.append(x)
        x = 3.8 * x * (1 - x)
    return out


def test_cao_against_brute_force(spark):
    x = chaotic(300)
    rows = [("s", t, v) for t, v in enumerate(x)] + [("flat", t, 1.0) for t in range(40)]
    series = spark.createDataFrame(rows, "series string, t long, x double")
    got = {(r.series, r.dim): r for r in temporal.cao_ratios(series, 1, 6).collect()}
    mean, sd = np.mean(x), np.std(x)
    z = [(v - mean) / sd for v in x]
    for d in range(1, 7):
        m = len(z) - d
        stretch, new = [], []
        for i in range(m):
            dist = [(max(abs(z[i + k] - z[j + k]) for k in range(d)), j) for j in range(m) if j != i]
            near, j = min(dist)
            more = abs(z[i + d] - z[j + d])
            new.append(more)
            if near >= 1e-15:
                stretch.append(max(near, more) / near)
        assert got["s", d].e == pytest.approx(np.mean(stretch), rel=1e-9) and got["s", d].e_star == pytest.approx(np.mean(new), rel=1e-9)
    assert got["flat", 1].e is None  # no two points apart
    dims = {r.series: r.dim for r in temporal.dimensions(series).collect()}
    assert dims["flat"] == 2 and 2 <= dims["s"] <= 13


def test_recurrence_in_estimated_dimensions(spark):
    series = spark.createDataFrame([("s", t, v) for t, v in enumerate(chaotic(200))], "series string, t long, x double")
    dim = temporal.dimensions(series).first().dim
    same = temporal.recurrence(series, 0.1, dim, scale="diameter")
    assert sorted(map(tuple, temporal.recurrence(series, 0.1, None, scale="diameter").collect())) == sorted(map(tuple, same.collect()))
    with pytest.raises(ValueError):
        temporal.recurrence(series, scale="inches")


def test_linear_decay_of_a_short_series(spark):
    series = spark.createDataFrame([("s", t, 0.0) for t in range(4)], "series string, t long, x double")
    got = {(r.src, r.dst): r.weight for r in temporal.khop(series, 10, "linear").collect()}
    assert got[0, 3] == pytest.approx(1 - 2 / 3) and len(got) == 6


def test_vector_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).round(1).tolist()) for i in range(300)] + [(900, [0.0] * 5), (901, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    real = [(i, np.array(v)) for i, v in rows if v is not None]
    forms = {"euclidean": lambda a, b: math.sqrt(((a - b) ** 2).sum()), "chebyshev": lambda a, b: abs(a - b).max(), "cosine": lambda a, b: 1 - (a @ b) / math.sqrt((a @ a) * (b @ b)) if a.any() and b.any() else None}
    for metric, d in forms.items():
        want = {}
        for i, a in real:
            near = sorted((round(x, 9), j) for j, b in real if j != i and (x := d(a, b)) is not None)[:4]
            want |= {(i, r + 1): j for r, (_, j) in enumerate(near)}
        assert {(r.dst, r["rank"]): r.src for r in vectors.knn(df, 4, metric, digits=9).collect()} == want
    with pytest.raises(ValueError):
        vectors.knn(df, 4, "hamming")


def test_communities(spark):
    clique = lambda nodes: [(a, b, 1.0) for a in nodes for b in nodes if a != b]
    edges = clique(range(5)) + clique(range(5, 10)) + [(4, 5, 0.1), (5, 4, 0.1), (20, 21, 1.0), (21, 20, 1.0)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    comps = profile.components(df)
    got = {r.node: r.community for r in profile.communities(df, comps).collect()}
    assert got == {**dict.fromkeys(range(5), 0), **dict.fromkeys(range(5, 10), 5), 20: 20, 21: 20}
    rounds = {r.node: r.community for r in profile.communities(df, comps, limit=5).collect()}
    assert rounds == got  # by rounds of joins, as larger components are
    one, two = ({r.component: r for r in profile.dense_profile(df, comps, limit=n).collect()} for n in (1000, 5))
    assert dict(two[20].asDict()) == dict(one[20].asDict()) and two[0].communities == 2
    for c in ("gap", "largest", "energy", "weighted_path", "weighted_diameter", "betweenness"):
        assert two[0][c] == pytest.approx(one[0][c], abs=1e-6), c
    row = profile.record(df).first()
    assert (row.nodes, row.component_count, row.triangle_count, row.component_metrics[0].nodes) == (12, 2, 20, 10)


def test_levels_merge():
    ring = np.zeros((30, 30))  # ten triangles in a ring: single moves find the triangles, a second level may join them
    for k in range(10):
        for a, b in ((0, 1), (1, 2), (0, 2)):
            ring[3 * k + a, 3 * k + b] = ring[3 * k + b, 3 * k + a] = 1
        ring[3 * k + 2, (3 * k + 3) % 30] = ring[(3 * k + 3) % 30, 3 * k + 2] = 1

    def modularity(part):
        s, m = ring.sum(axis=1), ring.sum()
        return sum(ring[np.ix_(part == c, part == c)].sum() / m - (s[part == c].sum() / m) ** 2 for c in set(part.tolist()))

    assert modularity(profile._communities(ring)) >= modularity(profile._moves(ring, 20)) > 0.5


def test_sinks(spark, tmp_path):
    epochs = spark.createDataFrame([("train", 0, "mae", 1.5), ("val", 0, "mae", 2.0)], "phase string, epoch int, metric string, value double")
    one = spark.createDataFrame([(1.25, 3)], "mae double, n long")
    record = json.loads(sinks.run_record({"k": 3, "name": "x"}, epochs, one, spark.createDataFrame([(9.0,)], "total double")).first().record)
    assert record["config"] == {"k": 3, "name": "x"} and record["prediction_metrics"]["mae"] == 1.25 and len(record["epochs"]) == 2
    sinks.write_json(one, f"file://{tmp_path}/metrics")
    assert spark.read.json(f"file://{tmp_path}/metrics").first().n == 3
    graph = spatial.SimilarityGraph("haversine", "gaussian", "topk", sparsifier_args={"k": 4})
    sinks.save_spec(graph, f"file://{tmp_path}/spec")
    assert sinks.load_spec(f"file://{tmp_path}/spec").to_dict() == graph.to_dict()
    cells_ = spark.createDataFrame([(1, 0.5, 2.0, True, False)], "node long, prediction double, value double, eval boolean, observed boolean").withColumn("ts", F.current_timestamp())
    sinks.write_imputation(cells_, f"file://{tmp_path}/imputed")
    assert spark.read.parquet(f"file://{tmp_path}/imputed").columns == sinks.IMPUTATION


def test_options_and_errors(spark, monkeypatch):
    assert [spatial.resolve_k(0.5, n) for n in (6, 8)] == [2, 4] and spatial.resolve_k(1.0, 4) == 3
    with pytest.raises(ValueError):
        spatial.resolve_k(1.5, 4)
    monkeypatch.setattr(spatial, "MAY_BE_NEGATIVE", {"identity"})
    with pytest.raises(ValueError):
        spatial.SimilarityGraph("identity", "gaussian", "topk")
    panel = spark.createDataFrame([(1, 0, 1.0)], "node long, t long, value double")
    with pytest.raises(ValueError):
        cells.resample_to(panel, "6 hours", "median")
    with pytest.raises(NotImplementedError):
        windows.phase_scaler(panel, panel, "robust")
    with pytest.raises(ValueError):
        windows.batches(panel, 0)
    with pytest.raises(ValueError):
        split.month_shift_mask(panel, "later")
    assert spatial.empty_graph(panel).count() == 0
    wide = spark.createDataFrame([(0, 1.0, None)], "ts long, a double, b double")
    assert sorted((r.node, r.value) for r in panels.unpivot(wide).collect()) == [("a", 1.0), ("b", None)]
    nested = spark.createDataFrame([(0, [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])], "sample long, x array<array<double>>")
    assert [r.value for r in panels.arrays_to_long(nested, "x", 2).collect()] == [1.0, 2.0, 3.0, 4.0]
    params = cells.standard_scaler(spark.createDataFrame([(1, 2.0), (1, 4.0)], "node long, value double"), ["node"])
    rows = cells.scale(spark.createDataFrame([(1, 4.0)], "node long, value double"), params, ["node"])
    assert cells.unscale(rows.drop("value")).first().value == pytest.approx(4.0)
    for name in temporal.TECHNIQUES:
        series = spark.createDataFrame([("s", t, random.Random(t).random()) for t in range(40)], "series string, t long, x double")
        args = {"naive": {"k": 2}, "chunked": {"window": 10, "stride": 5}, "quantile": {"bins": 3}}.get(name, {})
        assert temporal.build(name, series, **args).count() > 0


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Cluster()

    with pytest.raises(ValueError):
        session.shared_dir(Session())
    monkeypatch.setattr(Cluster, "getConf", staticmethod(lambda: {"spark.checkpoint.dir": "s3a://bucket/x"}))
    assert session.shared_dir(Session()) == "s3a://bucket/x"


def test_sanity_and_loader_errors(spark):
    bad = spark.createDataFrame([(1, [1.0, float("nan")]), (2, [0.0, 1.0])], "id long, v array<double>")
    same = spark.createDataFrame([(1, [1.0]), (2, [1.0])], "id long, v array<double>")
    for rows in (bad, same):
        with pytest.raises(ValueError):
            vectors.sane(rows)
    assert vectors.sane(same.limit(0)).count() == 0
    with pytest.raises(ValueError):
        panels.load(spark, "/nowhere", "weekly")
    with pytest.raises(ValueError):
        panels.load(spark, "/nowhere", "hourly", impute="magic")
    with pytest.raises(ValueError):
        spatial.SimilarityGraph("haversine")(bad)


def test_masked_loss_of_nothing(spark):
    from panelloom.operators import scores

    rows = spark.createDataFrame([(1.0, 2.0, False), (1.0, float("nan"), True), (None, 1.0, True)], "prediction double, target double, mask boolean")
    assert scores.masked_loss(rows).first().loss == 0.0
    told = spark.createDataFrame([(0, 1, 5, None), (1, 1, 5, 2.0), (2, 1, 5, 3.0), (0, 1, 6, None)], "sample long, node long, t long, prediction double")
    assert [tuple(r) for r in scores.overlap(told, "last").collect()] == [(1, 5, 2.0)]
    assert scores.masked_loss(rows.withColumn("mask", F.lit(True)), "squared", "sum").first().loss == 1.0
