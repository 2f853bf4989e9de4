"""Graphs whose affinities round to 0, and graphs without nodes: the same edges and figures as SQL has."""

import datetime as dt
import random

import pytest

duckdb = pytest.importorskip("duckdb")

from panelloom.operators import profile, spatial  # noqa: E402
from panelloom.plans import catalog, large, more  # noqa: E402, F401


@pytest.fixture(scope="module")
def far_apart(spark, tmp_path_factory):
    """Events of nine nodes, each with noise of its own: all distances are about the same and far above their deviation."""
    folder = tmp_path_factory.mktemp("far")
    start = dt.datetime(2024, 1, 1)
    draw = random.Random(5)
    rows = [(n * 600 + h, start + dt.timedelta(hours=h), n, "view", float(draw.randrange(1000))) for n in range(9) for h in range(600)]
    c = duckdb.connect()
    c.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    c.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?)", rows)
    c.execute(f"COPY events TO '{folder}/events.parquet' (FORMAT parquet)")
    assert c.execute(catalog.ORACLE["edge_weight_stats"]).fetchone()[3] == 0.0  # the largest weight
    return str(folder), c


def same_as_sql(spark, far_apart, name):
    folder, c = far_apart
    df = catalog.QUERIES[name](spark, folder)
    names = sorted(df.columns)
    rel = c.execute(catalog.ORACLE[name])
    order = [[d[0] for d in rel.description].index(n) for n in names]
    want = sorted(repr(tuple(r[i] for i in order)) for r in rel.fetchall())
    assert want and sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["small_world", "assortativity", "degrees", "component_profile", "components_several", "convolution_orders", "diffusion_supports", "edge_set_overlap"])
def test_weights_of_0_are_edges(spark, far_apart, name):
    same_as_sql(spark, far_apart, name)


def test_small_world_of_no_nodes(spark):
    row = profile.small_world(spark.createDataFrame([], "src long, dst long, weight double")).first()
    assert row.c is None and row.avg_path is None and row.path_random is None and row.sigma is None


def test_top_k_keeps_0_and_drops_what_is_below(spark):
    e = spark.createDataFrame([(0, 1, 0.0), (0, 2, -0.5), (1, 0, 0.0), (2, 0, -0.5)], "src long, dst long, weight double")
    assert sorted(map(tuple, spatial.top_k(e, 2).collect())) == [(0, 1, 0.0), (1, 0, 0.0)]


def test_adjacency_tells_weights_of_0_from_no_edge(spark, far_apart):
    same_as_sql(spark, far_apart, "adjacency_edges")


def test_clustering_of_weights_of_0(spark, far_apart):
    same_as_sql(spark, far_apart, "clustering")


@pytest.mark.parametrize("name", ["graph_of_masked_panel", "impute_neighbours", "gcn_propagate", "gcn_affine_fit", "laplacian_smoothness", "modularity", "masked_loss"])
def test_shares_of_weights_of_0(spark, far_apart, name):
    same_as_sql(spark, far_apart, name)
