"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()

from panelloom.plans import catalog, large, more  # noqa: E402, F401

FAST = ["panel_hourly", "mask_counts", "fill_hierarchical", "similarity_graph", "geo_topk", "horizontal_visibility", "natural_visibility", "recurrence_graph", "transition_graph", "metrics_pointwise", "components", "month_split", "sample_windows", "recurrence_scaled", "batches", "component_profile_several", "euclidean_neighbours", "radius_graph", "panel_loaded", "horizontal_visibility_all", "node_centralities", "weighted_nodes", "random_graphs", "khop_numbered", "graph_of_masked_panel", "recurrence_percentile", "nearest_ahead", "panel_stream"]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rel = con.execute(catalog.ORACLE[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == names
    order = [cols.index(n) for n in names]
    want = sorted(repr(tuple(r[i] for i in order)) for r in rel.fetchall())
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == want


def test_every_query_has_sql_or_a_reason():
    for name, f in catalog.QUERIES.items():
        assert name in catalog.ORACLE or "Rows only" in (f.__doc__ or ""), name


def test_entry_without_optional_parts():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(catalog.ORACLE) <= set(entry.oracle_sql())
