"""Cosine neighbours in two steps: against SQL and brute force, and how many pairs the written formula still sees."""

import numpy as np
import pytest

from panelloom.operators import vectors
from panelloom.plans import catalog


def halves(a, ids, k, loops=False, digits=9):
    """(dst, src) of what _meet leaves of two halves of rows, inside and across."""
    out = []
    cut = len(a) // 2
    blocks = []
    for part in (slice(0, cut), slice(cut, None)):
        source = vectors._sources(ids[part], a[part], k)
        block = vectors._Block(ids[part], a[part], np.full(len(a[part]), -np.inf), source)
        best = vectors._Best(block, block, k, digits, loops)
        best.start()
        vectors._meet(block, block, best, None)
        out.append(best.rows)
        limit = np.full(len(a[part]), -np.inf)
        limit[block.at] = best.limit
        blocks.append(vectors._Block(ids[part], a[part], limit, source))
    best = [vectors._Best(x, y, k, digits, loops) for x, y in (blocks, blocks[::-1])]
    vectors._meet(*blocks, *best)
    return [*out, *(x.rows for x in best)]


def brute(a, ids, k, loops):
    with np.errstate(all="ignore"):
        a = a / np.abs(a).max(axis=1, keepdims=True)
        a = a / np.sqrt((a * a).sum(axis=1, keepdims=True))
        d = np.round(1 - np.clip(a @ a.T, -1, 1), 9)
    want = {}
    for i in range(len(a)):
        near = sorted((d[i, j], ids[j]) for j in range(len(a)) if np.isfinite(d[i, j]) and (loops or ids[i] != ids[j]))
        want |= {(ids[i], r): src for r, (_, src) in enumerate(near[:k])}
    return want


@pytest.mark.parametrize("kind", ["normal", "copies", "scaled", "alike", "same", "odd", "huge", "tiny", "few", "names"])
@pytest.mark.parametrize("loops", [False, True])
def test_against_brute_force(kind, loops, monkeypatch):
    rng = np.random.default_rng(6)
    a, ids = rng.normal(size=(230, 12)), rng.permutation(230)
    if kind == "copies":
        a[::2], a[1::6] = a[0], a[1]
    elif kind == "scaled":
        a[::2] = a[0] * np.arange(1, 116)[:, None]
    elif kind == "alike":
        a[::2] = a[0] + 1e-4 * rng.normal(size=(115, 12))
    elif kind == "same":
        a[:] = a[0]
    elif kind == "odd":
        a[3, 2], a[5, 1], a[7], a[9] = np.nan, np.inf, np.nan, 0.0
    elif kind == "huge":
        a *= 1e300
    elif kind == "tiny":
        a[::3] *= 1e-300
    elif kind == "few":
        a, ids = a[:4], ids[:4]
    elif kind == "names":
        ids = np.array([f"n{i}" for i in ids], dtype=object)
    for name, value in (("_SIDE", 16), ("_FIRST", 20), ("_HELD", 300), ("_CELLS", 1000)):
        monkeypatch.setattr(vectors, name, value)
    for k in (1, 5):
        found = {}
        for rows in halves(a, ids, k, loops):
            for src, dst, d in zip(rows["src"], rows["dst"], rows["d"]):
                found.setdefault(dst, []).append((d, src))
        got = {(dst, r): src for dst, near in found.items() for r, (_, src) in enumerate(sorted(near)[:k])}
        assert got == brute(a, ids, k, loops)


@pytest.mark.parametrize("kind", ["normal", "same"])
def test_few_pairs_reach_the_formula(kind, monkeypatch):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(3000, 32))
    if kind == "same":
        a[:] = a[0]
    seen = []
    exact = vectors._exact
    monkeypatch.setattr(vectors, "_exact", lambda x, y, metric: seen.append(len(x)) or exact(x, y, metric))
    halves(a, np.arange(len(a)), 5)
    assert sum(seen) < 0.01 * len(a) ** 2


def test_places():
    rng = np.random.default_rng(2)
    for shape in ((16, 24), (5, 7), (1, 8), (0, 8)):
        hit = rng.random(shape) < 0.1
        assert vectors._places(hit).tolist() == np.flatnonzero(hit).tolist()


@pytest.mark.parametrize("block", [vectors.BLOCK, 60])
def test_query_equals_sql_with_copies_and_repeated_ids(spark, tmp_path, monkeypatch, block):
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(8)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[::5] = v[0]
    v[1::10] *= 4 * v[1] / v[1::10]
    ids = [*range(270), *range(30)]
    c = duckdb.connect()
    c.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    c.executemany("INSERT INTO embeddings VALUES (?, ?, 0)", [(i, x.tolist()) for i, x in zip(ids, v)])
    c.execute("INSERT INTO embeddings VALUES (1000, NULL, 0)")
    c.execute(f"COPY embeddings TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    monkeypatch.setattr(vectors, "BLOCK", block)
    want = c.execute(f"SELECT src, dst, d, rank FROM ({catalog.ORACLE['cosine_neighbours']}) WHERE d IS NOT NULL").fetchall()
    rows = catalog.QUERIES["cosine_neighbours"](spark, str(tmp_path)).select("src", "dst", "d", "rank").collect()
    assert sorted(map(tuple, rows)) == sorted(want)


def test_lengths_whose_squares_overflow(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=(60, 4))
    scale = np.where(np.arange(60) % 2, 1e200, 1e-200)
    df = spark.createDataFrame([(i, (x * s).tolist()) for i, (x, s) in enumerate(zip(a, scale))], "id long, v array<double>")
    got = {(r.dst, r["rank"] - 1): r.src for r in vectors.knn(df, 3, "cosine", digits=9).collect()}
    assert got == brute(a, np.arange(60), 3, False)
