"""Nearest neighbours, ranked search and collocations against brute force, with nulls, ties, repeated rows and clashing names."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from panelloom.llm import ann, collocations, ranked_search

ABC = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _near(rows, k, every):
    out = []
    for q, x in rows:
        if q is None or q % every:
            continue
        scored = sorted((-float(np.dot(np.array(x, float), np.array(y, float))), v) for v, y in rows if v is not None and v != q)
        out += [(q, r + 1, v, -s) for r, (s, v) in enumerate(scored[:k])]
    return sorted(out)


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank string, ids int")


@pytest.mark.parametrize("sizes", [(1, 4096, 5), (30, 8, 4), (4, 3, 3)])
def test_neighbours_are_right_with_copies_ties_and_small_pieces(spark, monkeypatch, sizes):
    monkeypatch.setattr(ann, "LIST_SIZE", sizes[0] * 20)
    monkeypatch.setattr(ann, "PIECE", sizes[1])
    rng = np.random.default_rng(3)
    base = np.round(rng.standard_normal((120, 20)) * 8) / 8
    rows = [(i, base[i % 90].tolist()) for i in range(170)] + [(i, base[7].tolist()) for i in range(170, 260)]
    odd = [(300, None), (320, [0.0] * 20), (340, [math.nan] + [1.0] * 19), (360, [math.inf] + [1.0] * 19), (380, [None] + [1.0] * 19), (None, [1.0] * 20), (400, [1.0] * 3)]
    frame = _vectors(spark, [(*r, 1, "x", 2) for r in [*rows, *odd, rows[40], rows[40]]])
    k = sizes[2]
    got = sorted(map(tuple, ann.nearest_neighbours(frame, k=k, every=20).collect()))
    want = _near(rows, k, 20)
    hits = {(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}
    assert len(got) == len(want) and len(hits) >= 0.95 * len(want)
    assert all(abs(s - float(np.dot(np.array(dict(rows)[q]), np.array(dict(rows)[v])))) < 1e-9 for q, _, v, s in got)
    by = {}
    for q, r, v, s in got:
        by.setdefault(q, []).append((-s, v, r))
    assert all([r for *_, r in sorted(x)] == list(range(1, len(x) + 1)) for x in by.values())
    copies = [v for q, _, v, _ in got if q == 240]  # one vector with over ninety ids: the least others come first
    same = [i for i, x in rows if x == base[7].tolist() and i != 240]
    assert sum(v in same for v in copies) == 0 or [v for v in copies if v in same] == same[: sum(v in same for v in copies)]


def test_neighbours_of_norms_that_differ_and_clusters(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_SIZE", 60)
    monkeypatch.setattr(ann, "SAMPLE", 400)
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((6, 40)) * 2)[rng.integers(0, 6, 1500)] + rng.standard_normal((1500, 40)) * rng.uniform(0.2, 3, (1500, 1))
    frame = _vectors(spark, [(i, v.tolist(), 0, "", 0) for i, v in enumerate(x)])
    found = ann.nearest_neighbours(frame, k=20, every=20)
    assert ann.recall(frame, found) >= 0.95
    assert found.count() == 75 * 20


def test_fewer_candidates_than_asked_for_and_none(spark):
    few = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (7, [0.0, 2.0])]
    got = sorted(map(tuple, ann.nearest_neighbours(_vectors(spark, [(*r, 0, "", 0) for r in few])).collect()))
    assert got == [(0, 1, 20, 1.0), (0, 2, 7, 0.0), (20, 1, 0, 1.0), (20, 2, 7, 0.0)]
    assert ann.nearest_neighbours(_vectors(spark, [(20, [1.0], 0, "", 0)])).count() == 0
    assert ann.nearest_neighbours(_vectors(spark, [])).count() == 0


def test_neighbours_on_the_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = ann.nearest_neighbours(frame)
    assert ann.recall(frame, found) >= 0.95 and found.count() == 2000


def _ranked(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    bags = [(d, Counter(term.findall((t or "").translate(ABC)))) for d, t in docs]
    held = [b for _, b in bags if b]
    n_docs, n_terms = len(held), sum(sum(b.values()) for b in held)
    df = Counter(t for b in held for t in b)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(term.findall((t or "").translate(ABC)))
    out = []
    for i, terms in wanted.items():
        scored = []
        for d, b in bags:
            m = 10 + (90 * sum(b.values()) * n_docs) // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t in terms if b[t])
            if s > 0 and d is not None:
                scored.append((-s, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("segment", "block"), [(1 << 14, 500_000), (5, 4), (40, 1)])
def test_ranked_search_equals_brute_force(spark, monkeypatch, segment, block):
    monkeypatch.setattr(ranked_search, "SEGMENT", segment)
    rng = np.random.default_rng(2)
    words = [f"W{i}" for i in range(30)] + ["ñu", "9", "Éa"]
    text = lambda n: " ".join(rng.choice(words, n) + rng.choice([" ", ", ", "-"], n))
    docs = [(int(i), text(int(rng.integers(1, 40)))) for i in rng.permutation(150)]
    docs += [(900 + i, docs[3][1]) for i in range(40)] + [docs[5], docs[5], (None, "W1 W2 W3"), (1, None), (2, ""), (3, "... --"), (4, "W1 " * 30000)]
    items = [(i, text(6)) for i in range(12)] + [(3, "W7 ñu"), (50, None), (51, ""), (None, "W1"), (52, "unseen"), (53, docs[3][1])]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, item_id string, score int")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = sorted(map(tuple, ranked_search.ranked_search(d, b, block_terms=block).collect()))
    assert got == _ranked(docs, items, 10)


def test_ranked_search_of_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.ranked_search(d, b).count() == 0
    assert ranked_search.ranked_search(b.toDF("doc_id", "text"), b.limit(0)).count() == 0


def _phrases(docs, least, percent, top):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ABC)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang in n:
        found = []
        for (g, p), a in f.items():
            if g != lang or len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(g2 == lang and len(q) == 3 and b >= least and 100 * b >= percent * a and p in (q[:2], q[1:]) for (g2, q), b in f.items()):
                continue
            s, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, l, x, n[lang], -s) for r, (s, a, p, l, x) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("piece", [4 << 20, 300])
def test_collocations_equal_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(collocations, "PIECE_BYTES", piece)
    rng = np.random.default_rng(4)
    words = np.array(["a", "B", "cc", "ñu", "d-e", "(f)", "日本", "x\x00y"])
    text = lambda n: "".join(w + s for w, s in zip(rng.choice(words, n), rng.choice([" ", "  ", "\t", ". ", ",", "\n", " "], n)))
    docs = [(rng.choice(["en", "es", None, ""]), text(int(rng.integers(0, 80)))) for _ in range(60)]
    docs += [("en", "a a a a a a a a a a a a"), ("en", None), ("de", ""), (None, "...")] + [("en", "one two three")] * 12 + [("es", "long words " * 20000)]
    frame = spark.createDataFrame([(i, *r, 1, "p") for i, r in enumerate(docs)], "doc_id int, lang string, text string, rank int, phrase string")
    got = sorted(map(tuple, collocations.collocations(frame, 10, 50, 25).collect()))
    assert got == _phrases(docs, 10, 50, 25)


def test_collocations_of_an_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_collocation_counts_pass_64_bits_exactly(spark, monkeypatch):
    """Products of counts of 3 * 10**9 pass 64 bits; the score stays exact."""
    rows = [("en", 0, "", 10**10), ("en", 1, "a", 3_000_000_019), ("en", 1, "b", 3_000_000_037), ("en", 2, "a b", 2_999_999_999)]
    monkeypatch.setattr(collocations, "phrase_counts", lambda docs, least: spark.createDataFrame(rows, "lang string, k int, phrase string, f long"))
    (row,) = collocations.collocations(None).collect()
    assert row["score"] == 10**6 * 2_999_999_999**2 // (3_000_000_019 * 3_000_000_037)


def test_sql_forms_agree_on_the_tables(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    for got, sql in ((ranked_search.ranked_search(docs, items), ranked_search.oracle()), (collocations.collocations(docs), collocations.oracle())):
        want = con.sql(sql).to_arrow_table().select(got.columns).to_pydict()
        assert sorted(map(tuple, got.collect())) == sorted(zip(*want.values()))


def test_tree_bounds_hold(spark):
    rng = np.random.default_rng(1)
    term, doc = np.divmod(np.unique(rng.integers(0, 5 * 300, 400)), 300)
    share = rng.integers(1, 1000, len(term))
    tree = ranked_search.Tree(term.astype(np.int32), doc.astype(np.int32), share, 300)
    sums = np.bincount(doc, share * np.isin(term, [1, 3]), 300)
    for level in range(1, len(tree.levels)):
        for node in range(-(-300 // ranked_search.FAN**level)):
            below = tree.children(np.array([1, 3]), level - 1, node)
            width = ranked_search.FAN ** (level - 1)
            for c, bound in enumerate(below):
                at = (node * ranked_search.FAN + c) * width
                assert bound >= sums[at : at + width].max(initial=0)


def test_runs_hash_apart_by_language():
    one, two = (collocations.Runs(g, pa.array(["a b c"])) for g in ("en", "es"))
    assert len(np.intersect1d(np.concatenate(one.hashes), np.concatenate(two.hashes))) == 0
