"""The pipeline's stages on a small corpus with planted cases."""

import random

import corpus_pipeline
from panelloom.session import stored


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    kinds = {"xx": ["kala", "muro", "tiso", "pelu", "nare"], "yy": ["schtung", "grepf", "zwerk", "knolch", "stram"]}
    text = lambda lang, n: " ".join(rng.choice(kinds[lang]) + rng.choice("abcdefghij") for _ in range(n))
    rows = [(i, text(lang, 90), lang) for i, lang in enumerate(["xx", "yy"] * 40)]
    passage, leak = text("xx", 60), text("yy", 12)
    rows += [(100, rows[0][1], "xx"), (101, "12 34", "xx"), (102, f"{text('xx', 100)} {passage}", "xx"), (103, f"{text('xx', 150)} {passage}", "xx"), (104, f"{text('yy', 50)} {leak} {text('yy', 50)}", "yy"), (105, None, "yy")]
    df = spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        kept.append({r.doc_id: r.text for r in docs.collect()})
    lid, near, cut, clean, coded = kept
    assert set(rows_ := {i for i, _, _ in rows}) - set(lid) == {101, 105} and rows_
    assert set(lid) - set(near) == {100}
    assert set(cut) == set(near) and passage in cut[102] and passage not in cut[103] and len(cut[103].split()) == 150
    assert set(cut) - set(clean) == {104}
    assert coded == clean and all(r.n_tokens == len(r.ids) for r in docs.collect())
    assert docs.columns[:5] == corpus_pipeline.COLUMNS


def _documents(spark, rows):
    """Documents with columns whose names clash with those that stages add."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 7, "k", -1, [1]) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id int, kept string, SCORE int, ids array<int>")


def _shingles(t):
    w = t.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def _benchmark(spark, folder, items):
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_an_empty_table_stays_empty(spark, tmp_path):
    _documents(spark, [(1, "a", "xx")]).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    _benchmark(spark, tmp_path, [(1, "one two three four five six seven eight nine ten")])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*corpus_pipeline.COLUMNS, "ids", "n_tokens"] and out.count() == 0


def test_near_duplicates_equal_brute_force_with_repeats_ties_and_long_texts(spark, tmp_path):
    rng = random.Random(10)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    base, long = [text(60) for _ in range(6)], text(30_000)
    near = [" ".join([*b.split()[:-2], "x", "y"]) for b in base]
    rows = [(k, b) for k, b in enumerate(base)] + [(10 + k, t) for k, t in enumerate(near)] + [(10, near[0]), (0, base[0]), (30, long), (31, long + " more"), (40, None), (41, ""), (42, " \n"), (None, text(20)), (None, base[1])]
    docs = _documents(spark, [(i, t, "xx") for i, t in rows])
    got = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert got.columns == corpus_pipeline.COLUMNS
    known = [(i, _shingles(t or "")) for i, t in rows if i is not None]
    gone, smaller = set(), True
    root = {i: i for i, _ in known}
    while smaller:  # labels run along links until nothing changes
        smaller = False
        for i, a in known:
            for j, b in known:
                if a and b and root[j] < root[i] and 100 * len(a & b) >= 80 * len(a | b):
                    root[i], smaller = root[j], True
    gone = {i for i, r in root.items() if r != i}
    assert gone >= {10, 31}
    want = sorted((i, t or "") for i, t in rows if i is not None and i not in gone)
    assert sorted((r.doc_id, r.text or "") for r in got.filter("doc_id IS NOT NULL").collect()) == want


def test_passages_and_leaks_equal_brute_force_with_repeats_and_long_texts(spark, tmp_path):
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, leak, tail = text(70), text(12), text(49)
    rows = [(1, f"{text(20)} {passage} {text(20)}"), (2, f"{text(5_000)} {passage} {text(5_000)}"), (2, f"{text(7)}  {tail}"), (3, tail), (4, passage), (4, passage), (5, f"{leak} {text(9)}"), (6, " ".join(leak.split()[:9])), (7, None), (8, ""), (9, "too  few\twords")]
    docs = _documents(spark, [(i, t, "xx") for i, t in rows])
    _benchmark(spark, tmp_path, [(1, leak.upper()), (2, None)])
    starts = {}
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            starts[key] = min(i, starts.get(key, i))
    want = []
    for i, t in rows:
        w = (t or "").split()
        cut = {j for k in range(len(w) - 49) if starts[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        want.append((i, " ".join(v for j, v in enumerate(w) if j not in cut) if cut else t))
    got = corpus_pipeline.repeated_passages(spark, docs, str(tmp_path))
    assert got.columns == corpus_pipeline.COLUMNS
    key = lambda r: (r[0], r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted(want, key=key)
    clean = corpus_pipeline.benchmark_leaks(spark, docs, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in clean), key=key) == sorted(((i, t) for i, t in rows if i != 5), key=key)
    coded = corpus_pipeline.tokens(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in coded) == sorted((i, t or "") for i, t in rows) and all(r.n_tokens == len(r.ids) for r in coded)
