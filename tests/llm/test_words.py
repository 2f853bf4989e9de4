import re

import numpy as np
import pyarrow as pa

from panelloom.llm.words import ALNUM, SPACED, chunks, ngrams, range_hash, prefix_sums, sliding_min, words

TEXTS = ["a b  c", None, "", "  x\t\ny ", "é ü b\x1cc", "word " * 50, "tail"]


def test_words_are_those_of_the_patterns():
    for table, pattern in ((SPACED, rb"[^\x20\x09-\x0D]+"), (ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = words(pa.array(TEXTS), table, lower=table is ALNUM)
        for r, t in enumerate(TEXTS):
            raw = (t or "").encode()
            want = re.findall(pattern, raw.lower() if table is ALNUM else raw)
            assert [w.word(i) for i in range(w.first[r], w.first[r + 1])] == want


def test_equal_words_have_equal_hashes_in_any_place():
    w = words(pa.array(["x y z", "z y x y z"]))
    assert w.hashes[2] == w.hashes[3] == w.hashes[7] and len(set(w.hashes.tolist())) == 3
    g, fits = ngrams(w, 3)
    assert fits.tolist() == [True, False, False, True, True, True] and g[0] == g[5]


def test_range_hash_depends_on_length():
    s = prefix_sums(np.zeros(4, np.uint64))
    assert range_hash(s, np.array([0]), np.array([1])) != range_hash(s, np.array([0]), np.array([2]))


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 100, 50)
    for k in (1, 2, 5, 43):
        assert sliding_min(x, k).tolist() == [x[i : i + k].min() for i in range(51 - k)]


def test_chunks_keep_all_rows():
    batch = pa.record_batch({"text": ["x" * n for n in (5, 0, 50, 3, 3)], "k": list(range(5))})
    got = list(chunks([batch], limit=8))
    assert [r for b in got for r in b.column("k").to_pylist()] == list(range(5)) and len(got) > 1
