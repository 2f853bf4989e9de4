r"""Ranked lexical search: per-term trees of maxima over document ranges, descended best-first by summed bounds.

Terms are the maximal runs of digits, A-Z, a-z and characters beyond ASCII, with A-Z lower-cased. With N documents that hold a
term, L terms in all, df documents with a term, tf its occurrences in a document of n terms and m = 10 + (90 n N) div L, a
document scores the sum of w ((10**9 tf) div (1000 tf + 8 m)) over the item's terms, with w = floor(1000 ln((2N + 2) / (2df + 1))).

1. Index. Each task takes its documents in segments of SEGMENT and keeps, for the terms of the items, postings (document, tf),
   and the lengths of all documents; segments are written as binary cells. N, L and df are sums over the segments.
2. Search. A segment's tree has, for each term, the largest share of each document, of ranges of FAN documents, of ranges of
   FAN ranges and so on. For an item, a heap holds nodes by the sum of their terms' maxima; the best is opened into its children
   until the best bound lies below the item's tenth score. Nodes whose bound equals it are opened as well, as a document
   there may tie and have a smaller id. What a task has found bounds its next segments. Tasks send their best documents
   of each item; a ranking per item ends it.

The items are the stated query set: they are read in blocks of at most BLOCK_TERMS terms, which bounds the broadcast, and
each block passes over all documents; each pass is written before the next block is read.

Nulls and edges: null or termless texts have no terms and are not counted in N; documents with a null id count in N, L and df but
are not returned; items without terms, or with a null id, return nothing; rows of one item id are one item; repeated documents
are documents each, and a repeated id may be returned twice; texts of any length are indexed whole; other columns are ignored,
whatever their names; empty tables give an empty result. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.frames import release, ship_package, stored
from panelloom.llm.words import ALNUM, chunks, words

#: Documents of a segment, children of a node, terms of the items of one block (each 8 bytes and its places in items).
SEGMENT = 1 << 14
FAN = 16
BLOCK_TERMS = 500_000
#: Bytes of text that are cut into terms at once.
PIECE_BYTES = 1 << 20

_SEGMENT = "ids binary, known binary, sizes binary, terms binary, docs binary, tf binary"


class Items:
    """Terms of some items: their numbers in a sorted vocabulary of hashes."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        w = words(pa.array([t for _, t in rows], pa.large_string()), ALNUM, lower=True)
        self.vocabulary, number = np.unique(w.hashes, return_inverse=True)
        terms: dict[int, list[np.ndarray]] = {}
        for k, (item, _) in enumerate(rows):
            terms.setdefault(item, []).append(number[w.first[k] : w.first[k + 1]])
        self.terms = {i: t for i, parts in terms.items() if len(t := np.unique(np.concatenate(parts)).astype(np.int64))}


def _blocks(items: DataFrame, most: int) -> Iterator[Items]:
    """The items in blocks; rows of one id follow each other."""
    held: list[tuple[int, str]] = []
    size = 0
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("item_id IS NOT NULL").orderBy("item_id")
    for r in rows.toLocalIterator():
        if size >= most and held[-1][0] != r[0]:
            yield Items(held)
            held, size = [], 0
        held.append((r[0], r[1]))
        size += r[1].count(" ") + 1
    if held:
        yield Items(held)


def _indexed(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Segments: ids of documents, whether they have one, their numbers of terms, and postings sorted by (term, document)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value.vocabulary
        held: list[list[np.ndarray]] = []
        n = 0

        def segment() -> pa.RecordBatch:
            ids, known, sizes, term, doc, tf = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(term.astype(np.int64) << 32 | doc, kind="stable")
            cells = [ids, known, sizes, term[order], doc[order], tf[order]]
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], names=[x.split()[0] for x in _SEGMENT.split(", ")])

        for piece in chunks(batches, "text", PIECE_BYTES):
            w = words(piece.column("text"), ALNUM, lower=True)
            slot = np.searchsorted(vocab, w.hashes)
            slot[slot == len(vocab)] = 0
            hit = np.flatnonzero(vocab[slot] == w.hashes) if len(vocab) else np.zeros(0, np.int64)
            key, tf = np.unique(w.row_of[hit] * max(len(vocab), 1) + slot[hit], return_counts=True)
            ids = piece.column("doc_id")
            held.append([
                ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), np.diff(w.first).astype(np.int64),
                (key % max(len(vocab), 1)).astype(np.int32), (n + key // max(len(vocab), 1)).astype(np.int32), tf.astype(np.int64),
            ])
            n += piece.num_rows
            if n >= SEGMENT:
                yield segment()
                held, n = [], 0
        if held:
            yield segment()

    return rows


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, term, n) sums of a task: 0 documents with terms, 1 terms, 2 documents of a term."""
    docs = terms = 0
    df = np.zeros(0, np.int64)
    for b in batches:
        for sizes, term in zip(b.column("sizes"), b.column("terms")):
            n = np.frombuffer(sizes.as_py(), np.int64)
            docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
            more = np.bincount(np.frombuffer(term.as_py(), np.int32))
            df, more = (df, more) if len(df) >= len(more) else (more, df)
            df[: len(more)] += more
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array([0, 1, *[2] * len(some)], pa.int32()), pa.array([0, 0, *some.tolist()], pa.int32()), pa.array([docs, terms, *df[some].tolist()], pa.int64())], names=["kind", "term", "n"])


class Tree:
    """Maxima of each term over documents (level 0), ranges of FAN documents (1), and so on up to one range."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, share: np.ndarray, n_docs: int) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        node, width = doc.astype(np.int64), max(n_docs, 1)
        while True:
            self.levels.append((term.astype(np.int64) << 32 | node, share))
            if width <= 1:
                return
            width, up = -(-width // FAN), node // FAN
            edge = np.flatnonzero(np.append(True, (up[1:] != up[:-1]) | (term[1:] != term[:-1]))) if len(up) else np.zeros(0, np.int64)
            term, node, share = term[edge], up[edge], np.maximum.reduceat(share, edge) if len(edge) else share

    def children(self, terms: np.ndarray, level: int, node: int) -> np.ndarray:
        """Summed maxima of the FAN children of a node, which are at `level`."""
        keys, share = self.levels[level]
        base = terms << 32 | node * FAN
        lo, hi = np.searchsorted(keys, base), np.searchsorted(keys, base + FAN)
        size = hi - lo
        at = np.repeat(lo - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        return np.bincount((keys[at] & 0xFFFFFFFF) - node * FAN, share[at], FAN).astype(np.int64)  # sums below 2**53 are exact


def _search(tree: Tree, terms: np.ndarray, ids: np.ndarray, known: np.ndarray, best: list[tuple[int, int]], k: int) -> None:
    """Adds a segment's documents to best, a heap of the k best as (score, -id)."""
    top = len(tree.levels) - 1
    if top == 0:  # one document: a range of its own
        opened = [(0, 0, 0)]
    else:
        keys, share = tree.levels[top]
        at = np.searchsorted(keys, terms << 32)
        there = at < len(keys)
        there[there] = keys[at[there]] == terms[there] << 32
        bound = int(share[at[there]].sum())
        opened = [(-bound, top, 0)] if bound else []
    while opened:
        bound, level, node = heapq.heappop(opened)
        if len(best) == k and -bound < best[0][0] and level:
            return
        below = max(level - 1, 0)
        sums = tree.children(terms, below, node)
        least = best[0][0] if len(best) == k else 1
        for c in np.flatnonzero(sums >= least).tolist():
            if below:
                heapq.heappush(opened, (-int(sums[c]), below, node * FAN + c))
            elif known[node * FAN + c]:
                one = (int(sums[c]), -int(ids[node * FAN + c]))
                if len(best) < k:
                    heapq.heappush(best, one)
                elif one > best[0]:
                    heapq.heapreplace(best, one)


def _found(shared, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best documents of each item in a task's segments."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n_docs, n_terms = shared.value
        best: dict[int, list[tuple[int, int]]] = {i: [] for i in items}
        for b in batches:
            for row in b.to_pylist():
                ids, known, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], np.uint8), np.frombuffer(row["sizes"], np.int64)
                term, doc, tf = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["docs"], np.int32), np.frombuffer(row["tf"], np.int64)
                m = 10 + (90 * sizes * n_docs) // max(n_terms, 1)
                tree = Tree(term, doc, weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])), len(ids))
                for item, terms in items.items():
                    _search(tree, terms, ids, known, best[item], k)
        out = [(i, -d, s) for i, heap in best.items() for s, d in heap]
        item, doc, score = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["item_id", "doc_id", "score"])

    return rows


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, equal ones by the smaller id."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    passes = []
    for block in _blocks(items, block_terms):
        shared = spark.sparkContext.broadcast(block)
        segments = stored(rows.mapInArrow(_indexed(shared), _SEGMENT), "segments")
        stats = segments.mapInArrow(_stats, "kind int, term int, n long").groupBy("kind", "term").agg(F.sum("n").alias("n")).collect()  # a row for each term of the block
        of = {(r["kind"], r["term"]): r["n"] for r in stats}
        n_docs, n_terms = of.get((0, 0), 0), of.get((1, 0), 0)
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * of.get((2, t), 0) + 1))) for t in range(len(block.vocabulary))], dtype=np.int64)
        found = spark.sparkContext.broadcast((block.terms, weights, n_docs, n_terms))
        passes.append(stored(segments.mapInArrow(_found(found, k), "item_id long, doc_id long, score long"), "found"))
        release(segments)
        shared.unpersist()
        found.unpersist()
    if not passes:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return reduce(DataFrame.unionByName, passes).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def oracle(k: int = 10) -> str:
    """The same rows in DuckDB SQL."""
    terms = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS t FROM documents WHERE text IS NOT NULL),
held AS (SELECT r, doc_id, len(t) AS n, t FROM docs WHERE len(t) > 0),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM held),
wanted AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({terms}) AS term FROM benchmark WHERE item_id IS NOT NULL)),
postings AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM held) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term, n_docs),
shares AS (
  SELECT r, doc_id, p.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS share
  FROM postings p JOIN weights USING (term), totals
),
scores AS (SELECT item_id, r, doc_id, sum(share)::BIGINT AS score FROM wanted JOIN shares USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0 AND doc_id IS NOT NULL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {k}"""
