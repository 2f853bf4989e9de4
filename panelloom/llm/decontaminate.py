r"""Benchmark decontamination: suffix arrays over shards of the training text, binary-searched by every test suffix.

Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z. A window is `n` consecutive words of an item; an item of
fewer words (not none) is one window. A document word inside any occurrence of a window is hit.

A shard is a piece of a task's documents (256 KB of text, or one longer text). Its suffix array holds the suffixes that can
match: those inside runs of bigrams that some test item has; it is searched for the items that have one of those bigrams. Ranks of the first 1, 2, 4, 8, 16 ... words come from prefix doubling over
shard and test words together, until they cover a window and either tell all suffixes of the shard apart or cover the
longest possible match; so one argsort gives the array, two binary searches give all occurrences of a test window, and comparing words from the neighbours on gives each test suffix's longest verbatim match and its place.

The test items are the stated query set: they are read in blocks of at most `block_words` words, whose size bounds the
broadcast, and each block passes over all documents. With several blocks each pass is written before the next block is read,
so that the driver has one block at a time.

Nulls and edges: null or wordless texts and items have no words, so no hit; repeated item rows count once by id; null item
ids are ignored; repeated documents keep a row each; texts of any length are searched whole; of equally long matches the
first in order is told; other columns are ignored by `contamination`, whatever their names, and kept by `decontaminate`;
empty tables give an empty, or an untouched, result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.frames import ship_package, stored
from panelloom.llm.words import ALNUM, Words, chunks, ngrams, words

#: Words of test items in one block: about 16 MB of broadcast data.
BLOCK_WORDS = 1_000_000

_SPAN = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("item_at", pa.int32()), ("doc_at", pa.int32()), ("n_words", pa.int32())]))
_RESULT = "row long, doc_id long, n_words long, spans array<struct<first:int,last:int>>, items array<long>, longest array<struct<item_id:long,item_at:int,doc_at:int,n_words:int>>"


def _longest_run(words: np.ndarray) -> int:
    """Words between two zeros, at most."""
    return int(np.diff(np.flatnonzero(np.concatenate(([0], words, [0])) == 0)).max()) - 1


class TestBlock:
    """Words of some test items, ready to be searched for."""

    __test__ = False

    def __init__(self, items: np.ndarray, hashes: np.ndarray, first: np.ndarray, n: int) -> None:
        self.n, self.items, self.hashes, self.first = n, items, hashes, first
        sizes = np.diff(first)
        self.row_of = np.repeat(np.arange(len(sizes)), sizes)
        self.vocabulary = np.unique(hashes)
        bigrams, fits = ngrams(Words(np.zeros(0, np.uint8), first[:0], first[:0], hashes, first), 2)
        at = np.flatnonzero(fits)
        self.bigrams, number = np.unique(bigrams[at], return_inverse=True)
        # rows of each bigram, one after the other
        self.rows = self.row_of[at[np.argsort(number, kind="stable")]]
        self.rows_first = np.append(0, np.cumsum(np.bincount(number, minlength=len(self.bigrams)))).astype(np.int64)
        self.shortest = int(min(n, sizes[sizes > 0].min())) if (sizes > 0).any() else n
        starts, lengths = [], []
        for row, size in enumerate(sizes.tolist()):
            if size:
                count = max(1, size - n + 1)
                starts.append(np.arange(first[row], first[row] + count))
                lengths.append(np.full(count, min(n, size)))
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)

    @classmethod
    def of(cls, items: list[tuple[int, str]], n: int) -> TestBlock:
        w = words(pa.array([t for _, t in items], pa.large_string()), ALNUM, lower=True)
        return cls(np.array([i for i, _ in items], dtype=np.int64), w.hashes, w.first, n)

    def part(self, rows: np.ndarray) -> TestBlock:
        """The block of these rows alone."""
        sizes = np.diff(self.first)[rows]
        at = np.repeat(self.first[rows], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return TestBlock(self.items[rows], self.hashes[at], np.append(0, np.cumsum(sizes)), self.n)

    def find(self, w) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
        """Occurrences (word position, length, item number) in the shard, and longest matches from maximal starts."""
        none = np.zeros(0, np.int64)
        if not len(w.hashes) or not len(self.starts):
            return none, none, none, []
        at, rows = self._candidates(w)
        if not len(at):
            return none, none, none, []
        if rows is not None and len(rows) < len(self.items):
            pos, size, item, longest = self.part(rows)._search(w, at)
            return pos, size, rows[item], [(int(rows[i]), *rest) for i, *rest in longest]
        return self._search(w, at)

    def _search(self, w, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
        vocab = self.vocabulary
        last = np.repeat(w.first[1:], np.diff(w.first))
        # one text: shard words from candidate runs, then test words; 0 separates
        slot = np.searchsorted(vocab, w.hashes[at])
        slot[slot == len(vocab)] = 0
        known = np.where(vocab[slot] == w.hashes[at], slot + 1, 0)
        gap = np.flatnonzero((np.diff(at) != 1) | (last[at[1:]] != last[at[:-1]])) + 1
        shard = np.insert(known, gap, 0)
        place = np.insert(at, gap, -1)
        ends = self.first[1:-1]
        test = np.insert(np.searchsorted(vocab, self.hashes) + 1, ends, 0)
        test_at = np.arange(len(self.hashes)) + np.searchsorted(ends, np.arange(len(self.hashes)), side="right")
        joint = np.concatenate((shard, np.zeros(1, np.int64), test, np.zeros(16, np.int64)))
        base = len(shard) + 1
        ranks, depth = {1: joint}, 1
        array = np.flatnonzero(shard)
        needed, longest = int(self.lengths.max()), min(_longest_run(shard), _longest_run(test))
        while depth < needed or depth < longest and len(np.unique(ranks[depth][array])) < len(array):
            ranks[depth * 2] = self._pair(ranks[depth], depth)
            depth *= 2
        array = array[np.argsort(ranks[depth][array], kind="stable")]
        pos, size, item = [], [], []
        for m in np.unique(self.lengths).tolist():
            rank = self._of_length(ranks, m)
            mine = self.starts[self.lengths == m]
            keys = rank[base + test_at[mine]]
            ordered = rank[array]
            lo, hi = np.searchsorted(ordered, keys, "left"), np.searchsorted(ordered, keys, "right")
            count = hi - lo
            which = np.repeat(np.arange(len(mine)), count)
            found = array[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            pos.append(place[found])
            size.append(np.full(len(found), m))
            item.append(self.row_of[mine[which]])
        return np.concatenate(pos), np.concatenate(size), np.concatenate(item), self._longest(joint, base, test_at, ranks[depth], array, place)

    def _candidates(self, w) -> tuple[np.ndarray, np.ndarray | None]:
        """Positions of words inside runs that a window of the shortest length could start in or cross, and the rows of the
        items that share a bigram with those runs (None: all)."""
        if self.shortest == 1:
            return np.flatnonzero(np.isin(w.hashes, self.vocabulary)), None
        grams, fits = ngrams(w, 2)
        if not len(grams):
            return np.zeros(0, np.int64), None
        slot = np.searchsorted(self.bigrams, grams)
        slot[slot == len(self.bigrams)] = 0
        good = fits & (self.bigrams[slot] == grams)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
        begin, end = edge[::2], edge[1::2]  # bigrams begin..end-1 are good: words begin..end
        keep = end - begin >= self.shortest - 1
        begin, count = begin[keep], end[keep] - begin[keep] + 1
        if not len(begin):
            return np.zeros(0, np.int64), None
        # bigrams of the runs kept, and their items
        inner = np.repeat(begin, count - 1) + np.arange((count - 1).sum()) - np.repeat(np.cumsum(count - 1) - (count - 1), count - 1)
        some = np.unique(slot[inner])
        rows = np.concatenate([self.rows[a:b] for a, b in zip(self.rows_first[some].tolist(), self.rows_first[some + 1].tolist())])
        return np.unique(np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)), np.unique(rows)

    @staticmethod
    def _pair(rank: np.ndarray, shift: int) -> np.ndarray:
        later = np.zeros_like(rank)
        later[: len(rank) - shift] = rank[shift:]
        return np.unique(rank * (int(rank.max()) + 1) + later, return_inverse=True)[1] + 1

    def _of_length(self, ranks: dict[int, np.ndarray], m: int) -> np.ndarray:
        p = 1 << (m.bit_length() - 1)
        return ranks[p] if p == m else self._pair(ranks[p], m - p)

    def _longest(self, joint, base, test_at, rank, array, place) -> list[tuple]:
        """(item number, item position, shard position, words): each test suffix's longest match of a window or more, where it can't be begun a word earlier."""
        keys = rank[base + test_at]
        spot = np.searchsorted(rank[array], keys, "left")
        best = np.zeros(len(keys), np.int64)
        where = np.zeros(len(keys), np.int64)
        for side in (-1, 0):
            idx = spot + side
            ok = (idx >= 0) & (idx < len(array))
            start = array[np.clip(idx, 0, len(array) - 1)]
            length = np.zeros(len(keys), np.int64)
            live = np.flatnonzero(ok)
            while len(live):
                a, b = joint[start[live] + length[live]], joint[np.minimum(base + test_at[live] + length[live], len(joint) - 1)]
                live = live[(a == b) & (a > 0)]
                length[live] += 1
            better = length > best
            best[better], where[better] = length[better], start[better]
        out = []
        for i in np.flatnonzero(best >= self.shortest).tolist():
            if i and self.row_of[i - 1] == self.row_of[i] and best[i - 1] == best[i] + 1:
                continue
            out.append((int(self.row_of[i]), i - int(self.first[self.row_of[i]]), int(place[where[i]]), int(best[i])))
        return out


def _search(block):
    def run(batches):
        test: TestBlock = block.value
        for piece in chunks(batches):
            w = words(piece.column("text"), ALNUM, lower=True)
            pos, size, item, longest = test.find(w)
            cover = np.zeros(len(w.hashes) + 1, np.int64)
            np.add.at(cover, pos, 1)
            np.add.at(cover, pos + size, -1)
            hit = np.cumsum(cover[:-1]) > 0
            rows = piece.num_rows
            spans, items, best = [[] for _ in range(rows)], [[] for _ in range(rows)], [[] for _ in range(rows)]
            row_of = w.row_of
            here = np.flatnonzero(hit)
            if len(here):
                new = np.ones(len(here), bool)
                new[1:] = (np.diff(here) != 1) | (row_of[here[1:]] != row_of[here[:-1]])
                begin = here[new]
                end = here[np.append(np.flatnonzero(new)[1:] - 1, len(here) - 1)]
                for a, b in zip(begin.tolist(), end.tolist()):
                    r = int(row_of[a])
                    spans[r].append({"first": a - int(w.first[r]), "last": b - int(w.first[r])})
                for r, i in sorted(set(zip(row_of[pos].tolist(), test.items[item].tolist()))):
                    items[r].append(i)
                for i, item_at, at, n in longest:
                    r = int(row_of[at])
                    best[r].append({"item_id": int(test.items[i]), "item_at": item_at, "doc_at": at - int(w.first[r]), "n_words": n})
            yield pa.RecordBatch.from_arrays(
                [piece.column("row"), piece.column("doc_id"), pa.array(np.diff(w.first).astype(np.int64)), pa.array(spans, _SPAN), pa.array(items, pa.list_(pa.int64())), pa.array(best, _MATCH)],
                names=["row", "doc_id", "n_words", "spans", "items", "longest"],
            )

    return run


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """Test items, a bounded number of bytes at a time (at most ten bytes a word counted)."""
    out: list[tuple[int, str]] = []
    room = block_words * 10
    for r in items.toLocalIterator():
        if out and len(r.text) > room:
            yield out
            out, room = [], block_words * 10
        out.append((r.item_id, r.text))
        room -= len(r.text)
    yield out


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, spans, items (sorted ids of items with occurring windows), longest matches, contaminated."""
    spark = docs.sparkSession
    ship_package(spark)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    text = F.col(text_col)
    base = docs.select(F.xxhash64(text).alias("row"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    blocks = _blocks(items, block_words)
    first, second = next(blocks), next(blocks, None)
    search = lambda block: base.mapInArrow(_search(spark.sparkContext.broadcast(TestBlock.of(block, n))), _RESULT)
    if second is None:
        found = search(first)
        covered = F.expr("aggregate(spans, 0L, (a, s) -> a + s.last - s.first + 1)")
    else:
        # rows that repeat an id and a text are told once by each pass, and are as many as before in the end
        keys = ["row", "doc_id"]
        passes = [stored(search(block).groupBy(*keys).agg(*(F.any_value(c).alias(c) for c in ("n_words", "spans", "items", "longest"))), "pass") for block in chain((first, second), blocks)]
        found = reduce(DataFrame.unionByName, passes).groupBy(*keys).agg(F.max("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "longest")))
        many = base.groupBy(*keys).agg(F.count("*").alias("n"))
        same = (found["row"] == many["row"]) & found["doc_id"].eqNullSafe(many["doc_id"])
        found = found.join(many, same).select(found["*"], F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
        covered = F.expr("size(array_distinct(flatten(transform(spans, s -> sequence(s.first, s.last)))))")
    return found.select(
        "doc_id", "n_words", covered.cast("long").alias("n_hit"), "spans", F.array_sort(F.array_distinct("items")).alias("items"), "longest", (F.size("spans") > 0).alias("contaminated")
    )


def longest_matches(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(item_id, item_at, n_words, doc_id, doc_at): the longest verbatim match in all docs of each item's suffix, and a place of it,
    where it has `n` words or holds the whole of a shorter item, and no match that begins earlier in the item ends as late.

    Shards tell their own longest matches; the longest of them all is that of the table, however it was dealt. Rows that repeat an
    item id are told as one item."""
    size = F.regexp_count(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    least = items.select(F.col("item_id").cast("long").alias("item_id"), size.alias("size")).groupBy("item_id").agg(F.min(F.least("size", F.lit(n))).alias("least"))
    told = contamination(docs, items, n, id_col, text_col, block_words).select("doc_id", F.explode("longest").alias("m")).select("m.item_id", "m.item_at", (-F.col("m.n_words")).alias("less"), "doc_id", "m.doc_at")
    best = told.groupBy("item_id", "item_at").agg(F.min(F.struct("less", "doc_id", "doc_at")).alias("b")).select("item_id", "item_at", (-F.col("b.less")).alias("n_words"), "b.doc_id", "b.doc_at")
    earlier = Window.partitionBy("item_id").orderBy("item_at").rowsBetween(Window.unboundedPreceding, -1)
    best = best.join(least, "item_id").filter("n_words >= least").withColumn("_end", F.max(F.col("item_at") + F.col("n_words")).over(earlier))
    return best.filter("_end IS NULL OR _end < item_at + n_words").select("item_id", "item_at", "n_words", "doc_id", "doc_at")


def _clean(block, column: str):
    def run(batches):
        test: TestBlock = block.value
        for piece in chunks(batches, column):
            w = words(piece.column(column), ALNUM, lower=True)
            pos, _, _, _ = test.find(w)
            keep = np.ones(piece.num_rows, bool)
            keep[w.row_of[pos]] = False
            yield piece.filter(pa.array(keep))

    return run


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the rows that hold a window of a test item; all columns stay, and nothing is shuffled."""
    spark = docs.sparkSession
    ship_package(spark)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    for k, block in enumerate(_blocks(items, block_words)):
        if k:  # one block is searched for at a time
            docs = stored(docs, "pass")
        docs = docs.mapInArrow(_clean(spark.sparkContext.broadcast(TestBlock.of(block, n)), text_col), docs.schema)
    return docs
