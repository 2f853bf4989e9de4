"""Substring dedup: matching statistics of documents against suffix automata of reference shards.

A window is `min_words` consecutive words of one document. A window is removed from a document if its word sequence also
starts in a document with a smaller id; words covered by a removed window go.

How the work is laid out:

1. Every window picks its smallest hashed k-gram (leftmost of equals) as anchor. Equal windows pick equal anchors, so only
   documents that share an anchor can share a window. Consecutive windows with one anchor form a segment.
2. Equal segments collapse to the one with the smallest id before anything else moves: in the other owners all windows of
   the segment are repeated. This takes copies and common passages, however many rows hold them, by map-side aggregation.
3. Distinct segments of one anchor are a reference shard of at most `shard_segments` segments. Per shard one suffix
   automaton is built in ascending id order; each segment is first streamed through the automaton of the smaller ids, and
   positions whose matching statistic reaches `min_words` mark removed windows, then it is added.
   The automata aren't broadcast to all tasks, since the reference grows with the input; a shard goes to the one task that
   holds the segments which can match it.
4. An anchor with more distinct segments (words at the edge of a very common passage) would make an unbounded shard. Its
   windows are dealt by their own content instead, and the smallest owner of each window decides.

Nulls and edges: a null or short text has no window and keeps its words; a null id is never compared and never removed
from; rows that repeat an id are one document to the rule (equal ids never remove each other) and keep a row each; texts of
any length are read whole (anchors are sought in pieces of PIECE_WORDS windows); an empty table gives an empty result; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.frames import key_bitmap, maybe_in, ship_package, stored
from panelloom.llm.words import chunks, mix, ngrams, prefix_sums, range_hash, sliding_min, words

#: Words of an anchor; windows of 50 words hold 43 of them.
ANCHOR_WORDS = 8
#: Distinct segments of one anchor that a single automaton may hold.
SHARD_SEGMENTS = 256
#: Bits that hold a position while the least gram is sought, and windows of a piece of text for that (a text of any length has pieces).
POSITION_BITS = 22
PIECE_WORDS = 1 << 20

_RUNS = "doc_id long, tag int, anchor long, seg long, start int, n_win int"
_NARROW = "anchor long, seg long, owner long, n_win int, words string"
_WIDE = "anchor long, seg long, owner long, at int, win long"
_MASKS = "anchor long, seg long, mask long"
_RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<first:int,last:int>>, kept string, tag int"


class SuffixAutomaton:
    """Suffix automaton over words; texts are added one after the other."""

    def __init__(self) -> None:
        self.step: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]
        self.last = 0

    def add(self, text) -> None:
        self._extend(object())  # a separator that equals nothing: no match runs across two texts
        for w in text:
            self._extend(w)

    def _extend(self, w) -> None:
        step, link, size = self.step, self.link, self.size
        cur = len(step)
        step.append({})
        size.append(size[self.last] + 1)
        link.append(0)
        p = self.last
        while p >= 0 and w not in step[p]:
            step[p][w] = cur
            p = link[p]
        if p >= 0:
            q = step[p][w]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                twin = len(step)
                step.append(step[q].copy())
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(w) == q:
                    step[p][w] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        self.last = cur

    def statistics(self, text) -> list[int]:
        """For each position the length of the longest match that ends there."""
        step, link, size = self.step, self.link, self.size
        at, have, out = 0, 0, []
        for w in text:
            while at and w not in step[at]:
                at = link[at]
                have = size[at]
            if w in step[at]:
                at = step[at][w]
                have += 1
            out.append(have)
        return out


def _least(grams: np.ndarray, fits: np.ndarray, width: int) -> np.ndarray:
    """Position of the least gram of each window (leftmost of equals); positions take the low POSITION_BITS bits."""
    if len(grams) > 1 << POSITION_BITS:
        raise ValueError(f"more than {1 << POSITION_BITS} grams")
    low = np.uint64((1 << POSITION_BITS) - 1)
    tagged = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    tagged[~fits] = np.uint64(2**64 - 1)
    return (sliding_min(tagged, width) & low).astype(np.int64)


def _window_runs(w, k: int, n: int):
    """Segments: first window, number of windows and anchor, for all windows of a piece."""
    grams, fits = ngrams(w, k)
    if len(w.hashes) < n:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    best = np.concatenate([lo + _least(grams[lo : lo + PIECE_WORDS + n - k], fits[lo : lo + PIECE_WORDS + n - k], n - k + 1) for lo in range(0, len(w.hashes) - n + 1, PIECE_WORDS)])
    at = np.arange(len(best))
    last = np.repeat(w.first[1:], np.diff(w.first))[: len(best)]
    whole = at + n <= last
    new = whole.copy()
    new[1:] &= (best[1:] != best[:-1]) | ~whole[:-1]
    start = np.flatnonzero(new)
    ends = np.flatnonzero(whole & ~np.append(whole[1:] & ~new[1:], False)) + 1
    return start, ends - start, grams[best[start]]


def _runs(n: int, k: int):
    def run(batches):
        for piece in chunks(batches):
            w = words(piece.column("text"))
            start, count, anchor = _window_runs(w, k, n)
            if not len(start):
                continue
            seg = range_hash(prefix_sums(w.hashes), start, start + count + n - 1)
            row = np.searchsorted(w.first, start, side="right") - 1
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").take(take), piece.column("tag").take(take), pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64)), pa.array((start - w.first[row]).astype(np.int32)), pa.array(count.astype(np.int32))],
                names=["doc_id", "tag", "anchor", "seg", "start", "n_win"],
            )

    return run


def _segments(n: int, wide: bool):
    """Texts of wanted segments (narrow shards), or their windows' hashes (wide ones)."""

    def run(batches):
        for piece in chunks(batches):
            w = words(piece.column("text"))
            sums = prefix_sums(w.hashes)
            out: list[tuple] = []
            for row, (owner, wanted) in enumerate(zip(piece.column("doc_id").to_pylist(), piece.column("wanted").to_pylist())):
                first = int(w.first[row])
                for s in wanted:
                    lo = first + s["start"]
                    if wide:
                        at = np.arange(lo, lo + s["n_win"])
                        for i, h in enumerate(mix(range_hash(sums, at, at + n)).view(np.int64).tolist()):
                            out.append((s["anchor"], s["seg"], owner, i, h))
                    else:
                        hi = lo + s["n_win"] + n - 2
                        text = w.data[w.begin[lo] : w.end[hi]].tobytes()
                        out.append((s["anchor"], s["seg"], owner, s["n_win"], b" ".join(text.split()).decode()))
            if out:
                cols = list(zip(*out))
                if wide:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["anchor", "seg", "owner", "at", "win"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["anchor", "seg", "owner", "n_win", "words"])

    return run


def _shard_masks(rows: list[tuple], n: int):
    """Removed windows of each segment of a shard as bits; rows: (seg, owner, words) by ascending owner."""
    automaton, at = SuffixAutomaton(), 0
    while at < len(rows):
        to = at
        while to < len(rows) and rows[to][1] == rows[at][1]:
            to += 1
        texts = [r[2].encode().split() for r in rows[at:to]]
        if at:
            for (seg, _, _), text in zip(rows[at:to], texts):
                mask = 0
                for end, have in enumerate(automaton.statistics(text)):
                    if have >= n:
                        mask |= 1 << (end - n + 1)
                if mask:
                    yield seg, mask
        if to < len(rows):
            for text in texts:
                automaton.add(text)
        at = to


def _match(n: int):
    def run(batches):
        key, rows = None, []

        def flush():
            return [(key, seg, mask) for seg, mask in _shard_masks(rows, n)] if len(rows) > 1 else []

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["anchor", "seg", "mask"])

        for batch in batches:
            found: list[tuple] = []
            for anchor, seg, owner, text in zip(*(batch.column(c).to_pylist() for c in ("anchor", "seg", "owner", "words"))):
                if anchor != key:
                    found += flush()
                    key, rows = anchor, []
                rows.append((seg, owner, text))
            if found:
                yield out(found)
        if found := flush():
            yield out(found)

    return run


def _apply(n: int, marked: bool):
    def run(batches):
        for piece in chunks(batches):
            w = words(piece.column("text"))
            marks = piece.column("marks").to_pylist() if marked else None
            n_words = np.diff(w.first)
            removed, spans, kept = [], [], []
            for row in range(piece.num_rows):
                lo, hi = int(w.first[row]), int(w.first[row + 1])
                gone: list[dict] = []
                text = w.data[w.begin[lo] : w.end[hi - 1]].tobytes().split() if hi > lo else []
                if marked and marks[row]:
                    cover = np.zeros(hi - lo + 1, dtype=np.int32)
                    for m in marks[row]:
                        bits = m["mask"]
                        for i in range(n):
                            if bits >> i & 1:
                                cover[m["start"] + i] += 1
                                cover[m["start"] + i + n] -= 1
                    hit = np.cumsum(cover[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                    gone = [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2])]
                    text = [x for x, h in zip(text, hit.tolist()) if not h]
                removed.append(hi - lo - len(text))
                spans.append(gone)
                kept.append(b" ".join(text).decode())
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.array(kept, pa.string()), piece.column("tag")],
                names=["doc_id", "n_words", "n_removed", "spans", "kept", "tag"],
            )

    return run


def substring_dedup(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, spans (first and last removed word), kept (words left, by one space) and tag
    (Spark's hash of the text, which tells rows of one id apart).

    See the module's docstring for the rule, the layout and the edge cases.
    """
    if not ANCHOR_WORDS < min_words <= ANCHOR_WORDS + 62:
        raise ValueError(f"min_words must be {ANCHOR_WORDS + 1} to {ANCHOR_WORDS + 62}")
    ship_package(docs.sparkSession)
    n = min_words
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.hash(F.col(text_col)).alias("tag"))
    runs = stored(docs.filter("doc_id IS NOT NULL").mapInArrow(_runs(n, ANCHOR_WORDS), _RUNS), "runs")

    # sides of joins are stored first: a plain exchange on both sides lets Spark split the partition of a common anchor
    anchors = runs.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("seg").alias("s0"), F.max("seg").alias("s1")).filter("lo < hi")
    anchors = stored(anchors.select("anchor", (F.col("s0") < F.col("s1")).alias("varied")), "anchors")
    shared = stored(runs.join(anchors, "anchor"), "shared")
    segs = stored(
        shared.groupBy("anchor", "seg").agg(F.min(F.struct("doc_id", "tag", "start")).alias("o"), F.max("doc_id").alias("hi"), F.max("n_win").alias("n_win"), F.max("varied").alias("varied")),
        "segments",
    )
    varied = segs.filter("varied")
    sizes = stored(varied.groupBy("anchor").agg((F.count("*") > shard_segments).alias("wide")), "sizes")
    wanted = stored(
        varied.join(sizes, "anchor").groupBy(F.col("o.doc_id").alias("doc_id"), F.col("o.tag").alias("tag"), "wide").agg(F.collect_list(F.struct("anchor", "seg", F.col("o.start").alias("start"), "n_win")).alias("wanted")),
        "wanted",
    )
    texts = maybe_in(docs, F.col("doc_id"), key_bitmap(wanted, F.col("doc_id"))).filter("_maybe").drop("_maybe").dropDuplicates(["doc_id", "tag"])
    narrow = texts.join(wanted.filter("NOT wide"), ["doc_id", "tag"]).select("doc_id", "text", "wanted").mapInArrow(_segments(n, False), _NARROW)
    by_automaton = narrow.repartition("anchor").sortWithinPartitions("anchor", "owner").mapInArrow(_match(n), _MASKS)
    windows = texts.join(wanted.filter("wide"), ["doc_id", "tag"]).select("doc_id", "text", "wanted").mapInArrow(_segments(n, True), _WIDE)
    windows = stored(windows, "windows")
    least = stored(windows.groupBy("anchor", "win").agg(F.min("owner").alias("least"), F.max("owner").alias("most")).filter("least < most"), "least")
    by_window = windows.join(least, ["anchor", "win"]).filter("owner > least").groupBy("anchor", "seg").agg(F.expr("bit_or(shiftleft(1L, at))").alias("mask"))
    masks = by_automaton.unionByName(by_window)

    owned = stored(
        segs.select("anchor", "seg", F.col("o.doc_id").alias("owner"), "hi")
        .join(masks, ["anchor", "seg"], "left")
        .filter("owner < hi OR mask IS NOT NULL")
        .drop("hi"),
        "owned",
    )
    marks = (
        shared.join(owned, ["anchor", "seg"])
        .withColumn("mask", F.when(F.col("doc_id") > F.col("owner"), F.expr("shiftleft(1L, n_win) - 1")).otherwise(F.col("mask")))
        .filter("mask <> 0")
        .groupBy("doc_id", "tag")
        .agg(F.collect_list(F.struct("start", "mask")).alias("marks"))
    )
    marks = stored(marks, "marks")
    split = maybe_in(docs, F.col("doc_id"), key_bitmap(marks, F.col("doc_id")))
    plain = split.filter("NOT _maybe").select("doc_id", "tag", "text").mapInArrow(_apply(n, False), _RESULT)
    cut = split.filter("_maybe").join(marks, ["doc_id", "tag"], "left").select("doc_id", "tag", "text", "marks").mapInArrow(_apply(n, True), _RESULT)
    return plain.unionByName(cut)
