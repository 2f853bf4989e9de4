r"""N-gram Jaccard self-join by adaptive multi-match prefixes, and the connected components of its links.

Words are [^\x20\x09-\x0D]+ after lower-casing A-Z; a document's set holds its distinct n-word shingles (fewer words: the
whole sequence as one). Two documents link when 100 * intersection >= percent * union.

1. A scan gives each document its set's size, a 128-bit fingerprint and a sketch (parities of its shingles'
   numbers in buckets, two to four buckets for each shingle).
   Documents with equal sets are one class, whose smallest id stands for all; only such representatives go on.
2. Shingles that many different sets share are found from counts inside pieces of every partition, summed over all; they
   are put last in the global order of shingles, the more common the later. The list is bounded (HEAVY_LIMIT); the order
   only steers cost, any order gives the same links.
3. A set's prefix has size - needed overlap + l shingles of that order. l starts at 1 and grows with the estimated number
   of candidates behind the prefix; two sets can only link if their prefixes share at least min(l, l') shingles.
4. Buckets (prefix shingles of two sets or more) give candidates. Large groups are contracted first: each bucket compares
   its members with one hub, the member with the fewest rare shingles, which is the middle of a group of near copies. Linked
   members become one component, and buckets of one component are dropped. While comparing all that is left would cost far
   more than its size, hubs go on, and prefixes are made anew from the counts of the buckets left. Then every remaining pair
   of different components that shares enough prefix shingles is verified, so no link between components is lost.
   jaccard_links skips the contraction: every linked pair of classes comes out.
   All pairs of a bucket are held against short sketches as they meet.
5. Candidates whose sketches differ in more bits than a link allows go (sets that differ in d shingles differ in at most d
   parities); for the others the sets themselves are fetched and intersected, shingles being compared by 64-bit hashes.

Nulls and edges: a text that is null or without words has an empty set and links with nothing (n_shingles 0, its own
component); a null id is never linked and its component is null; rows that share an id are one node, and each keeps its
row; texts of any length are one set; equal similarities link alike; other columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.frames import key_bitmap, maybe_in, release, ship_package, stored, without
from panelloom.llm.words import chunks, mix, ngrams, prefix_sums, range_hash, words

#: Shingles that may be ordered by their count: bounds what the driver gathers and broadcasts to 16 MB.
HEAVY_LIMIT = 1_000_000
#: Summed count from which a shingle counts as common.
HEAVY_FROM = 8
#: Estimated candidates from which a prefix is made longer.
COSTLY = 64
#: Shingles of different sets that are counted together inside a task, and sets that a task remembers to emit a prefix once.
COUNTED = 1_000_000
REMEMBERED = 200_000
MOST_EXTRA = 4
#: All pairs of what is left are compared once they are at most so many times its rows; at most so many turns come before.
PAIRS_PER_ROW = 64
TURNS = 6
#: A turn that leaves more of the pairs than this isn't worth another one.
SHRINK = 0.7
#: Longs of the sketches that all pairs of a bucket are held against as they meet.
SHORT = 8

_SCAN = "doc_id long, tag long, n int, f1 long, f2 long, sketch array<long>, token long, cnt long"
_PREFIX = "token long, id long, n int, place int, light int"


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, ascending within a row, and where each row's begin and end."""
    w = words(column, lower=True)
    grams, fits = ngrams(w, n)
    at = np.flatnonzero(fits)
    row = np.searchsorted(w.first, at, side="right") - 1
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = range_hash(prefix_sums(w.hashes), w.first[short], w.first[short + 1])
        hashes, row = np.concatenate((grams[at], whole)), np.concatenate((row, short))
    else:
        hashes = grams[at]
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.searchsorted(row[new], np.arange(len(w.first)))


def _fingerprints(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each row's shingles."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes ^ np.uint64(salt)), out=sums[1:])
        out.append((sums[first[1:]] - sums[first[:-1]]).view(np.int64))
    return out[0], out[1]


def _sketches(hashes: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """Parities of each row's shingles in as many buckets as the power of two from twice the set's size on, in longs of 64;
    halves of a sketch added modulo 2 are the sketch of half the length."""
    sizes = np.diff(first)
    longs = np.maximum(1, 1 << np.ceil(np.log2(np.maximum(2 * sizes, 64))).astype(np.int64) >> 6)
    offset = np.append(0, np.cumsum(longs))
    row = np.repeat(np.arange(len(sizes)), sizes)
    bit = offset[row] * 64 + ((mix(hashes) >> np.uint64(20)).astype(np.int64) & (longs[row] * 64 - 1))
    odd = np.bincount(bit, minlength=int(offset[-1]) * 64) & 1
    return pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), pa.array(np.packbits(odd.astype(bool), bitorder="little").view(np.int64)))


def _scan(n: int):
    names = ["doc_id", "tag", "n", "f1", "f2", "sketch", "token", "cnt"]

    def run(batches):
        seen: set[int] = set()
        kept: list[np.ndarray] = []
        have = 0

        def common():
            tokens, count = np.unique(np.concatenate(kept), return_counts=True)
            some = count >= 2
            k = int(some.sum())
            empty = pa.nulls(k, pa.int64())
            return pa.RecordBatch.from_arrays([empty, empty, pa.nulls(k, pa.int32()), empty, empty, pa.nulls(k, pa.list_(pa.int64())), pa.array(tokens[some].view(np.int64)), pa.array(count[some].astype(np.int64))], names=names)

        for piece in chunks(batches):
            hashes, first = shingle_sets(piece.column("text"), n)
            f1, f2 = _fingerprints(hashes, first)
            sizes = np.diff(first)
            empty = pa.nulls(piece.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("tag"), pa.array(sizes.astype(np.int32)), pa.array(f1), pa.array(f2), _sketches(hashes, first), empty, empty], names=names)
            for r, f in enumerate(f1.tolist()):
                if sizes[r] and f not in seen:
                    seen.add(f)
                    kept.append(hashes[first[r] : first[r + 1]])
                    have += int(sizes[r])
            if have >= COUNTED:
                yield common()
                kept, have = [], 0
                seen.clear()
        if kept:
            yield common()

    return run


def _levels(hashes: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 for ordinary shingles, else about log2 of the count."""
    tokens, level = heavy
    if not len(tokens):
        return np.zeros(len(hashes), np.uint64)
    slot = np.searchsorted(tokens, hashes)
    slot[slot == len(tokens)] = 0
    return np.where(tokens[slot] == hashes, level[slot], 0).astype(np.uint64)


def _prefixes(n: int, percent: int, shared):
    def run(batches):
        heavy = shared.value
        seen: set[tuple[int, int]] = set()
        for piece in chunks(batches):
            hashes, first = shingle_sets(piece.column("text"), n)
            if not len(hashes):
                continue
            f1, _ = _fingerprints(hashes, first)
            sizes = np.diff(first)
            row = np.repeat(np.arange(piece.num_rows), sizes)
            level = _levels(hashes, heavy)
            order = np.lexsort(((level << np.uint64(58)) | (hashes >> np.uint64(6)), row))
            hashes, level = hashes[order], level[order]
            rank = np.arange(len(hashes)) - first[row]
            needed = -(-sizes * percent // 100)
            single = rank < (sizes - needed + 1)[row]
            cost = np.bincount(row, np.where(single & (level > 0), np.exp2(level.astype(float)), 0.0), piece.num_rows)
            light = np.bincount(row, level == 0, piece.num_rows)
            extra = np.minimum(MOST_EXTRA, np.log2(1 + cost / COSTLY).astype(np.int64))
            matches = np.minimum(1 + extra, np.maximum(needed, 1))
            # rows that repeat an id and a set add nothing: a task sends them once, as far as it remembers
            new = np.zeros(piece.num_rows, bool)
            for r, key in enumerate(zip(piece.column("doc_id").to_pylist(), f1.tolist())):
                if key not in seen:
                    seen.add(key)
                    new[r] = True
            if len(seen) > REMEMBERED:
                seen.clear()
            take = (rank < (sizes - needed + matches)[row]) & new[row]
            at = row[take]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[take].view(np.int64)), piece.column("doc_id").take(pa.array(at)), *(pa.array(x.astype(np.int32)) for x in (sizes[at], rank[take] * 8 + matches[at], light[at]))], names=["token", "id", "n", "place", "light"]
            )

    return run


def _sets(n: int):
    def run(batches):
        for piece in chunks(batches):
            hashes, first = shingle_sets(piece.column("text"), n)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], names=["doc_id", "set"])

    return run


def _linked(percent: int):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                batch = whole.slice(at, 100)
                good = []
                for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    if len(x) > len(y):
                        x, y = y, x
                    slot = np.searchsorted(y, x)
                    slot[slot == len(y)] = 0
                    both = int((y[slot] == x).sum()) if len(y) else 0
                    good.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id that each end of links (a, b) can reach; minimum labels with pointer jumps."""
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    last = labels = stored(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("comp").alias("near"))
        low = labels.join(near, labels.id == near.a, "left").select("id", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        low = stored(low, "low")
        jump = low.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        labels = stored(low.join(jump, "comp", "left").select("id", "was", F.least("comp", "next").alias("comp")), "labels")
        done = labels.filter("comp <> was").isEmpty()
        release(low, last)
        last = labels
        if done:
            release(edges)
            return labels.select("id", "comp")


class _Join:
    """One run of the join: classes, sketches, common shingles and buckets."""

    def __init__(self, docs: DataFrame, n: int, percent: int) -> None:
        self.n, self.percent = n, percent
        self.spark = docs.sparkSession
        ship_package(self.spark)
        scanned = stored(docs.mapInArrow(_scan(n), _SCAN), "sets-scan")
        rows = scanned.filter("n IS NOT NULL").drop("token", "cnt")
        real = rows.filter("doc_id IS NOT NULL AND n > 0")
        classes = stored(real.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id")), "classes")
        # each row with its class's id; empty sets and null ids have none
        named = stored(real.select("doc_id", "tag", "n", "f1", "f2").join(classes, ["f1", "f2", "n"]).select("doc_id", "tag", "n", "id"), "named")
        self.rows = named.select("doc_id", "n", "id").unionByName(rows.filter("doc_id IS NULL OR n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("id")))
        copies = stored(named.filter("doc_id <> id").select("doc_id", "tag").distinct(), "copies")
        self.keyed = docs.filter("doc_id IS NOT NULL")
        self.nodes = without(self.keyed, copies, ["doc_id", "tag"])
        self.sketches = stored(without(real.drop("f1", "f2"), copies, ["doc_id", "tag"]).drop("tag").distinct().withColumnRenamed("doc_id", "id"), "sketches")
        # an id with different sets is one node: its classes are linked
        same = named.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("hi")).filter("a < hi").select("doc_id", "a")
        self.same = stored(named.join(same, "doc_id").filter("a < id").select("a", F.col("id").alias("b")).distinct(), "same")
        counts = scanned.filter("token IS NOT NULL").groupBy("token").agg(F.sum("cnt").alias("cnt"))
        self.heavy = self._heaviest(counts)
        release(classes)

    def _heaviest(self, counts: DataFrame) -> DataFrame:
        """At most HEAVY_LIMIT common shingles (token, cnt)."""
        return stored(counts.filter(F.col("cnt") >= HEAVY_FROM).orderBy(F.desc("cnt"), "token").limit(HEAVY_LIMIT), "heavy")

    def buckets(self, ids: DataFrame | None = None) -> DataFrame:
        """Prefix shingles that two nodes or more have (of the given ids only), a row for each node."""
        top = self.heavy.select("token", F.least(F.floor(F.log2("cnt")), F.lit(60)).alias("level")).toPandas()
        tokens = top["token"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(tokens)
        heavy = self.spark.sparkContext.broadcast((tokens[order], top["level"].to_numpy(np.uint64)[order]))
        nodes = self.nodes if ids is None else self._of(self.nodes, ids)
        prefixes = stored(nodes.select("doc_id", "text").mapInArrow(_prefixes(self.n, self.percent, heavy), _PREFIX), "prefixes")
        shared = stored(prefixes.groupBy("token").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("token"), "shared")
        near = maybe_in(prefixes, F.col("token"), key_bitmap(shared, F.col("token"))).filter("_maybe").drop("_maybe")
        out = stored(near.join(shared, "token"), "buckets")
        release(prefixes, shared)
        return out

    @staticmethod
    def _of(docs: DataFrame, ids: DataFrame) -> DataFrame:
        few = maybe_in(docs, F.col("doc_id"), key_bitmap(ids, F.col("doc_id"))).filter("_maybe").drop("_maybe")
        return few.join(ids, "doc_id", "left_semi")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that link."""
        p = self.percent
        side = lambda k: self.sketches.select(F.col("id").alias("ab"[k]), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
        fold = "CASE WHEN size({x}) > size({y}) THEN zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (u, v) -> u ^ v) ELSE {x} END"
        # sets of one size class or two neighbouring ones; others, which only a low percent lets through, aren't judged here
        differ = f"aggregate(zip_with({fold.format(x='s0', y='s1')}, {fold.format(x='s1', y='s0')}, (u, v) -> bit_count(u ^ v)), 0, (u, v) -> u + coalesce(v, 0))"
        bound = f"n0 + n1 - 2 * (({p} * (n0 + n1) + {99 + p}) div {100 + p})"
        near = f"greatest(size(s0), size(s1)) > 2 * least(size(s0), size(s1)) OR {differ} <= {bound}"
        close = pairs.join(side(0), "a").join(side(1), "b").filter(near)
        close = stored(close.select("a", "b").distinct(), "close")
        ends = stored(close.select(F.col("a").alias("doc_id")).union(close.select("b")).distinct(), "ends")
        sets = stored(self._of(self.keyed.select("doc_id", "text"), ends).mapInArrow(_sets(self.n), "doc_id long, set binary"), "sets")
        left = close.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a")
        both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
        links = stored(both.mapInArrow(_linked(p), "a long, b long").distinct(), "links")
        release(sets, ends, close)
        return links

    def _sized(self, pairs: DataFrame, short: bool = False) -> DataFrame:
        """Pairs (a, b) that can link: by size, by shared shingles in the prefixes that the pair's own overlap demands, and by
        what can still come after the last of those; short: and by sketches of at most SHORT longs."""
        p = self.percent
        overlap = f"(({p} * (n1 + n2) + {99 + p}) div {100 + p})"
        need = "least(p1 & 7, p2 & 7)"
        pairs = pairs.filter(f"greatest(n1, n2) * {p} <= least(n1, n2) * 100").filter(f"shiftright(p1, 3) < n1 - {overlap} + {need} AND shiftright(p2, 3) < n2 - {overlap} + {need}")
        if short:  # inside the join, so that a large group that shares shingles but doesn't link makes no rows
            differ = " + ".join(f"bit_count(s{k}1 ^ s{k}2)" for k in range(SHORT))
            pairs = pairs.filter(f"m1 <> m2 OR {differ} <= n1 + n2 - 2 * {overlap}")
        last = lambda k: F.max(F.shiftright(f"p{k}", 3)).alias(f"last{k}")
        grouped = (
            pairs.groupBy("a", "b")
            .agg(F.count("*").alias("hits"), F.min(F.expr(need)).alias("need"), last(1), last(2), F.max("n1").alias("n1"), F.max("n2").alias("n2"))
        )
        most = F.expr("hits + least(n1 - 1 - last1, n2 - 1 - last2)")
        return grouped.filter((F.col("hits") >= F.col("need")) & (most * (100 + p) >= (F.col("n1") + F.col("n2")) * p)).select("a", "b")

    def hub_pairs(self, b: DataFrame, turn: int) -> DataFrame:
        """Each bucket's members against one of them, the one with the fewest rare shingles; later turns take any."""
        rare = F.shiftleft(F.col("light").cast("long"), 40) if turn == 0 else F.lit(0)
        order = rare + F.xxhash64("id", F.lit(turn)).bitwiseAND((1 << 40) - 1)
        hubs = b.withColumn("order", order).groupBy("token").agg(*(F.min_by(c, "order").alias(f"h_{c}") for c in ("id", "n", "place", "comp")), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
        hubs = stored(hubs.filter("c0 < c1").drop("c0", "c1"), "hubs")
        pairs = b.join(hubs, "token").filter("comp <> h_comp")
        flip = F.col("id") > F.col("h_id")
        pick = lambda x, y, name: F.when(flip, F.col(y)).otherwise(F.col(x)).alias(name)
        return self._sized(
            pairs.select(F.least("id", "h_id").alias("a"), F.greatest("id", "h_id").alias("b"), pick("n", "h_n", "n1"), pick("h_n", "n", "n2"), pick("place", "h_place", "p1"), pick("h_place", "place", "p2"))
        )

    def all_pairs(self, b: DataFrame) -> DataFrame:
        """Every pair of different components that can link."""
        fold = f"transform(sequence(0, {SHORT - 1}), i -> CASE WHEN i < size(sketch) THEN aggregate(sequence(i, size(sketch) - 1, {SHORT}), 0L, (u, j) -> u ^ sketch[j]) ELSE 0L END)"
        short = stored(self.sketches.select("id", "n", F.least(F.size("sketch"), F.lit(SHORT)).alias("m"), F.expr(fold).alias("s")), "short")
        b = b.join(short, ["id", "n"])
        side = lambda k: (F.col("n").alias(f"n{k}"), F.col("place").alias(f"p{k}"), F.col("comp").alias(f"c{k}"), F.col("m").alias(f"m{k}"), *(F.col("s")[i].alias(f"s{i}{k}") for i in range(SHORT)))
        x = b.select("token", F.col("id").alias("a"), *side(1))
        y = b.select("token", F.col("id").alias("b"), *side(2))
        near = x.join(y, (x.token == y.token) & (F.col("a") < F.col("b")) & (F.col("c1") != F.col("c2")))
        return self._sized(near, short=True)

    @staticmethod
    def left_over(b: DataFrame, comps: DataFrame | None) -> tuple[DataFrame, float, int]:
        """Rows of buckets that still hold two components, what comparing all their pairs would make, and their number."""
        if comps is not None:
            b = stored(b.drop("comp").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "labelled")
        mixed = b.groupBy("token").agg(F.count("*").alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1").select("token", "m")
        mixed = stored(mixed, "mixed")
        most, rows = mixed.agg(F.sum(F.col("m") * (F.col("m") - 1.0) / 2), F.sum("m")).first()
        kept = stored(b.join(mixed, "token", "left_semi"), "residual")
        if comps is not None:
            release(b)
        return kept, most or 0.0, rows or 0


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("tag"))


def jaccard_links(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every linked pair (a, b), a < b, of different sets; a set stands for its class and is named by the smallest id."""
    join = _Join(_prepared(docs, id_col, text_col), n, percent)
    return join.verify(join.all_pairs(join.buckets().withColumn("comp", F.col("id"))))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", turns: int = TURNS) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest id reachable by links, itself included)."""
    join = _Join(_prepared(docs, id_col, text_col), n, percent)
    links, comps = join.same, None if join.same.isEmpty() else components(join.same)
    first = join.buckets()
    left, most, rows = join.left_over(first.withColumn("comp", F.col("id")), comps)
    release(first)
    renewed = False
    for turn in range(turns):
        if turn and most <= PAIRS_PER_ROW * rows:
            break
        links = links.union(join.verify(join.hub_pairs(left, turn)))
        comps = components(links)
        before, was = left, most
        left, most, rows = join.left_over(left, comps)
        release(before)
        if most > PAIRS_PER_ROW * rows and most > SHRINK * was:  # hubs don't reach what is left
            if renewed:
                break
            # new prefixes from the counts that the buckets really have
            ids = stored(left.select(F.col("id").alias("doc_id")).distinct(), "ids")
            join.heavy = join._heaviest(join.heavy.unionByName(left.groupBy("token").agg(F.count("*").alias("cnt"))).groupBy("token").agg(F.max("cnt").alias("cnt")))
            release(left)
            anew = join.buckets(ids)
            left, most, rows = join.left_over(anew.withColumn("comp", F.col("id")), comps)
            release(anew, ids)
            renewed = True
    if rows:
        found = join.verify(join.all_pairs(left))
        if not found.isEmpty():
            comps = components(links.union(found))
    linked = join.rows.join(comps, "id", "left") if comps is not None else join.rows.withColumn("comp", F.lit(None).cast("long"))
    return linked.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "id", "doc_id")).alias("component_id"))
