"""Approximate nearest neighbours by inner product: inverted lists, whose vectors are scanned by blocks of rotated columns.

1. Fit, on a bounded sample (SAMPLE rows, those with the least hashes of their ids): the centroids of the lists, by k-means, and
   a random rotation. Every vector is indexed; the lists' sizes and spreads are counted over all of them.
2. Equal vectors are one entry with their k + 1 least ids, which is all that a result of k can name: a group of copies, however
   large, is one row of the index, and one query.
3. Probe. A query's k-th best score tau is bounded from below by its k-th best in the sample. How many vectors of a list reach a
   score is estimated from the list's size, centre and spread; the lists with the most are probed until at most MISS of the
   expected hits are left out. On clustered data that is a few lists, on shapeless data it is many.
4. Scan. A list is dealt into pieces of at most PIECE vectors, and its queries into as many chunks. Inner products of rotated
   vectors are summed block of columns by block. Let q', x' be the parts read so far: were the score of x at least tau, the
   partial score would be normal about (score / |q|^2) |q'|^2 with a deviation of |x| sqrt(1 - cos^2) |q'| |q''| / (|q| sqrt(d - 1)),
   as the rotation is random. A candidate whose partial score lies more than Z deviations below that is given up. tau rises with
   what a piece has found. What is left is scored in double precision on the original vectors.

Vectors that are null, zero, or hold null or non-finite components, and rows with a null id, take no part; nor do vectors of
another length than the most frequent one (of equally frequent ones the longest). Rows that repeat an id and a vector count once;
rows that share an id but not the vector are candidates each, but not of each other, and have the result of their first vector.
Ties go to the smaller id; other columns are ignored, whatever their names; an empty table gives an empty result.

The index has at most LISTS lists, as they are fitted on a bounded sample; beyond some 10**6 vectors lists grow with the table,
and so does the scan of each query, as it does for exact search.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.frames import release, ship_package, stored

SAMPLE = 8192
LISTS = 1024
LIST_SIZE = 1024
PIECE = 4096
COLUMNS = 16
MISS = 0.02
Z = 2.6
_SCAN = 1024
_TALK = 64


def _matrix(column: pa.Array, kind: str = "f4") -> np.ndarray:
    """Rows of a column of binary cells of equal lengths."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _floats(column: pa.Array) -> np.ndarray:
    """Rows of a column of float lists of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


def _upper(z: np.ndarray) -> np.ndarray:
    """Share of a normal law above z, within 2e-4."""
    z = np.clip(z, -8, 8)
    return 1 / (1 + np.exp(1.5976 * z + 0.07056 * z**3))


class Index:
    """Centroids and rotation, fitted on a sample, then the sizes and spreads of the lists of all vectors."""

    def __init__(self, sample: np.ndarray, n_rows: int, rounds: int = 10) -> None:
        rng = np.random.default_rng(11)
        self.sample = np.unique(sample, axis=0)
        self.d = d = sample.shape[1]
        n = min(max(n_rows // LIST_SIZE, 1), LISTS, len(self.sample))
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        self.centres = self.sample[rng.choice(len(self.sample), n, replace=False)].astype(np.float64)
        for _ in range(rounds):
            mine = self.nearest(self.sample)
            size = np.bincount(mine, minlength=n)
            total = np.zeros((n, d))
            np.add.at(total, mine, self.sample)
            self.centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], self.centres)
        self.sizes, self.spread = np.zeros(n), np.ones(n)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return ((self.centres**2).sum(axis=1) - 2 * (x.astype(np.float64) @ self.centres.T)).argmin(axis=1)

    def rotated(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.float64) @ self.rotation).astype(np.float32)

    def probes(self, q: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """A lower bound of each query's k-th best score (the sample's 2k-th best, so that given-up candidates leave enough), and
        the lists to probe."""
        q = q.astype(np.float64)
        own = q @ self.sample.T.astype(np.float64)
        least = np.partition(own, -2 * k, axis=1)[:, -2 * k] if len(self.sample) >= 2 * k else np.full(len(q), -np.inf)
        mean = q @ self.centres.T
        sigma = np.linalg.norm(q, axis=1)[:, None] * self.spread[None, :] / math.sqrt(self.d) + 1e-12
        hits = lambda tau: self.sizes * _upper((tau[:, None] - mean) / sigma)
        lo, hi = (mean - 8 * sigma).min(axis=1), (mean + 8 * sigma).max(axis=1)
        for _ in range(40):
            mid = (lo + hi) / 2
            many = hits(mid).sum(axis=1) > k
            lo, hi = np.where(many, mid, lo), np.where(many, hi, mid)
        expected = hits(lo)
        order = np.argsort(-expected, axis=1)
        before = np.cumsum(np.take_along_axis(expected, order, axis=1), axis=1)
        count = (before < (1 - MISS) * before[:, -1:]).sum(axis=1) + 1
        return least, [o[:c] for o, c in zip(order, count)]


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up in the order of the columns."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k].astype(np.float64) * q[:, k].astype(np.float64)
    return out


def _dealt(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each entry's list, rotated vector and squared distance to the centre."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _floats(b.column("v"))
            mine, turned = index.nearest(x), index.rotated(x)
            off = ((x - index.centres[mine]) ** 2).sum(axis=1)
            cells = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("h1"), b.column("h2"), b.column("ids"), pa.array(mine.astype(np.int32)), pa.array(off), cells(x), cells(turned)], names=["h1", "h2", "ids", "list", "off", "x", "turned"])

    return rows


def _asked(shared, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each query with its bound and the lists that it probes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            least, lists = index.probes(_matrix(b.column("x")), k)
            yield pa.RecordBatch.from_arrays([b.column("h1"), b.column("h2"), b.column("x"), b.column("turned"), pa.array(least), pa.array(lists, pa.list_(pa.int32()))], names=["h1", "h2", "x", "turned", "least", "lists"])

    return rows


def _scanned(k: int, z: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best entries of a piece for each query of a chunk, those above its bound."""

    def scan(asked: pa.Table, held: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if asked.num_rows and held.num_rows:
            q0, qt, x0, xt = (_matrix(t[c].combine_chunks()) for t, c in ((asked, "x"), (asked, "turned"), (held, "x"), (held, "turned")))
            d = qt.shape[1]
            cuts = list(range(COLUMNS, d, COLUMNS)) if z < math.inf else []
            q_all, x_all = np.maximum((qt.astype(np.float64) ** 2).sum(axis=1), 1e-300), (xt.astype(np.float64) ** 2).sum(axis=1)
            seen = np.cumsum(qt.astype(np.float64) ** 2, axis=1)
            tau = asked["least"].to_numpy().copy()
            for a in range(0, len(q0), _TALK):
                mine = np.arange(a, min(a + _TALK, len(q0)))
                best = [np.zeros(0) for _ in mine]
                for b in range(0, len(x0), _SCAN):
                    x = np.arange(b, min(b + _SCAN, len(x0)))
                    if not cuts:
                        i, j = np.repeat(mine, len(x)), np.tile(x, len(mine))
                    for step, cut in enumerate(cuts):
                        if step == 0:
                            part = (qt[mine, :cut] @ xt[x, :cut].T).ravel().astype(np.float64)
                            i, j = np.repeat(mine, len(x)), np.tile(x, len(mine))
                        else:
                            part = part + np.einsum("ij,ij->i", qt[i, cut - COLUMNS : cut], xt[j, cut - COLUMNS : cut])
                        t, near = tau[i], seen[i, cut - 1]
                        rest = np.maximum(x_all[j] - t * np.abs(t) / q_all[i], 0)  # |x|^2 (1 - cos^2) at a score of tau
                        floor = t * near / q_all[i] - z * np.sqrt(rest * near * np.maximum(q_all[i] - near, 0) / (q_all[i] * max(d - 1, 1)))
                        keep = np.flatnonzero(part >= floor - 1e-6 * np.sqrt(q_all[i] * x_all[j]))
                        i, j, part = i[keep], j[keep], part[keep]
                    score = _scores(x0[j], q0[i])
                    keep = score >= tau[i]
                    i, j, score = i[keep], j[keep], score[keep]
                    found.append((i, j, score))
                    for r in np.unique(i):
                        top = np.append(best[r - a], score[i == r])
                        best[r - a] = np.partition(top, -k)[-k:] if len(top) > k else top
                        if len(top) >= k:
                            tau[r] = max(tau[r], best[r - a].min())
        i, j, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if found:
            keep = score >= tau[i]
            i, j, score = i[keep], j[keep], score[keep]
        took = asked.select(["h1", "h2"]).take(pa.array(i))
        return pa.table({"h1": took["h1"], "h2": took["h2"], "ids": held["ids"].take(pa.array(j)), "score": pa.array(score, pa.float64())})

    return scan


def _valid(rows: DataFrame) -> DataFrame:
    """(vec_id, v, h1, h2) of the vectors that take part; h1 and h2 tell vectors apart."""
    v = F.transform("embedding", lambda c: c.cast("float"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    told = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists("v", lambda c: c != 0))
    told = told.withColumn("v", F.transform("v", lambda c: c + F.lit(0.0).cast("float")))  # no negative zeros
    return told.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})


def _best(held: DataFrame, asked: DataFrame, index: Index, k: int, z: float) -> DataFrame:
    """(h1, h2, top): each query's k best (r, vec_id, score) of the lists that it probes, written."""
    # pieces of a list, and chunks of its queries, of PIECE rows on the average
    probed = asked.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("n")).collect()  # a row a list
    chunks, pieces = np.ones(len(index.sizes), np.int64), np.maximum(np.ceil(index.sizes / PIECE), 1).astype(np.int64)
    for r in probed:
        chunks[r["list"]] = math.ceil(r["n"] / PIECE)
    number = lambda counts: F.element_at(F.lit(counts.tolist()), F.col("list") + 1)
    right = held.withColumns({"piece": F.pmod("h1", number(pieces)), "of": number(chunks)}).select("list", "piece", F.explode(F.expr("sequence(0, int(of) - 1)")).alias("chunk"), "ids", "x", "turned")
    left = asked.select("h1", "h2", "x", "turned", "least", F.explode("lists").alias("list")).withColumns({"chunk": F.pmod("h2", number(chunks)), "of": number(pieces)})
    left = left.select("list", F.explode(F.expr("sequence(0, int(of) - 1)")).alias("piece"), "chunk", "h1", "h2", "x", "turned", "least")
    keys = [F.col(c).cast("int").alias(c) for c in ("list", "piece", "chunk")]
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_scanned(k, z), "h1 long, h2 long, ids array<long>, score double")
    near = pairs.select("h1", "h2", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    return stored(ranked.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("top")), "top")


def nearest_neighbours(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest of each vector whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    ship_package(spark)
    shape = "query_id long, rank int, vec_id long, score double"
    rows = _valid(vectors)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], shape)
    rows = rows.filter(F.size("v") == sizes["d"])
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(7)), "h1").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    index = Index(_floats(sample), sizes["n"])
    # equal vectors: their k + 1 least ids, cut before the shuffle by the ranking's own limit
    least = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    entries = least.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.array_sort(F.collect_set("vec_id")).alias("ids"))
    fitted = spark.sparkContext.broadcast(index)
    held = stored(entries.mapInArrow(_dealt(fitted), "h1 long, h2 long, ids array<long>, list int, off double, x binary, turned binary"), "vectors")
    for r in held.groupBy("list").agg(F.count("*").alias("n"), F.avg("off").alias("off")).collect():  # a row a list
        index.sizes[r["list"]], index.spread[r["list"]] = r["n"], math.sqrt(max(r["off"], 0.0))
    fitted.unpersist()
    fitted = spark.sparkContext.broadcast(index)
    queries = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "h1", "h2").groupBy("query_id").agg(F.min_by(F.struct("h1", "h2"), F.col("h1")).alias("h")).select("query_id", "h.h1", "h.h2")
    queries = stored(queries, "queries")
    asked = held.join(queries.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").mapInArrow(_asked(fitted, k + 1), "h1 long, h2 long, x binary, turned binary, least double, lists array<int>")
    asked = stored(asked, "asked")
    top = _best(held, asked, index, k + 1, Z)
    short = asked.join(top.filter(F.size("top") > k), ["h1", "h2"], "left_anti")
    if not short.isEmpty():  # rare: too much was given up, or the table has no more; these are scanned whole
        every_list = F.lit([i for i, n in enumerate(index.sizes.tolist()) if n]).cast("array<int>")
        whole = stored(short.withColumns({"least": F.lit(-math.inf), "lists": every_list}), "short")
        top = top.filter(F.size("top") > k).unionByName(_best(held, whole, index, k + 1, math.inf))
    told = queries.join(top, ["h1", "h2"]).select("query_id", F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k).alias("top"))
    out = stored(told.select("query_id", F.posexplode("top").alias("at", "t")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "t.vec_id", "t.score"), "near")
    release(held, queries, asked)
    fitted.unpersist()
    return out


def recall(vectors: DataFrame, found: DataFrame, k: int = 20, every: int = 20) -> float:
    """Share of the true k nearest that was found, by brute force in double precision over blocks of vectors: for tests and figures."""
    rows = _valid(vectors).select("vec_id", "v").toArrow()
    ids, x = rows["vec_id"].to_numpy(), _floats(rows["v"].combine_chunks()).astype(np.float64)
    got: dict[int, set[int]] = {}
    for r in found.select("query_id", "vec_id").collect():
        got.setdefault(r[0], set()).add(r[1])
    hit = all_ = 0
    for q in np.flatnonzero(ids % every == 0):
        score = x @ x[q]
        score[ids == ids[q]] = -np.inf
        order = np.lexsort((ids, -score))[: min(k, int((ids != ids[q]).sum()))]
        hit, all_ = hit + len(got.get(int(ids[q]), set()) & set(ids[order].tolist())), all_ + len(order)
    return hit / max(all_, 1)
