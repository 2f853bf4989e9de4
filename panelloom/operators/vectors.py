"""Nearest neighbours and radius graphs of vectors (id, v), by blocks of rows against blocks of rows.

Vectors are dealt into blocks of about BLOCK rows by a hash of the id; every two blocks meet in one task, by an equi-key, and
send only what can be in the answer: the k best of each row, or the pairs within the radius. So a task holds two blocks at a
time, and what is shuffled is n * k * blocks rows instead of n * n. Inside a task a matrix product finds the candidates, with
some slack (Chebyshev neighbours: coordinates coded in one byte, against the k-th distance so far); their distances are then
taken by the written formula.

Cosine neighbours take two steps. A block against itself says how near a row's neighbours must be at least; with these limits each
two blocks meet once for both directions, as products of unit vectors in single precision, tile by tile; where that leaves much
of a tile (near copies), in double precision.

Rows without a vector are left out; cosine distances of a zero vector aren't defined and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.session import ship_package, stored

#: Rows of a block at most, about; fewer where the table is small, so that there are SPREAD blocks.
BLOCK = 32768
SPREAD = 6
#: Rows of the first block that are compared at once: BLOCK columns of eight bytes for each.
_ROWS = 64
#: Chebyshev: rows of a strip and of a tile (their matrix of bytes stays in a core's cache), and rows that give a first bound.
_STRIP, _TILE, _FEW = 64, 2048, 256
#: Cosine: coordinates of a block at most, rows of a strip and of a tile, rows that give a first limit, pairs that are settled at once.
_CELLS, _SIDE, _FIRST, _HELD = 2**21, 1024, 2048, 2**20
METRICS = ("euclidean", "cosine", "chebyshev")


def _near(a: np.ndarray, b: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """A matrix that grows with the distance, and how far it may be off."""
    if metric == "euclidean":
        x, y = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
        return x[:, None] + y[None, :] - 2 * (a @ b.T), 1e-10 * float(x.max(initial=0) + y.max(initial=0))
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            out = 1 - (a @ b.T) / np.sqrt(np.einsum("ij,ij->i", a, a)[:, None] * np.einsum("ij,ij->i", b, b)[None, :])
        return np.where(np.isfinite(out), out, np.inf), 1e-10
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        np.maximum(out, np.abs(a[:, k, None] - b[None, :, k]), out=out)
    return out, 0.0


def _exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows, one by one."""
    if metric == "euclidean":
        return np.sqrt(((a - b) ** 2).sum(axis=1))
    if metric == "cosine":
        return 1 - np.clip((a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))), -1, 1)
    return np.abs(a - b).max(axis=1) if len(a) else np.zeros(0)


def _strips(one: pd.DataFrame, two: pd.DataFrame, metric: str, loops: bool = False) -> Iterator:
    """Rows of the first block, a strip at a time: numbers, matrix, slack, and the exact distances of given places."""
    a, b = np.stack(one["v"].to_numpy()).astype(float), np.stack(two["v2"].to_numpy()).astype(float)
    ia, ib = one["id"].to_numpy(), two["id2"].to_numpy()
    for at in range(0, len(a), _ROWS):
        part = a[at : at + _ROWS]
        near, slack = _near(part, b, metric)
        if not loops:
            near[ia[at : at + _ROWS, None] == ib[None, :]] = np.inf
        yield ia[at : at + _ROWS], ib, near, slack, lambda i, j, part=part: _exact(part[i], b[j], metric)


class _Codes:
    """Coordinates as whole numbers 0 ... 126, by one non-decreasing map for each: so no pair within a distance is lost."""

    def __init__(self, b: np.ndarray) -> None:
        with np.errstate(invalid="ignore", over="ignore"):
            middle, spread = (np.nan_to_num(f(axis=0), nan=0.0, posinf=0.0, neginf=0.0) for f in (b.mean, b.std))
        self.step = 8 * float(spread.max(initial=0)) / 126 or 1.0
        self.base = middle - 63 * self.step

    def of(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", over="ignore"):
            return np.nan_to_num(np.clip(np.floor((x - self.base) / self.step), 0, 126)).astype(np.uint8)

    def within(self, a: np.ndarray, turned: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (row of a, column of the codes, a coordinate a row) that may be at most limit[row] apart in each coordinate."""
        with np.errstate(invalid="ignore", over="ignore"):
            low, high = self.of(a - limit[:, None]), self.of(a + limit[:, None])
        wide = (high - low).max(axis=1, initial=0)
        out, step = np.zeros((len(a), turned.shape[1]), np.uint8), np.empty((len(a), turned.shape[1]), np.uint8)
        for k in range(a.shape[1]):
            np.subtract(turned[k][None, :], low[:, k, None], out=step)  # what is below wraps round to 130 and more
            np.maximum(out, step, out=out)
        return np.divmod(np.flatnonzero(out <= wide[:, None]), turned.shape[1])


def _chebyshev_best(a: np.ndarray, b: np.ndarray, ia: np.ndarray, ib: np.ndarray, k: int, unit: float, loops: bool) -> Iterator:
    """Places in a, places in b, and distances: all that may be among a row's k nearest, or tie with them once rounded.

    A strip of a meets b tile by tile; the k-th distance so far bounds what a tile still has to look at by codes of one byte,
    and the written formula decides about what they leave."""
    size = max(float(np.abs(x[np.isfinite(x)]).max(initial=0)) for x in (a, b))
    more = 1.01 * unit + size * 2.0**-40
    codes = _Codes(b)
    turned = np.ascontiguousarray(codes.of(b).T)
    few = min(len(b), max(_FEW, 2 * k + 2))
    for at in range(0, len(a), _STRIP):
        rows = a[at : at + _STRIP]
        with np.errstate(invalid="ignore"):
            some = np.abs(rows[:, None, :] - b[None, :few, :]).max(axis=2)
        if not loops:
            some[ia[at : at + _STRIP, None] == ib[None, :few]] = np.inf
        limit = np.nan_to_num(np.sort(some, axis=1)[:, k - 1], nan=np.inf, posinf=np.inf) if few >= k else np.full(len(rows), np.inf)
        best, found = np.full((len(rows), k), np.inf), []
        for first in range(0, len(b), _TILE):
            i, j = codes.within(rows, turned[:, first : first + _TILE], limit + more)
            j += first
            with np.errstate(invalid="ignore"):
                d = _exact(rows[i], b[j], "chebyshev")
            real = np.isfinite(d) & (d <= limit[i] + more)
            if not loops:
                real &= ia[at + i] != ib[j]
            i, j, d = i[real], j[real], d[real]
            found.append((i, j, d))
            by = np.lexsort((d, i))
            place = np.arange(len(by)) - np.searchsorted(i[by], i[by])
            by, place = by[place < k], place[place < k]
            nearer = np.full((len(rows), k), np.inf)
            nearer[i[by], place] = d[by]
            best = np.sort(np.concatenate((best, nearer), axis=1), axis=1)[:, :k]
            limit = np.minimum(limit, best[:, -1])
        i, j, d = (np.concatenate(c) for c in zip(*found))
        keep = d <= limit[i] + more
        yield i[keep] + at, j[keep], d[keep]


def _nearest(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of each centre: copies that tie aren't all sent."""
    return rows.sort_values(["dst", "d", "src"]).groupby("dst", sort=False).head(k)


class _Block:
    """Rows whose cosines are defined. limit: cosines below it aren't among a row's k best; source: rows that may be neighbours."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, limit: np.ndarray, source: np.ndarray) -> None:
        with np.errstate(invalid="ignore"):
            v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0))[1][:, None])  # by powers of two: no square over- or underflows
            length = np.sqrt(np.einsum("ij,ij->i", v, v))
        real = np.flatnonzero(np.isfinite(length) & (length > 0))
        by = real[np.lexsort((limit[real], ~source[real]))]  # like limits in one strip, so that its least one says much
        self.at, self.ids, self.v, self.limit, self.source = by, ids[by], v[by], limit[by], source[by]
        self.whole = self.v / length[by, None]
        self.unit = self.whole.astype(np.float32)
        # how far products in single and in double precision may be off, and more: limits are rounded, and so is the formula
        self.slack, self.fine = ((v.shape[1] + 8) * 2.0**-bits for bits in (22, 49))


def _sources(ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Whether a row may be among any row's k nearest: k + 1 copies of it with smaller ids, or k of its own, come before it."""
    rows = pd.DataFrame({"key": pd.factorize(pd.Series([x.tobytes() for x in v], dtype=object))[0], "id": ids, "at": np.arange(len(ids))})
    rows = rows[rows.groupby("key")["at"].transform("size") > k].sort_values(["key", "id"])
    copy = rows.groupby(["key", "id"]).cumcount()
    before = (copy == 0).groupby(rows["key"]).cumsum() - 1
    out = np.ones(len(ids), bool)
    out[rows["at"]] = ((before <= k) & (copy < k)).to_numpy()
    return out


def _places(hit: np.ndarray) -> np.ndarray:
    """np.flatnonzero, eight places at a time: hits are rare."""
    flat = hit.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    some = np.flatnonzero(flat.view(np.uint64))
    word, bit = np.nonzero(flat.reshape(-1, 8)[some])
    return some[word] * 8 + bit


class _Best:
    """The k nearest rows of one block to each row of another, so far."""

    def __init__(self, centres: _Block, others: _Block, k: int, digits: int | None, loops: bool) -> None:
        self.centres, self.others, self.k, self.digits, self.loops = centres, others, k, digits, loops
        self.limit = centres.limit.copy()
        self.tie = 0 if digits is None else 1.01 * 10.0**-digits  # what may still tie once it is rounded
        self.rows = pd.DataFrame({"src": others.ids[:0], "dst": centres.ids[:0], "d": np.zeros(0)})

    def start(self) -> None:
        """Limits by the first rows of the other block."""
        some = self.others.unit[: max(_FIRST, 2 * self.k + 2)]
        for at in range(0, len(self.limit), _SIDE):
            near = self.centres.unit[at : at + _SIDE] @ some.T
            near[:, ~self.others.source[: len(some)]] = -np.inf
            if not self.loops:
                near[self.centres.ids[at : at + _SIDE, None] == self.others.ids[None, : len(some)]] = -np.inf
            if len(some) >= self.k:
                self.limit[at : at + _SIDE] = np.partition(near, -self.k, axis=1)[:, -self.k].astype(float) - self.centres.slack - self.tie

    def add(self, i: np.ndarray, j: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Pairs (row of the centres, row of the others), and what their cosines lie between."""
        keep = (high >= self.limit[i]) & self.others.source[j]
        if not self.loops:
            keep &= self.centres.ids[i] != self.others.ids[j]
        i, j, low, high = i[keep], j[keep], low[keep], high[keep]
        by = np.lexsort((-low, i))
        i, j, low, high = i[by], j[by], low[by], high[by]
        kth = np.arange(len(i)) - np.searchsorted(i, i) == self.k - 1
        self.limit[i[kth]] = np.maximum(self.limit[i[kth]], low[kth] - self.tie)
        keep = high >= self.limit[i]
        i, j = i[keep], j[keep]
        step = max(1, _CELLS // max(1, self.centres.v.shape[1]))
        d = np.concatenate([_exact(self.centres.v[i[at : at + step]], self.others.v[j[at : at + step]], "cosine") for at in range(0, len(i), step)] or [np.zeros(0)])
        rows = pd.DataFrame({"src": self.others.ids[j], "dst": self.centres.ids[i], "d": d if self.digits is None else np.round(d, self.digits)})
        self.rows = _nearest(pd.concat([self.rows, rows]) if len(self.rows) else rows, self.k)


def _meet(a: _Block, b: _Block, one: _Best, two: _Best | None) -> None:
    """All pairs of rows of a and b, tile by tile: b's rows as neighbours of a's in `one`, and a's as those of b's in `two`."""
    product, hit, held = np.empty(_SIDE * _SIDE, np.float32), np.empty(_SIDE * _SIDE, bool), []

    def settle() -> None:
        if held:
            i, j, low, high = (np.concatenate(c) for c in zip(*held))
            held.clear()
            one.add(i, j, low, high)
            if two is not None:
                two.add(j, i, low, high)

    def left_over(near: np.ndarray, over: np.ndarray, at: int, first: int, least: float, off: float) -> tuple:
        """What of a tile may be among the k best of any."""
        place = _places(np.greater_equal(near, near.dtype.type(least - off), out=over))
        i, j = np.divmod(place, near.shape[1])
        i, j, s = i + at, j + first, near.ravel()[place].astype(float)
        keep = s + off >= (one.limit[i] if two is None else np.minimum(one.limit[i], two.limit[j]))
        return i[keep], j[keep], s[keep] - off, s[keep] + off

    for at in range(0, len(a.ids), _SIDE):
        left = a.unit[at : at + _SIDE]
        for first in range(0, len(b.ids), _SIDE):
            right = b.unit[first : first + _SIDE]
            least = one.limit[at : at + _SIDE].min() if b.source[first : first + _SIDE].any() else np.inf
            if two is not None and a.source[at : at + _SIDE].any():
                least = min(least, two.limit[first : first + _SIDE].min())
            if least == np.inf:
                continue
            near, over = (x[: len(left) * len(right)].reshape(len(left), len(right)) for x in (product, hit))
            some = left_over(np.matmul(left, right.T, out=near), over, at, first, least, a.slack)
            if len(some[0]) > near.size // 16:
                some = left_over(a.whole[at : at + _SIDE] @ b.whole[first : first + _SIDE].T, over, at, first, least, a.fine)
            held.append(some)
            if sum(len(x[0]) for x in held) > _HELD:
                settle()
    settle()


def _cosine(vectors: DataFrame, k: int, digits: int | None, loops: bool) -> DataFrame:
    """(src, dst, d): the k nearest of each centre, and some more."""
    spark = vectors.sparkSession
    ship_package(spark)
    kind = dict(vectors.dtypes)["id"]
    rows = vectors.filter("v IS NOT NULL AND id IS NOT NULL").select("id", "v")
    n, wide = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-n // min(BLOCK, max(256, _CELLS // max(1, wide or 1)))), min(SPREAD, n // 2048))
    own = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")

    def inside(part: pd.DataFrame) -> pd.DataFrame:
        """A block's best pairs of its own, and its rows again (v isn't null) with d the limit."""
        ids, v = part["id"].to_numpy(), np.stack(part["v"].to_numpy()).astype(float)
        source = _sources(ids, v, k)
        block = _Block(ids, v, np.full(len(ids), -np.inf), source)
        best = _Best(block, block, k, digits, loops)
        best.start()
        limit = np.full(len(ids), -np.inf)
        limit[block.at] = best.limit
        block = _Block(ids, v, limit, source)  # in the order of the limits
        best = _Best(block, block, k, digits, loops)
        _meet(block, block, best, None)
        again = part.iloc[block.at]
        again = pd.DataFrame({"src": again["id"], "dst": again["id"], "d": best.limit, "v": again["v"], "source": block.source})
        return pd.concat([best.rows.assign(v=None, source=False), again if blocks > 1 else again[:0]])

    def across(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"src": one["id"][:0], "dst": one["id"][:0], "d": np.zeros(0)})
        a = _Block(one["id"].to_numpy(), np.stack(one["v"].to_numpy()).astype(float), one["d"].to_numpy(), one["source"].to_numpy().astype(bool))
        b = _Block(two["id2"].to_numpy(), np.stack(two["v2"].to_numpy()).astype(float), two["d2"].to_numpy(), two["source2"].to_numpy().astype(bool))
        best = _Best(a, b, k, digits, loops), _Best(b, a, k, digits, loops)
        _meet(a, b, *best)
        return pd.concat([x.rows for x in best])

    # twice as many partitions as groups: few of them share one
    met = rows.withColumn("own", own("id")).repartition(2 * blocks, "own").groupBy("own").applyInPandas(inside, f"src {kind}, dst {kind}, d double, v array<double>, source boolean")
    if blocks == 1:
        return met.select("src", "dst", "d")
    met = stored(met, "cosine")
    dealt = met.filter("v IS NOT NULL").withColumn("own", own("dst"))
    one = dealt.filter(F.col("own") < blocks - 1).select(F.col("dst").alias("id"), "v", "d", "source", F.col("own").alias("i"), F.explode(F.sequence(F.col("own") + 1, F.lit(blocks - 1))).alias("j"))
    # names of its own: Spark mixes up the columns of two sides that come from one table
    two = dealt.filter("own > 0").select(F.col("dst").alias("id2"), F.col("v").alias("v2"), F.col("d").alias("d2"), F.col("source").alias("source2"), F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("i2"), F.col("own").alias("j2"))
    one, two = one.repartition(blocks * (blocks - 1), "i", "j"), two.repartition(blocks * (blocks - 1), "i2", "j2")
    crossed = one.groupBy("i", "j").cogroup(two.groupBy("i2", "j2")).applyInPandas(across, f"src {kind}, dst {kind}, d double")
    return met.filter("v IS NULL").select("src", "dst", "d").union(crossed)


def sane(vectors: DataFrame) -> DataFrame:
    """vectors again; ValueError where one holds NaN or infinity, or where all are the same."""
    odd = F.exists("v", lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    first, last, bad = vectors.filter("v IS NOT NULL").agg(F.min("v"), F.max("v"), F.count_if(odd)).first()  # one row
    if bad:
        raise ValueError(f"{bad} vectors hold NaN, infinity or nothing")
    if first is not None and first == last:
        raise ValueError("all vectors are the same")
    return vectors


def _met(vectors: DataFrame, metric: str, half: bool):
    """Both sides of all pairs of blocks: (i, j) with i <= j if half."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}: one of {METRICS}")
    ship_package(vectors.sparkSession)
    rows = vectors.filter("v IS NOT NULL AND id IS NOT NULL").select("id", "v")
    n = rows.count()
    blocks = max(1, -(-n // BLOCK), min(SPREAD, n // 64))
    dealt = rows.withColumn("_own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    others = lambda lo, hi: F.explode(F.sequence(lo, hi))
    first, last = F.lit(0), F.lit(blocks - 1)
    one = dealt.select("id", "v", F.col("_own").alias("i"), others(F.col("_own") if half else first, last).alias("j"))
    # names of its own: Spark mixes up the columns of two sides that come from one table
    two = dealt.select(F.col("id").alias("id2"), F.col("v").alias("v2"), others(first, F.col("_own") if half else last).alias("i2"), F.col("_own").alias("j2"))
    return one.groupBy("i", "j").cogroup(two.groupBy("i2", "j2")), dict(vectors.dtypes)["id"]


def knn(vectors: DataFrame, k: int, metric: str = "euclidean", digits: int | None = None, loops: bool = False) -> DataFrame:
    """(src, dst, d, rank): edges neighbour -> centre for each centre's k nearest (ties by id). digits: distances are rounded
    to that many digits before they are ranked. loops: a centre is one of its own neighbours."""
    rank = F.row_number().over(Window.partitionBy("dst").orderBy("d", "src"))
    if metric == "cosine":
        return _cosine(vectors, k, digits, loops).withColumn("rank", rank).filter(F.col("rank") <= k)
    met, kind = _met(vectors, metric, False)
    unit = 0.0 if digits is None else 10.0**-digits

    def best(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out = []
        if metric == "chebyshev" and len(one) and len(two):
            ia, ib = one["id"].to_numpy(), two["id2"].to_numpy()
            a, b = (np.stack(v.to_numpy()).astype(float) for v in (one["v"], two["v2"]))
            for i, j, d in _chebyshev_best(a, b, ia, ib, k, unit, loops):
                out.append(_nearest(pd.DataFrame({"src": ib[j], "dst": ia[i], "d": d if digits is None else np.round(d, digits)}), k))
            return pd.concat(out)
        for ia, ib, near, slack, exact in _strips(one, two, metric, loops) if len(one) and len(two) else ():
            kth = np.partition(near, min(k, near.shape[1]) - 1, axis=1)[:, min(k, near.shape[1]) - 1]
            # what may still tie with the k-th once it is rounded
            limit = (np.sqrt(np.maximum(kth, 0)) + unit) ** 2 + slack
            i, j = np.nonzero((near <= limit[:, None]) & np.isfinite(near))
            d = exact(i, j)
            out.append(_nearest(pd.DataFrame({"src": ib[j], "dst": ia[i], "d": d if digits is None else np.round(d, digits)}), k))
        return pd.concat(out) if out else pd.DataFrame({"src": one["id"][:0], "dst": one["id"][:0], "d": np.zeros(0)})

    found = met.applyInPandas(best, f"src {kind}, dst {kind}, d double")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def radius_graph(vectors: DataFrame, share: float, metric: str = "euclidean") -> DataFrame:
    """(src, dst, d), src < dst: pairs within min + share * (max - min) of all distances; one pass for those two, one for the pairs."""
    met, kind = _met(vectors, metric, True)

    def ends(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        low, high = [], []
        for _, _, near, slack, exact in _strips(one, two, metric) if len(one) and len(two) else ():
            real = np.isfinite(near)
            if real.any():
                i, j = np.nonzero(real & (near <= near[real].min() + slack))
                low.append(exact(i, j).min())
                i, j = np.nonzero(real & (near >= near[real].max() - slack))
                high.append(exact(i, j).max())
        return pd.DataFrame({"lo": [min(low)], "hi": [max(high)]} if low else {"lo": [], "hi": []})

    lo, hi = met.applyInPandas(ends, "lo double, hi double").agg(F.min("lo"), F.max("hi")).first()
    radius = None if lo is None else lo + share * (hi - lo)

    def within(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ia, ib, near, slack, exact in _strips(one, two, metric) if radius is not None and len(one) and len(two) else ():
            i, j = np.nonzero(near <= (radius * radius if metric == "euclidean" else radius) + slack)
            d = exact(i, j)
            out.append(pd.DataFrame({"a": ia[i], "b": ib[j], "d": d})[d <= radius])
        rows = pd.concat(out) if out else pd.DataFrame({"a": one["id"][:0], "b": one["id"][:0], "d": np.zeros(0)})
        if len(one) and len(two) and one["i"].iloc[0] == one["j"].iloc[0]:
            rows = rows[rows["a"] < rows["b"]]  # a block against itself has each pair twice
        return pd.DataFrame({"src": np.minimum(rows["a"], rows["b"]), "dst": np.maximum(rows["a"], rows["b"]), "d": rows["d"]})

    return met.applyInPandas(within, f"src {kind}, dst {kind}, d double")
