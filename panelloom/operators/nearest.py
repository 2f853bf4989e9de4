"""Nearest neighbours of the delay vectors of long series, in every dimension at once, by cells of values.

Points are dealt into cells by the quantiles of their first coordinates, and cells into blocks of about BLOCK points, however
many a cell has. A block is known by its bounding box: two boxes tell how near two of their points may be, and how far apart
they are at most. The farthest that a block's points can be from their nearest neighbours (in their own block, or in the box
that bounds it best) proves which other blocks can't hold a nearest neighbour; the others meet it, each pair in one task's
reach. In dimensions where that proves too little, as in many dimensions of noise, the caller seeks otherwise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.session import release, ship_package, stored

#: Points of a block; quantiles that a coordinate is cut at, at most; coordinates that make a cell.
BLOCK = 512
SIDES = 32
CELL = 3
#: Boxes of a tile of boxes that are held against another's; other blocks that a block meets in one group.
TILE = 512
TOGETHER = 16
#: Share of all pairs of blocks that may be left for a dimension to be worth its cells.
WORTH = 0.25


def _stack(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, width))


def _box(pdf: pd.DataFrame, max_dim: int) -> tuple:
    """A block's least and largest coordinates, how many points it has in each dimension, and how far their nearest neighbours
    in the block are at most (infinite: one point alone; -1: no point)."""
    v = _stack(pdf["v"], max_dim + 1)
    held = (~np.isnan(v)).sum(axis=0)
    dist, bound = np.zeros((len(v), len(v))), []
    np.fill_diagonal(dist, np.inf)
    for d in range(1, max_dim + 1):
        dist = np.fmax(dist, np.abs(v[:, d - 1][:, None] - v[:, d - 1][None, :]))
        ok = ~np.isnan(v[:, d])
        bound.append(float(dist[np.ix_(ok, ok)].min(axis=1).max()) if ok.any() else -1.0)
    return np.fmin.reduce(v, axis=0), np.fmax.reduce(v, axis=0), held, bound


def _boxes(pdf: pd.DataFrame, max_dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _stack(pdf["lo"], max_dim + 1), _stack(pdf["hi"], max_dim + 1), _stack(pdf["held"], max_dim + 1) > 0


def _farthest(left: pd.DataFrame, right: pd.DataFrame, max_dim: int) -> np.ndarray:
    """For each box on the left and each dimension: how far the best other box's points are at most."""
    lo1, hi1, _ = _boxes(left, max_dim)
    lo2, hi2, held = _boxes(right, max_dim)
    same = left["block"].to_numpy()[:, None] == right["block"].to_numpy()[None, :]
    far, out = np.where(same, np.inf, 0.0), []
    for k in range(max_dim):
        far = np.fmax(far, np.fmax(hi2[:, k][None, :] - lo1[:, k][:, None], hi1[:, k][:, None] - lo2[:, k][None, :]))
        out.append(np.where(held[:, k + 1][None, :], far, np.inf).min(axis=1))
    return np.stack(out, axis=1)


def _meeting(left: pd.DataFrame, right: pd.DataFrame, max_dim: int) -> pd.DataFrame:
    """Pairs of blocks that aren't proven apart, with the dimensions that this holds for as bits."""
    lo1, hi1, held1 = _boxes(left, max_dim)
    lo2, hi2, held2 = _boxes(right, max_dim)
    bound = _stack(left["bound"], max_dim)
    gap, bits = np.zeros((len(left), len(right))), np.zeros((len(left), len(right)), np.int64)
    for k in range(max_dim):
        gap = np.fmax(gap, np.fmax(lo2[:, k][None, :] - hi1[:, k][:, None], lo1[:, k][:, None] - hi2[:, k][None, :]))
        near = (gap <= bound[:, k][:, None]) & held1[:, k + 1][:, None] & held2[:, k + 1][None, :]
        bits |= near.astype(np.int64) << (k + 1)
    q, b = np.nonzero(bits)
    return pd.DataFrame({"block": left["block"].to_numpy()[q], "other": right["block"].to_numpy()[b], "dims": bits[q, b]})


def _best(mine: pd.DataFrame, theirs: pd.DataFrame, max_dim: int) -> pd.DataFrame:
    """For each point of a block and each dimension the nearest point of the blocks given: the least step of equally near ones."""
    mine, theirs = mine.sort_values("t"), theirs.sort_values("t")
    t1, v1 = mine["t"].to_numpy(np.int64), _stack(mine["v"], max_dim + 1)
    bound = np.asarray(mine["bound"].iloc[0], float)
    near = np.full((max_dim, len(t1)), np.inf)
    at, more = np.full((max_dim, len(t1)), np.iinfo(np.int64).max), np.zeros((max_dim, len(t1)))
    for _, other in theirs.groupby("other"):
        t2, v2, bits = other["t"].to_numpy(np.int64), _stack(other["v"], max_dim + 1), int(other["dims"].iloc[0])
        dist = np.where(t1[:, None] == t2[None, :], np.inf, 0.0)
        for d in range(1, bits.bit_length()):
            dist = np.fmax(dist, np.abs(v1[:, d - 1][:, None] - v2[:, d - 1][None, :]))
            if not bits >> d & 1:
                continue
            i = np.flatnonzero(~np.isnan(v1[:, d]))
            j = np.flatnonzero(~np.isnan(v2[:, d]))
            part = dist[np.ix_(i, j)]
            best = part.argmin(axis=1)
            found, place = part[np.arange(len(i)), best], t2[j][best]
            new = np.isfinite(found) & ((found < near[d - 1, i]) | ((found == near[d - 1, i]) & (place < at[d - 1, i])))
            i, best = i[new], best[new]
            near[d - 1, i], at[d - 1, i] = found[new], place[new]
            more[d - 1, i] = np.abs(v1[i, d] - v2[j[best], d])
    d, i = np.nonzero(np.isfinite(near) & (near <= bound[:, None]))
    return pd.DataFrame({"dim": (d + 1).astype(np.int32), "t": t1[i], "near": near[d, i], "at": at[d, i], "more": more[d, i]})


def nearest_ahead(series: DataFrame, lag: int, max_dim: int, worth: float = WORTH) -> tuple[DataFrame, DataFrame]:
    """Nearest neighbours by Chebyshev distance of the delay vectors of (series, t, x), steps dense from 0 and no x missing.

    Gives (series, dim, t, near, at, more): the distance and step of the nearest other vector in `dim` coordinates (of equally
    near ones the first), among the vectors that have one coordinate more, and their difference in that one; and (series, dims):
    the dimensions that were sought, as bits. The others would need more than the share `worth` of all pairs of blocks.

    What is shuffled are the points of the pairs of blocks left, and boxes: n n / (BLOCK TILE) rows of them."""
    ship_package(series.sparkSession)
    key = dict(series.dtypes)["series"]
    width = max_dim + 1
    by_time = Window.partitionBy("series").orderBy("t")
    ahead = F.array(*(F.coalesce(F.lead("x", k * lag).over(by_time), F.lit(float("nan"))) for k in range(width)))
    cuts = ", ".join(str(k / SIDES) for k in range(1, SIDES))
    edges = series.groupBy("series").agg(F.expr(f"percentile_approx(x, array({cuts}))").alias("edges"), F.least(F.lit(SIDES), F.ceil(F.cbrt(F.count("*") / BLOCK))).alias("sides"))
    side = lambda k: F.floor(F.size(F.filter("edges", lambda e: e < F.col("v")[k])) * F.col("sides") / SIDES)
    cell = sum((side(k) * SIDES**k for k in range(1, min(CELL, width))), side(0))
    points = series.select("series", F.col("t").cast("long").alias("t"), ahead.alias("v")).join(edges, "series").select("series", "t", "v", cell.alias("cell"))
    sizes = points.groupBy("series", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("pieces"))
    block = F.col("cell") * (1 << 40) + F.pmod(F.xxhash64("t"), F.col("pieces"))
    points = stored(points.join(sizes, ["series", "cell"]).select("series", block.alias("block"), "t", "v"), "points")

    def box(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi, held, bound = _box(pdf, max_dim)
        return pd.DataFrame({"series": [pdf["series"].iloc[0]], "block": [pdf["block"].iloc[0]], "lo": [lo], "hi": [hi], "held": [held], "bound": [bound]})

    told = points.groupBy("series", "block").applyInPandas(box, f"series {key}, block long, lo array<double>, hi array<double>, held array<long>, bound array<double>")
    tiles = F.ceil(F.count("*").over(Window.partitionBy("series")) / TILE)
    told = stored(told.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("block"), F.col("tiles"))), "boxes")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    right = told.select("series", every.alias("i"), F.col("tile").alias("j"), "block", "lo", "hi", "held").groupBy("series", "i", "j")

    def tiled(boxes: DataFrame):
        return boxes.select(F.col("series").alias("of"), F.col("tile").alias("i"), every.alias("j"), "block", "lo", "hi", "held", "bound").groupBy("of", "i", "j").cogroup(right)

    def farthest(key_, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out = _farthest(one, two, max_dim) if len(one) and len(two) else np.zeros((0, max_dim))
        return pd.DataFrame({"series": pd.Series([key_[0]] * len(out), dtype=object), "block": one["block"].to_numpy()[: len(out)], "far": pd.Series(list(out), dtype=object)})

    def meeting(key_, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        return _meeting(one, two, max_dim).assign(series=key_[0])[["series", "block", "other", "dims"]]

    far = tiled(told).applyInPandas(farthest, f"series {key}, block long, far array<double>").groupBy("series", "block").agg(F.array(*(F.min(F.col("far")[k]) for k in range(max_dim))).alias("far"))
    bounded = stored(told.join(far, ["series", "block"]).withColumn("bound", F.zip_with("bound", "far", lambda a, b: F.least(a, b))).drop("far"), "bounded")
    pairs = stored(tiled(bounded).applyInPandas(meeting, f"series {key}, block long, other long, dims long"), "pairs")

    blocks = told.groupBy("series").agg(F.count("*").alias("blocks"))
    shares = pairs.groupBy("series").agg(*(F.sum(F.expr(f"shiftright(dims, {d}) & 1")).alias(f"_{d}") for d in range(1, width))).join(blocks, "series")
    kept = sum((F.when(F.col(f"_{d}") <= worth * F.col("blocks") * F.col("blocks"), F.lit(1 << d)).otherwise(0) for d in range(2, width)), F.when(F.col("_1") <= worth * F.col("blocks") * F.col("blocks"), F.lit(2)).otherwise(0))
    kept = stored(shares.select("series", kept.cast("long").alias("dims")), "dims")

    turn = F.floor((F.row_number().over(Window.partitionBy("series", "block").orderBy("other")) - 1) / TOGETHER)
    left_over = pairs.join(kept.withColumnRenamed("dims", "kept"), "series").withColumn("dims", F.expr("dims & kept")).filter("dims <> 0").select("series", "block", "other", "dims", turn.alias("turn"))
    left_over = stored(left_over, "left")
    bounds = bounded.select("series", "block", "bound")
    mine = left_over.select("series", "block", "turn").distinct().join(bounds, ["series", "block"]).join(points, ["series", "block"])
    theirs = left_over.join(points.select("series", F.col("block").alias("other"), "t", "v"), ["series", "other"])

    def best(key_, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        return _best(one.rename(columns={"t1": "t", "v1": "v"}), two, max_dim).assign(series=key_[0])[["series", "dim", "t", "near", "at", "more"]]

    mine = mine.select(F.col("series").alias("of"), F.col("block").alias("at"), F.col("turn").alias("part"), "bound", F.col("t").alias("t1"), F.col("v").alias("v1")).groupBy("of", "at", "part")
    met = mine.cogroup(theirs.groupBy("series", "block", "turn"))
    found = met.applyInPandas(best, f"series {key}, dim int, t long, near double, at long, more double")
    found = stored(found.groupBy("series", "dim", "t").agg(F.min(F.struct("near", "at", "more")).alias("b")).select("series", "dim", "t", "b.near", "b.at", "b.more"), "found")
    release(points, told, bounded, pairs, left_over)
    return found, kept
