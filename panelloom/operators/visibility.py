"""Whole visibility graphs of long series, from blocks whose summaries meet instead of their points.

A block of BLOCK steps settles the edges between its own points. What a block tells the others is small: for natural visibility
its upper hull, for horizontal visibility its top; for random series a few points. Each point keeps what bars its view to the
right inside its block (the steepest slope, or the highest value, after it) and to the left (the flattest slope to it, or the
highest value before it). A block then looks along the summaries of the later ones and finds, for each of its points, the
blocks that it may see into; points whose slope nothing further on can beat are dropped at once. These departures meet the
points of the block that can be seen from outside by an equi-join, where both sides' bars decide.

Slopes within a rounding error of a bar are settled by the written formula over all points between; exactly straight
stretches across blocks are all such ties, and cost the square of their length.

Work: n BLOCK comparisons inside blocks, n^2 h / (2 BLOCK^2) summary points of hulls of h points, and about as many joined rows as
edges. A million steps are some 500 blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.session import ship_package, stored

#: Steps of a block, and points whose views are computed at once.
BLOCK = 2048
_ROWS = 128
#: Share of the largest value (at least 1) within which slopes count as tied.
TIE = 1e-11


def _formula(x: np.ndarray, i: int, j: int) -> bool:
    """Whether all points between i and j lie under their line, as written."""
    k = np.arange(i + 1, j)
    return bool((x[i + 1 : j] < x[j] + (x[i] - x[j]) * (j - k) / (j - i)).all())


def _inside(x: np.ndarray, kind: str, tie: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges (i, j) inside a block, and each point's bar to the right and to the left."""
    n = len(x)
    after, before = np.full(n, -np.inf), np.full(n, np.inf if kind == "natural" else -np.inf)
    src, dst = [], []
    step = np.arange(n)
    for a in range(0, n, _ROWS):
        i = np.arange(a, min(a + _ROWS, n))
        ahead = step[None, :] > i[:, None]
        if kind == "natural":
            with np.errstate(divide="ignore", invalid="ignore"):
                seen = np.where(ahead, (x[None, :] - x[i, None]) / (step[None, :] - i[:, None]), -np.inf)
            before = np.minimum(before, np.where(ahead, seen, np.inf).min(axis=0))
        else:
            seen = np.where(ahead, x[None, :], -np.inf)
        top = np.maximum.accumulate(seen, axis=1)
        after[i] = top[:, -1]
        bar = np.concatenate((np.full((len(i), 1), -np.inf), top[:, :-1]), axis=1)
        if kind == "natural":
            one, two = np.nonzero(ahead & (seen >= bar - tie))
            tied = np.flatnonzero(seen[one, two] <= bar[one, two] + tie)
            # of the ties, most fall to a neighbour of either end; the others are looked at whole
            p, q = i[one[tied]], two[tied]
            under = lambda k: (x[k] < x[q] + (x[p] - x[q]) * (q - k) / (q - p)) | (k <= p) | (k >= q)  # noqa: E731, B023
            good = under(p + 1) & under(q - 1)
            good[good] = [_formula(x, int(u), int(v)) for u, v in zip(p[good], q[good])]
            keep = np.ones(len(one), bool)
            keep[tied] = good
            one, two = one[keep], two[keep]
        else:
            one, two = np.nonzero(ahead & (bar < np.minimum(x[i, None], x[None, :])))
        src.append(i[one])
        dst.append(two)
    if kind == "horizontal":
        before[1:] = np.maximum.accumulate(x)[:-1]
    return np.concatenate(src), np.concatenate(dst), after, before


def _departures(points: pd.DataFrame, later: pd.DataFrame, kind: str) -> pd.DataFrame:
    """(to, t, x, bar): the later blocks that each point may see into, with what bars its view before them."""
    later = later.sort_values("block")
    out = []
    if len(points) and len(later):
        t, x, bar = points["t"].to_numpy(np.int64), points["x"].to_numpy(float), points["after"].to_numpy(float)
        tie = float(points["tie"].iloc[0])
        rest = np.maximum.accumulate(later["top"].to_numpy(float)[::-1])[::-1]
        end = int(later["until"].max())
        for k, (block, top, begin, ht, hx) in enumerate(zip(later["block"], later["top"], later["since"], later["ht"], later["hx"])):
            if kind == "natural":
                rise = rest[k] - x
                going = np.maximum(rise / (begin - t), rise / (end - t)) >= bar - tie
            else:
                going = bar < x
            t, x, bar = t[going], x[going], bar[going]
            if not len(t):
                break
            if kind == "natural":
                best = ((np.asarray(hx, float)[None, :] - x[:, None]) / (np.asarray(ht, np.int64)[None, :] - t[:, None])).max(axis=1)
                sees = best >= bar - tie
            else:
                best = np.full(len(t), top)
                sees = best > bar
            out.append(pd.DataFrame({"to": np.full(int(sees.sum()), block), "t": t[sees], "x": x[sees], "bar": bar[sees]}))
            bar = np.maximum(bar, best)
    return pd.concat(out) if out else pd.DataFrame({"to": np.zeros(0, np.int64), "t": np.zeros(0, np.int64), "x": np.zeros(0), "bar": np.zeros(0)})


def whole_visibility(series: DataFrame, kind: str, block: int | None = None) -> DataFrame:
    """All visibility edges (series, src, dst, weight), src < dst, of series of any length."""
    ship_package(series.sparkSession)
    size = block or BLOCK
    key = dict(series.dtypes)["series"]
    rows = series.select("series", F.col("t").cast("long").alias("t"), F.col("x").cast("double").alias("x")).withColumn("block", F.floor(F.col("t") / size))
    ties = rows.groupBy("series").agg((TIE * F.greatest(F.lit(1.0), F.max(F.abs("x")))).alias("tie"))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t, x, tie = pdf["t"].to_numpy(np.int64), pdf["x"].to_numpy(float), float(pdf["tie"].iloc[0])
        i, j, after, before = _inside(x, kind, tie)
        states = pd.DataFrame({"t": t, "x": x, "after": after, "before": before, "hull": before > after, "tie": tie})
        edges = pd.DataFrame({"t": t[i], "dst": t[j], "x": x[i], "y": x[j]})
        return pd.concat([states, edges]).assign(series=pdf["series"].iloc[0], block=pdf["block"].iloc[0])[["series", "block", "t", "x", "after", "before", "hull", "tie", "dst", "y"]].astype({"dst": "Int64", "hull": "boolean"})

    shape = f"series {key}, block long, t long, x double, after double, before double, hull boolean, tie double, dst long, y double"
    settled = stored(rows.join(ties, "series").groupBy("series", "block").applyInPandas(settle, shape), "settled")
    points = settled.filter("dst IS NULL")
    near = settled.filter("dst IS NOT NULL").select("series", F.col("t").alias("src"), "dst", "x", "y")

    tops = points.groupBy("series", "block").agg(F.max("x").alias("top"), F.min("t").alias("since"), F.max("t").alias("until"))
    hulls = points.filter("hull").groupBy("series", "block").agg(F.collect_list("t").alias("ht"), F.collect_list("x").alias("hx"))
    told = tops.join(hulls, ["series", "block"]) if kind == "natural" else tops.withColumns({"ht": F.array().cast("array<long>"), "hx": F.array().cast("array<double>")})
    later = told.filter("block > 0").select("series", F.explode(F.expr("sequence(0L, block - 1)")).alias("seer"), "block", "top", "since", "until", "ht", "hx")
    leaving = points if kind == "natural" else points.filter("after < x")

    def leave(key_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _departures(left, right, kind).assign(series=key_[0])[["series", "to", "t", "x", "bar"]]

    seers = leaving.select(F.col("series").alias("of"), F.col("block").alias("at"), "t", "x", "after", "tie")
    away = seers.groupBy("of", "at").cogroup(later.groupBy("series", "seer")).applyInPandas(leave, f"series {key}, to long, t long, x double, bar double")
    away = away.select("series", F.col("to").alias("block"), F.col("t").alias("src"), "x", "bar")

    # points that can be seen from outside at all
    if kind == "natural":
        earlier = Window.partitionBy("series").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        high = tops.select("series", "block", "since", F.max("top").over(earlier).alias("high"))
        open_ = points.join(high, ["series", "block"]).filter("least((x - high) / (t - since + 1), 0D) < before + tie")
    else:
        open_ = points.filter("x > before")
    ends = open_.select("series", "block", F.col("t").alias("dst"), F.col("x").alias("y"), "before", "tie")
    met = away.join(ends, ["series", "block"])
    if kind == "horizontal":
        far = met.filter("greatest(bar, before) < least(x, y)").select("series", "src", "dst", "x", "y")
        return near.unionByName(far).select("series", "src", "dst", F.least("x", "y").alias("weight"))
    met = met.withColumn("slope", F.expr("(y - x) / (dst - src)")).filter("slope >= bar - tie AND slope <= before + tie")
    met = stored(met.select("series", "src", "dst", "x", "y", F.expr("slope > bar + tie AND slope < before - tie").alias("sure")), "met")
    pairs = met.filter("NOT sure").select("series", "src", "dst", "x", "y", F.explode(F.expr(f"sequence(src div {size}, dst div {size})")).alias("block"))
    between = pairs.join(points.select("series", "block", "t", F.col("x").alias("v")), ["series", "block"]).filter("src < t AND t < dst")
    held = between.groupBy("series", "src", "dst", "x", "y").agg(F.bool_and(F.expr("v < y + (x - y) * (dst - t) / (dst - src)")).alias("ok")).filter("ok")
    every = near.unionByName(met.filter("sure").drop("sure")).unionByName(held.drop("ok"))
    return every.select("series", "src", "dst", F.expr("abs((y - x) / (dst - src))").alias("weight"))
