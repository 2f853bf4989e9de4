"""Graphs between the time points of series: k-hop, visibility, recurrence and quantile transitions.

A series table has (series, t, x) with dense steps t from 0. All operators work for each series by itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import exprs
from panelloom.operators.nearest import nearest_ahead
from panelloom.operators.visibility import whole_visibility
from panelloom.session import release, ship_package, stored


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge of each series in both directions, from one pass over the edges."""
    return edges.selectExpr("inline(array(named_struct('series', series, 'src', src, 'dst', dst, 'weight', weight), named_struct('series', series, 'src', dst, 'dst', src, 'weight', weight)))")


def khop(steps: DataFrame, k: int, decay: str = "exponential", undirected: bool = False) -> DataFrame:
    """Edges t -> t + h for 1 <= h <= k inside each series; no join, as steps are dense. A linear decay falls over as many hops
    as the series has, if k is more."""
    if k < 0:
        raise ValueError("k must not be negative")
    last = F.max("t").over(Window.partitionBy("series"))
    hops = steps.withColumn("last", last).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(k))) if k else F.lit(None).cast("int"))
    edges = hops.filter(F.col("t") + F.col("h") <= F.col("last")).select("series", F.col("t").alias("src"), (F.col("t") + F.col("h")).alias("dst"), exprs.decay(decay, F.col("h"), F.least(F.lit(max(k, 1)), F.greatest("last", F.lit(1)))).alias("weight"))
    return both_ways(edges) if undirected else edges


def khop_numbered(steps: DataFrame, k: int, decay: str = "exponential", undirected: bool = False) -> DataFrame:
    """(src, dst, weight) of all series as one graph: step t of the n-th series (in order, from 0) is node n * T + t, with T the
    steps of the longest. A row for each series is numbered in one task."""
    names = steps.select("series").distinct().withColumn("_n", F.row_number().over(Window.orderBy("series")) - 1)
    whole = steps.agg((F.max("t") + 1).alias("_T"))  # one row
    place = lambda c: F.col("_n") * F.col("_T") + F.col(c)
    return khop(steps, k, decay, undirected).join(names, "series").join(F.broadcast(whole)).select(place("src").alias("src"), place("dst").alias("dst"), "weight")


def _ahead(series: DataFrame, limit: int) -> DataFrame:
    """Each point with the next `limit` ones as an array (a window frame, not a join)."""
    frame = Window.partitionBy("series").orderBy("t").rowsBetween(1, limit)
    return series.withColumn("ahead", F.collect_list("x").over(frame))


def visibility(series: DataFrame, kind: str = "natural", limit: int | None = None, undirected: bool = False) -> DataFrame:
    """Visibility edges (series, src, dst, weight), with a limit only between points at most `limit` steps apart.

    Natural: all points between lie under the line of sight (the written formula, exact in its ties); weight |slope|.
    Horizontal: all points between are lower than both; weight: the lower of both."""
    if kind not in ("natural", "horizontal"):
        raise ValueError("kind must be 'natural' or 'horizontal'")
    if limit is None:
        seers = whole_visibility(series, kind)
        return both_ways(seers) if undirected else seers
    rows = _ahead(series, limit)
    if kind == "horizontal":
        seen = "forall(slice(ahead, 1, j - 1), v -> v < x AND v < ahead[j - 1])"
        weight = "least(x, ahead[j - 1])"
    else:
        seen = "forall(sequence(1, j), m -> m = j OR ahead[m - 1] < ahead[j - 1] + (x - ahead[j - 1]) * (j - m) / j)"
        weight = "abs((ahead[j - 1] - x) / j)"
    seers = (
        rows.filter(F.size("ahead") > 0)
        .withColumn("js", F.expr(f"filter(sequence(1, size(ahead)), j -> {seen})"))
        .select("series", "t", "x", "ahead", F.explode("js").alias("j"))
        .select("series", F.col("t").alias("src"), (F.col("t") + F.col("j")).alias("dst"), F.expr(weight).alias("weight"))
    )
    return both_ways(seers) if undirected else seers


def chunked_visibility(series: DataFrame, window: int, stride: int, kind: str = "horizontal", limit: int | None = None) -> DataFrame:
    """Visibility inside chunks [s, s + window) every `stride` steps; an edge of several chunks gets its mean weight."""
    first = F.greatest(F.lit(0), F.floor((F.col("t") - window) / stride) + 1)
    chunks = series.withColumn("chunk", F.explode(F.sequence(first, F.floor(F.col("t") / stride))))
    size = F.count("*").over(Window.partitionBy("series", "chunk"))
    rows = chunks.withColumn("n", size).filter("n >= 3").select(F.struct("series", "chunk").alias("series"), "t", "x")
    edges = visibility(rows, kind, window if limit is None else limit)
    return edges.groupBy(F.col("series.series").alias("series"), F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.avg("weight").alias("weight"))


def takens(series: DataFrame, dim: int, lag: int = 1) -> DataFrame:
    """Time-delay embedding (series, t, v): whole vectors only."""
    if dim < 1 or lag < 1:
        raise ValueError("dim and lag must be positive")
    by_time = Window.partitionBy("series").orderBy("t")
    parts = [F.lead("x", k * lag).over(by_time) for k in range(dim)]
    return series.withColumn("v", F.array(*parts)).withColumn("_end", F.lead("t", (dim - 1) * lag).over(by_time)).filter("_end IS NOT NULL").select("series", "t", "v")


def takens_by(series: DataFrame, dims: DataFrame, lag: int = 1, most: int = 15) -> DataFrame:
    """Time-delay embedding (series, t, v) in each series' own dimension: dims has (series, dim), 1 <= dim <= most."""
    by_time = Window.partitionBy("series").orderBy("t")
    ahead = [F.lead("x", k * lag).over(by_time) for k in range(most)]
    rows = series.withColumn("v", F.array(*ahead)).join(dims, "series").withColumn("v", F.slice("v", F.lit(1), F.col("dim").cast("int")))
    return rows.filter(F.element_at("v", -1).isNotNull()).select("series", "t", "v")


def radii(points: DataFrame, share: float) -> DataFrame:
    """(series, radius): share of the diagonal of each series' bounding box, whatever its dimension."""
    spans = points.select("series", F.posexplode("v").alias("k", "c")).groupBy("series", "k").agg((F.max("c") - F.min("c")).alias("s"))
    return spans.groupBy("series").agg((share * F.sqrt(F.sum(F.col("s") * F.col("s")))).alias("radius"))


#: Points of a block of pairs; parts that a range of distances is cut into; values of a range that are put in order.
PAIR_BLOCK = 512
PARTS = 4096
FEW = 200_000


def pair_distances(points: DataFrame) -> DataFrame:
    """(series, d): Euclidean distances of all pairs of a series' points, which meet by an equi-key in blocks of points."""
    block = F.floor(F.col("t") / PAIR_BLOCK)
    last = points.groupBy("series").agg(F.floor(F.max("t") / PAIR_BLOCK).alias("last"))
    one = points.join(last, "series").select("series", F.col("t").alias("t1"), F.col("v").alias("v1"), block.alias("b1"), F.explode(F.sequence(block, "last")).alias("b2"))
    two = points.select("series", F.col("t").alias("t2"), F.col("v").alias("v2"), block.alias("b2"))
    return one.join(two, ["series", "b2"]).filter("t1 < t2").select("series", exprs.euclidean(F.col("v1"), F.col("v2")).alias("d"))


def order_statistics(values: DataFrame, ranks: DataFrame, few: int = FEW) -> DataFrame:
    """(series, rank, value): the values of given ranks (from 0) among each series' d, exactly, without putting them in order.

    values (series, d) is passed over once a round: each round counts, for the range of values that a rank lies in, how many
    fall into each of PARTS equal parts, and goes on in the part that holds the rank, with its own least and largest value. Ranges
    of at most `few` values, or of one value, end it: those values alone are ordered. What is shuffled is counts, PARTS for a range."""
    ends = values.groupBy("series").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("n"))
    state = stored(ranks.join(ends, "series").filter("rank >= 0 AND rank < n").select("series", "rank", "lo", "hi", F.lit(0).cast("long").alias("below"), "n"), "ranks")
    while True:
        wide = state.filter((F.col("n") > few) & (F.col("lo") < F.col("hi")))
        if wide.isEmpty():
            break
        ranges = wide.select("series", "lo", "hi").distinct()
        part = F.least(F.floor((F.col("d") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS), F.lit(PARTS - 1))
        counts = values.join(ranges, "series").filter("d >= lo AND d <= hi").groupBy("series", "lo", "hi", part.alias("part")).agg(F.count("*").alias("n2"), F.min("d").alias("lo2"), F.max("d").alias("hi2"))
        before = F.coalesce(F.sum("n2").over(Window.partitionBy("series", "lo", "hi").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("before", before)
        inside = wide.join(counts, ["series", "lo", "hi"]).filter("rank >= below + before AND rank < below + before + n2")
        nxt = inside.select("series", "rank", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), (F.col("below") + F.col("before")).alias("below"), F.col("n2").alias("n"))
        old, state = state, stored(state.filter((F.col("n") <= few) | (F.col("lo") == F.col("hi"))).unionByName(nxt), "ranks")
        release(old)
    ready = state.filter("lo = hi").select("series", "rank", F.col("lo").alias("value"))
    short = state.filter("lo < hi")
    held = values.join(short.select("series", "lo", "hi", "below").distinct(), "series").filter("d >= lo AND d <= hi")
    placed = held.select("series", (F.col("below") + F.row_number().over(Window.partitionBy("series", "lo", "hi").orderBy("d")) - 1).alias("rank"), F.col("d").alias("value"))
    return ready.unionByName(short.select("series", "rank").join(placed, ["series", "rank"]).dropDuplicates(["series", "rank"]))


def percentile_radii(points: DataFrame, share: float, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """(series, radius): r_low + share * (r_high - r_low) of the Euclidean distances above 0 of all pairs of a series' points.

    All pairs of time points are what is measured; the percentiles (linear between ranks) are selected by counts."""
    pairs = pair_distances(points).filter("d > 0")
    places = pairs.groupBy("series").agg(F.count("*").alias("n")).select("series", F.explode(F.array(*(F.struct(F.lit(k).alias("end"), ((F.col("n") - 1) * (p / 100)).alias("at")) for k, p in enumerate((low, high))))).alias("e")).select("series", "e.end", "e.at")
    places = stored(places, "places")
    ranks = places.select("series", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    found = stored(order_statistics(pairs, ranks), "found")
    value = lambda name: found.select("series", "rank", F.col("value").alias(name))
    ends = places.withColumns({"r1": F.floor("at"), "r2": F.ceil("at")}).join(value("v1").withColumnRenamed("rank", "r1"), ["series", "r1"]).join(value("v2").withColumnRenamed("rank", "r2"), ["series", "r2"])
    p = ends.select("series", "end", (F.col("v1") + (F.col("v2") - F.col("v1")) * (F.col("at") - F.col("r1"))).alias("p")).groupBy("series").agg(F.max(F.when(F.col("end") == 0, F.col("p"))).alias("lo"), F.max(F.when(F.col("end") == 1, F.col("p"))).alias("hi"))
    return p.select("series", (F.col("lo") + share * (F.col("hi") - F.col("lo"))).alias("radius"))


def neighbours(points: DataFrame, radius: float | DataFrame, theiler: int = -1, euclidean: bool = False, inclusive: bool = False) -> DataFrame:
    """Pairs src < dst of one series with Chebyshev distance < radius and more than `theiler` steps apart.

    radius: a number, or (series, radius). euclidean: by that distance; inclusive: also pairs right at the radius.

    A grid join: cells of the first and last coordinate of width `radius`; a point meets the points of the 3 x 3 cells
    around it by an equi-join, and the exact distance is checked then."""
    if isinstance(radius, DataFrame):
        points = points.join(radius.select("series", F.col("radius").alias("_r")), "series").filter("_r > 0")
    elif radius <= 0:
        raise ValueError("radius must be positive")
    else:
        points = points.withColumn("_r", F.lit(float(radius)))
    cell = lambda c: F.floor(c / F.col("_r"))
    rows = points.withColumns({"c0": cell(F.element_at("v", 1)), "c1": cell(F.element_at("v", -1))})
    one = rows.select("series", F.col("t").alias("src"), F.col("v").alias("v1"), "c0", "c1", "_r")
    two = (
        rows.select("series", F.col("t").alias("dst"), F.col("v").alias("v2"), F.explode(F.expr("sequence(c0 - 1, c0 + 1)")).alias("c0"), "c1")
        .select("series", "dst", "v2", "c0", F.explode(F.expr("sequence(c1 - 1, c1 + 1)")).alias("c1"))
    )
    near = one.join(two, ["series", "c0", "c1"]).filter((F.col("src") < F.col("dst")) & (F.col("dst") - F.col("src") > theiler))
    d = (exprs.euclidean if euclidean else exprs.chebyshev)(F.col("v1"), F.col("v2"))
    return near.filter(d <= F.col("_r") if inclusive else d < F.col("_r")).select("series", "src", "dst")


def diameter(points: DataFrame, dim: int) -> DataFrame:
    """Diagonal of the bounding box of each series' points."""
    spans = [F.pow(F.max(F.col("v")[k]) - F.min(F.col("v")[k]), 2) for k in range(dim)]
    return points.groupBy("series").agg(F.sqrt(sum(spans[1:], spans[0])).alias("diameter"))


#: Dimension where none can be estimated, and what a radius is measured in.
FALLBACK_DIM = 2
SCALES = ("absolute", "diameter", "percentile")


def dimensions(series: DataFrame, lag: int = 1, by_length: bool = False) -> DataFrame:
    """(series, dim): Cao's estimate, where there is none 2, or by the length (a tenth of it, from 3 to 10)."""
    n = series.groupBy("series").agg(F.count("*").alias("n"))
    other = F.least(F.lit(10), F.greatest(F.lit(3), F.floor(F.col("n") / 10))) if by_length else F.lit(FALLBACK_DIM)
    return n.join(cao_dimension(series, lag), "series", "left").select("series", F.coalesce("dim", other).cast("int").alias("dim"))


def recurrence(
    series: DataFrame, radius: float = 0.1, dim: int | None = 2, lag: int = 1, theiler: int = -1, self_loops: bool = False, scale: str = "absolute", low: float = 0.0, high: float = 100.0
) -> DataFrame:
    """Recurrence edges (series, src, dst, weight 1): close points of the embedding.

    dim None: each series' own, as estimated. scale: the radius is absolute; or a share of the diagonal of the points' bounding
    box; or a share of the way between two percentiles of their Euclidean distances, which then decide the edges as well."""
    if scale not in SCALES:
        raise ValueError(f"unknown scale {scale!r}: one of {SCALES}")
    points = takens(series, dim, lag) if dim else takens_by(series, dimensions(series, lag, scale == "percentile"), lag)
    if scale != "absolute":
        radius = radii(points, radius) if scale == "diameter" else percentile_radii(points, radius, low, high)
    edges = neighbours(points, radius, theiler, scale == "percentile", scale == "percentile").withColumn("weight", F.lit(1.0))
    if self_loops:
        edges = edges.unionByName(points.select("series", F.col("t").alias("src"), F.col("t").alias("dst"), F.lit(1.0).alias("weight")))
    return edges


def quantile_bins(series: DataFrame, bins: int) -> DataFrame:
    """bin (from 0) of each point: the number of inner quantile edges (linear interpolation) below it."""
    inner = [k / bins for k in range(1, bins)]
    edges = series.groupBy("series").agg(F.expr(f"percentile(x, array({', '.join(map(str, inner))}))").alias("edges"))
    return series.join(edges, "series").select("series", "t", "x", F.expr("size(filter(edges, e -> e < x))").alias("bin"))


def transitions(binned: DataFrame) -> DataFrame:
    """Bin to bin transition counts and shares of the origin's moves."""
    nxt = F.lead("bin").over(Window.partitionBy("series").orderBy("t"))
    counts = binned.withColumn("to", nxt).filter("to IS NOT NULL").groupBy("series", F.col("bin").alias("src"), F.col("to").alias("dst")).agg(F.count("*").alias("n"))
    return counts.withColumn("weight", F.col("n") / F.sum("n").over(Window.partitionBy("series", "src")))


def quantile_graph(series: DataFrame, bins: int, loops: bool = False) -> DataFrame:
    """Time points of bins that have a transition, all pairs of them, with the transition's share.

    The result has as many rows as such pairs of time points: that is what the graph is."""
    binned = quantile_bins(series, bins)
    edges = transitions(binned).select("series", F.col("src").alias("bin1"), F.col("dst").alias("bin2"), "weight")
    a = binned.select("series", F.col("bin").alias("bin1"), F.col("t").alias("src"))
    b = binned.select("series", F.col("bin").alias("bin2"), F.col("t").alias("dst"))
    out = edges.join(a, ["series", "bin1"]).join(b, ["series", "bin2"]).select("series", "src", "dst", "weight")
    return out if loops else out.filter("src <> dst")


def central(series: DataFrame, points: int) -> DataFrame:
    """The middle `points` steps of each series (all of a shorter one), counted from 0 again."""
    if points < 1:
        raise ValueError("points must be positive")
    n = F.count("*").over(Window.partitionBy("series"))
    first = F.greatest(F.floor(F.col("_n") / 2) - points // 2, F.lit(0))
    rows = series.withColumn("_n", n).withColumn("_from", first).filter((F.col("t") >= F.col("_from")) & (F.col("t") < F.col("_from") + points))
    return rows.select("series", (F.col("t") - F.col("_from")).alias("t"), "x")


def noisy(series: DataFrame, deviation: float | None = None, seed: int = 42) -> DataFrame:
    """Series with normal noise of the given deviation of its scaled values; None: a millionth of the least step between two
    values in order, which parts equal embeddings without moving others. The same seed gives the same noise on any cluster."""
    if deviation is None:
        steps = series.withColumn("_d", F.col("x") - F.lag("x").over(Window.partitionBy("series").orderBy("x"))).groupBy("series").agg((F.min("_d") * 1e-6).alias("_s"))
    else:
        steps = series.groupBy("series").agg((deviation * F.when(F.stddev_pop("x") > 0, F.stddev_pop("x")).otherwise(1.0)).alias("_s"))
    uniform = lambda k: (F.pmod(F.xxhash64("series", "t", F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 0.5) / (1 << 40)
    normal = F.sqrt(-2 * F.ln(uniform(0))) * F.cos(2 * F.pi() * uniform(1))
    return series.join(steps, "series").select("series", "t", (F.col("x") + F.coalesce("_s", F.lit(1e-6)) * normal).alias("x"))


def cao_ratios(series: DataFrame, lag: int = 1, max_dim: int = 15, points: int | None = None, noise: float | str | None = None, short: int | None = None) -> DataFrame:
    """(series, dim, e, e_star): Cao's E(d), the mean stretch of nearest neighbours from d to d + 1 dimensions, and E*(d), their
    mean distance in the coordinate that is new, for d = 1 ... max_dim. Series are scaled to a deviation of 1.

    points: only the middle ones are measured, after scaling. noise: a deviation, or 'auto' for a millionth of the least step.

    Series of more than `short` (SHORT) steps are sought by cells, in the dimensions where cells prove most pairs of blocks apart.
    The others, and shorter series, are dealt into blocks of QUERIES points; a block meets its whole series by an equi-key, one
    block a task at a time."""
    if not 1 <= max_dim <= 60:
        raise ValueError("max_dim must lie in 1 ... 60")
    ship_package(series.sparkSession)
    short = SHORT if short is None else short
    stats = series.groupBy("series").agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
    scaled = series.join(stats, "series").select("series", F.col("t").cast("long").alias("t"), F.try_divide(F.col("x") - F.col("_m"), F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).alias("x"))
    if noise is not None:
        scaled = noisy(scaled, None if noise == "auto" else float(noise))
    if points is not None:
        scaled = central(scaled, points)
    every, by_cells = (1 << (max_dim + 1)) - 2, None
    if series.groupBy("series").count().filter(F.least("count", F.lit(points)) > short if points is not None else F.col("count") > short).isEmpty():
        scaled = scaled.join(scaled.groupBy("series").agg(F.max("t").alias("_last")), "series").withColumn("dims", F.lit(every).cast("long"))
    else:
        scaled = stored(scaled, "scaled")
        long = scaled.join(scaled.groupBy("series").count().filter(F.col("count") > short).select("series"), "series", "left_semi")
        by_cells, sought = nearest_ahead(long, lag, max_dim)
        rest = F.lit(every).bitwiseAND(F.bitwise_not(F.coalesce("dims", F.lit(0).cast("long"))))
        scaled = scaled.join(scaled.groupBy("series").agg(F.max("t").alias("_last")).join(sought, "series", "left").withColumn("dims", rest).filter("dims <> 0"), "series")
    points = scaled.select("series", "t", "x", "dims", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / QUERIES))).alias("block"))
    key = dict(series.dtypes)["series"]

    def stretch(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("t")["x"].to_numpy(float)
        at, dims, out = int(pdf["block"].iloc[0]) * QUERIES, int(pdf["dims"].iloc[0]), []
        for d in range(1, max_dim + 1):
            m = len(x) - d * lag
            mine = np.arange(at, min(at + QUERIES, m))
            if m < 3 or not len(mine) or not dims >> d & 1:
                continue
            dist = np.zeros((len(mine), m))
            for k in range(d):
                now = x[k * lag : k * lag + m]
                np.maximum(dist, np.abs(now[mine, None] - now[None, :]), out=dist)
            dist[np.arange(len(mine)), mine] = np.inf
            best = dist.argmin(axis=1)
            near, more = dist[np.arange(len(mine)), best], np.abs(x[d * lag :][mine] - x[d * lag :][best])
            ok = near >= 1e-15
            out.append((d, int(ok.sum()), float((np.maximum(near, more)[ok] / near[ok]).sum()), len(mine), float(more.sum())))
        return pd.DataFrame([(pdf["series"].iloc[0], *r) for r in out], columns=["series", "dim", "n", "sum", "all", "new"])

    parts = points.groupBy("series", "block").applyInPandas(stretch, f"series {key}, dim int, n long, sum double, all long, new double")
    if by_cells is not None:
        ok = F.col("near") >= 1e-15
        sums = by_cells.groupBy("series", "dim").agg(F.count(F.when(ok, 1)).alias("n"), F.coalesce(F.sum(F.when(ok, F.greatest("near", "more") / F.col("near"))), F.lit(0.0)).alias("sum"), F.count("*").alias("all"), F.sum("more").alias("new"))
        parts = parts.select("series", "dim", "n", "sum", "all", "new").unionByName(sums.filter(F.col("all") >= 3))
    return parts.groupBy("series", "dim").agg(F.try_divide(F.sum("sum"), F.sum("n")).alias("e"), F.try_divide(F.sum("new"), F.sum("all")).alias("e_star"))


#: Steps of a series whose neighbours are sought without cells.
SHORT = 8192
#: Points of a series whose neighbours one task seeks at a time.
QUERIES = 256


def cao_dimension(series: DataFrame, lag: int = 1, max_dim: int = 15, threshold: float = 0.95, change: float = 0.10, points: int | None = None, noise: float | str | None = None) -> DataFrame:
    """Embedding dimension of each series by Cao's ratios E1(d) = E(d + 1) / E(d): the first d from 2 to max_dim - 2 with
    E1 >= threshold and a relative change to E1(d + 1) below `change`; NULL where there is none."""
    if max_dim < 3:
        raise ValueError("max_dim must be over 2")
    order = Window.partitionBy("series").orderBy("dim")
    ratios = cao_ratios(series, lag, max_dim, points, noise).withColumn("e1", F.try_divide(F.lead("e").over(order), F.col("e")))
    ratios = ratios.withColumn("e2", F.lead("e1").over(order))
    good = F.col("dim").between(2, max_dim - 2) & (F.col("e1") >= threshold) & (F.abs(F.col("e2") - F.col("e1")) / F.col("e1") < change)
    found = ratios.groupBy("series").agg(F.min(F.when(good, F.col("dim"))).cast("long").alias("dim"))
    return series.select("series").distinct().join(found, "series", "left")


TECHNIQUES = {
    "naive": khop,
    "chunked": chunked_visibility,
    "visibility": visibility,
    "recurrence": recurrence,
    "quantile": quantile_graph,
}


def build(technique: str, series: DataFrame, **kwargs) -> DataFrame:
    if technique not in TECHNIQUES:
        raise ValueError(f"unknown technique {technique!r}: one of {sorted(TECHNIQUES)}")
    return TECHNIQUES[technique](series, **kwargs)
