"""Shortest paths of graphs of any size, by frontiers: hops, weighted lengths, and the centralities that follow from them.

A graph is a table (src, dst, weight) with both directions of each edge. Paths of all sources run at once, or of a batch of
them at a time. Each layer of a search is written once, into a folder of its own; nothing is rewritten as paths grow.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.session import release, shared_dir, stored

#: Rounds of a search at most: paths grow by a step, buckets by an edge.
ROUNDS = 10_000


class Layers:
    """Layers of a search over (src, node), each in a partition of one folder."""

    def __init__(self, like: DataFrame, extra: str) -> None:
        self.spark, kind = like.sparkSession, dict(like.dtypes)["src"]
        self.shape = f"src {kind}, node {kind}, {extra}"
        self.folder = f"{shared_dir(self.spark).rstrip('/')}/layers-{uuid.uuid4().hex}"
        self._stored_at = self.folder
        self.sparkSession = self.spark

    def put(self, k: int, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{self.folder}/layer={k}")
        return self.get(k)

    def get(self, k: int) -> DataFrame:
        return self.spark.read.schema(self.shape).parquet(f"{self.folder}/layer={k}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.shape + ", layer int").parquet(self.folder)


def _of_batch(nodes: DataFrame, batch: int, batches: int) -> DataFrame:
    return nodes if batches == 1 else nodes.filter(F.pmod(F.xxhash64("src"), F.lit(batches)) == batch)


def hop_layers(edges: DataFrame, batch: int = 0, batches: int = 1) -> tuple[Layers, DataFrame, int]:
    """Breadth-first layers (src, node, paths) from 1 hop on, the steps, and the number of layers.

    paths is the number of shortest paths. A neighbour of a layer's node lies in the layer, or the one before or after, as edges
    go both ways; so only those two layers are looked at to tell new nodes."""
    step = stored(edges.filter("src <> dst").select("src", "dst").distinct(), "step")
    layers = Layers(edges, "paths double")
    front = layers.put(1, _of_batch(step, batch, batches).select("src", F.col("dst").alias("node"), F.lit(1.0).alias("paths")))
    before = front.limit(0)
    for k in range(2, ROUNDS):
        reached = front.join(step.select(F.col("src").alias("node"), F.col("dst").alias("to")), "node").filter("src <> to").groupBy("src", F.col("to").alias("node")).agg(F.sum("paths").alias("paths"))
        known = front.select("src", "node").union(before.select("src", "node"))
        before, front = front, layers.put(k, reached.join(known, ["src", "node"], "left_anti"))
        if front.isEmpty():
            return layers, step, k - 1
    raise RuntimeError(f"paths of more than {ROUNDS} hops")


def hop_paths(edges: DataFrame) -> DataFrame:
    """(src, dst, hops) of all connected pairs of different nodes.

    The result is quadratic in the size of a component, which all-pairs paths are."""
    layers, step, _ = hop_layers(edges)
    release(step)
    return layers.all().select("src", F.col("node").alias("dst"), F.col("layer").alias("hops"))


def node_centralities(edges: DataFrame, batches: int = 1) -> DataFrame:
    """(node, reach, closeness, eccentricity, betweenness) by hops, of each node with an edge, inside its component.

    Closeness: nodes reached over the sum of their distances. Betweenness: shares of the shortest paths of other nodes that run
    through it, over the (n - 1)(n - 2) ordered pairs of a component of n nodes: counts of paths go out layer by layer,
    dependencies come back. batches: how many parts the sources are searched in, one after the other; a part's layers have a
    row for each of its sources and each node of their components."""
    parts = []
    for batch in range(batches):
        layers, step, last = hop_layers(edges, batch, batches)
        reach = layers.all().groupBy(F.col("src").alias("node")).agg(F.count("*").alias("reach"), F.sum("layer").alias("far"), F.max("layer").alias("eccentricity"))
        back = Layers(edges, "paths double, share double")
        low = layers.get(last).withColumn("share", F.lit(0.0))
        for k in range(last - 1, 0, -1):
            links = low.join(step.select(F.col("src").alias("node"), F.col("dst").alias("to")), "node").select("src", F.col("to").alias("node"), F.expr("(1 + share) / paths").alias("part"))
            gained = links.join(layers.get(k), ["src", "node"]).groupBy("src", "node").agg(F.sum("part").alias("part"), F.first("paths").alias("paths"))
            rest = layers.get(k).join(gained.select("src", "node", "part"), ["src", "node"], "left")
            low = back.put(k, rest.select("src", "node", "paths", (F.col("paths") * F.coalesce("part", F.lit(0.0))).alias("share")))
        between = back.all().groupBy("node").agg(F.sum("share").alias("between")) if last > 1 else reach.select("node", F.lit(0.0).alias("between")).limit(0)
        done = stored(reach.withColumn("between", F.lit(0.0)).unionByName(between.withColumns({"reach": F.lit(0).cast("long"), "far": F.lit(0).cast("long"), "eccentricity": F.lit(0)})), "central")
        release(step, layers, *([back] if last > 1 else []))
        parts.append(done)
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    each = rows.groupBy("node").agg(F.sum("reach").alias("reach"), F.sum("far").alias("far"), F.max("eccentricity").alias("eccentricity"), F.sum("between").alias("between")).filter("reach > 0")
    return each.select("node", "reach", (F.col("reach") / F.col("far")).alias("closeness"), "eccentricity", F.coalesce(F.try_divide(F.col("between"), F.col("reach") * (F.col("reach") - 1)), F.lit(0.0)).alias("betweenness"))


def weighted_paths(edges: DataFrame, batches: int = 1) -> DataFrame:
    """(src, dst, length) of the shortest paths between different connected nodes, an edge being 1 / weight long.

    Delta stepping with the longest edge as the width of a bucket: all pairs whose length lies in the next bucket are relaxed
    until none improves, then written for good. Only the tentative pairs ahead are rewritten, and new lengths are held against
    the buckets of the last edge's length, as nothing else lies next to them. Edges without a positive weight lead nowhere."""
    links = stored(edges.filter("src <> dst AND weight > 0").groupBy("src", "dst").agg(F.min(1 / F.col("weight")).alias("len")), "links")
    width = links.agg(F.max("len")).first()[0]
    out = Layers(edges, "d double")
    if width is None:
        return out.put(0, links.limit(0).select("src", F.col("dst").alias("node"), F.col("len").alias("d"))).select("src", F.col("node").alias("dst"), F.col("d").alias("length"))
    step = links.select(F.col("src").alias("node"), F.col("dst").alias("to"), "len")
    k = 0
    for batch in range(batches):
        ahead = stored(_of_batch(links.select("src").distinct(), batch, batches).select("src", F.col("src").alias("node"), F.lit(0.0).alias("d"), F.lit(True).alias("fresh")), "ahead")
        settled: list[tuple[float, DataFrame]] = []
        for _ in range(ROUNDS):
            low = ahead.agg(F.min("d")).first()[0]
            if low is None:
                break
            top = low + width
            near = [df for high, df in settled if high > low - width * (1 + 1e-9)]
            while True:
                fresh = ahead.filter(F.col("fresh") & (F.col("d") < top))
                if fresh.isEmpty():
                    break
                found = fresh.join(step, "node").groupBy("src", F.col("to").alias("node")).agg(F.min(F.col("d") + F.col("len")).alias("e"))
                for df in near:
                    found = found.join(df.select("src", "node"), ["src", "node"], "left_anti")
                better = F.col("e").isNotNull() & (F.col("d").isNull() | (F.col("e") < F.col("d")))
                waits = F.coalesce(F.col("fresh") & (F.col("d") >= top), F.lit(False))
                merged = ahead.join(found, ["src", "node"], "full").select("src", "node", F.when(better, F.col("e")).otherwise(F.col("d")).alias("d"), (better | waits).alias("fresh"))
                old, ahead = ahead, stored(merged, "ahead")
                release(old)
            settled = [(h, df) for h, df in settled if h > low - width * (1 + 1e-9)] + [(top, out.put(k, ahead.filter(F.col("d") < top).select("src", "node", "d")))]
            k += 1
            old, ahead = ahead, stored(ahead.filter(F.col("d") >= top), "ahead")
            release(old)
        else:
            raise RuntimeError(f"paths of more than {ROUNDS} buckets")
        release(ahead)
    release(links)
    return out.all().filter("src <> node").select("src", F.col("node").alias("dst"), F.col("d").alias("length"))


def weighted_nodes(paths: DataFrame) -> DataFrame:
    """(node, reach, closeness, eccentricity, mean_length) by weighted length, of the pairs that weighted_paths gives."""
    each = paths.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("reach"), F.sum("length").alias("far"), F.max("length").alias("eccentricity"))
    return each.select("node", "reach", (F.col("reach") / F.col("far")).alias("closeness"), "eccentricity", (F.col("far") / F.col("reach")).alias("mean_length"))
