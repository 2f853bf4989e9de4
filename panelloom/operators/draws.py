"""Seeded random graphs with exactly m of all possible edges, drawn in parallel, and small-world figures against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.operators import profile
from panelloom.operators.paths import hop_paths
from panelloom.session import stored

#: Edge numbers have at most so many bits (some three million nodes), so that products of the bijection fit 64 bits.
MOST_BITS = 42
#: Odd factors of the bijection's rounds, and how often a number above the range is sent on.
FACTORS = (654_321, 1_000_003, 777_767)
WALK = 128


def _shuffled(v: str, bits: int, seed: str) -> str:
    """SQL of a bijection of the numbers of `bits` bits: odd factors, sums and shifts, each of which can be undone."""
    mask, half = (1 << bits) - 1, max(bits // 2, 1)
    for factor in FACTORS:
        v = f"(({v}) * {factor} + {seed}) & {mask}"
        v = f"({v}) ^ shiftright({v}, {half})"
    return v


def random_graphs(spark: SparkSession, nodes: int, edges: int, draws: int = 5, seed: int = 0) -> DataFrame:
    """(draw, src, dst, weight 1), both directions: in each draw exactly `edges` different edges between 0 ... nodes - 1.

    Edge k of a draw is the image of k under a bijection of all nodes (nodes - 1) / 2 edge numbers, so no two are equal and no
    task needs to know of another's: a power of two of numbers is shuffled, and images above the range are shuffled on until
    they fall into it. Numbers become pairs by their place in the triangle."""
    every = nodes * (nodes - 1) // 2
    if not 0 <= edges <= every:
        raise ValueError(f"{nodes} nodes have no {edges} different edges")
    bits = max((max(every, 1) - 1).bit_length(), 2)
    if bits > MOST_BITS:
        raise ValueError(f"more than 2**{MOST_BITS} possible edges")
    rows = spark.range(edges).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("key", F.expr(f"(({int(seed)} + draw) * 48271L + 12345L) & {(1 << 30) - 1}"))
    walk = f"aggregate(sequence(1, {WALK}), {_shuffled('id', bits, 'key')}, (v, _) -> IF(v < {every}, v, {_shuffled('v', bits, 'key')}))"
    number = rows.select("draw", F.expr(walk).alias("e")).withColumn("e", F.when(F.col("e") < every, F.col("e")).otherwise(F.raise_error(F.lit("an edge number did not fall into the range"))))
    j = number.withColumn("j", F.expr("CAST(floor((1 + sqrt(1 + 8D * e)) / 2) AS BIGINT)"))
    j = j.withColumn("j", F.expr("IF(j * (j - 1) / 2 > e, j - 1, IF(j * (j + 1) / 2 <= e, j + 1, j))"))
    pairs = j.select("draw", (F.col("e") - F.expr("j * (j - 1) div 2")).alias("a"), F.col("j").alias("b"))
    return pairs.select("draw", F.inline(F.expr("array(named_struct('src', a, 'dst', b), named_struct('src', b, 'dst', a))"))).withColumn("weight", F.lit(1.0))


def small_world_drawn(edges: DataFrame, draws: int = 5, seed: int = 0) -> DataFrame:
    """(draw, c, avg_path, c_random, path_random, sigma): a graph's clustering and mean path against those of random graphs with
    as many nodes and edges; paths are means over connected pairs.

    All draws are one graph of separate parts, so that they share their jobs."""
    known = profile.counts(edges).first()
    n, m = known["nodes"], known["edges"]
    drawn = stored(random_graphs(edges.sparkSession, n, m, draws, seed).select((F.col("src") + F.col("draw") * n).alias("src"), (F.col("dst") + F.col("draw") * n).alias("dst"), "weight"), "drawn")
    draw = lambda c: F.floor(F.col(c) / n).cast("int").alias("draw")
    c = profile.clustering(drawn).groupBy(draw("node")).agg((F.sum("clustering") / n).alias("c_random"))  # nodes without an edge count 0
    p = hop_paths(drawn).groupBy(draw("src")).agg(F.avg("hops").alias("path_random"))
    own = profile.clustering(edges).agg(F.avg("clustering").alias("c")).join(F.broadcast(hop_paths(edges).agg(F.avg("hops").alias("avg_path"))))
    row = c.join(p, "draw").join(F.broadcast(own))  # one row
    ratio = F.try_divide(F.try_divide(F.col("c"), F.col("c_random")), F.try_divide(F.col("avg_path"), F.col("path_random")))
    return row.select("draw", "c", "avg_path", "c_random", "path_random", ratio.alias("sigma"))
