"""Communities of graphs of any size: rounds of moves as joins and aggregates, then contraction, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.session import release, stored

#: Rounds of moves in a level, levels, and classes of nodes that move in turns.
ROUNDS = 100
LEVELS = 30
CLASSES = 4
GAIN = 1e-12


def _quality(g: DataFrame, parts: DataFrame) -> float:
    """Modularity of (node, part) over the directed rows of g, self-loops included."""
    a, b = parts.select(F.col("node").alias("src"), F.col("part").alias("a")), parts.select(F.col("node").alias("dst"), F.col("part").alias("b"))
    by_part = g.join(a, "src").join(b, "dst").groupBy("a").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("total"))
    row = by_part.agg(F.sum("total").alias("m"), F.sum("inside").alias("i"), F.sum(F.expr("total * total")).alias("s")).first()
    return row["i"] / row["m"] - row["s"] / row["m"] ** 2 if row["m"] else 0.0


def _movers(g: DataFrame, parts: DataFrame, strength: DataFrame, whole: float) -> DataFrame:
    """(node, part, to, gain) of the nodes that raise modularity by a move, each to its best part (of equally good ones the least)."""
    own = parts.join(strength, "node")
    total = own.groupBy("part").agg(F.sum("k").alias("total"))
    to = parts.select(F.col("node").alias("dst"), F.col("part").alias("to"))
    into = g.filter("src <> dst").join(to, "dst").groupBy(F.col("src").alias("node"), "to").agg(F.sum("weight").alias("w"))
    stay = own.select("node", F.col("part").alias("to"), F.lit(0.0).alias("w"))
    offers = into.unionByName(stay).groupBy("node", "to").agg(F.sum("w").alias("w")).join(own, "node").join(total.withColumnRenamed("part", "to"), "to")
    gain = F.expr(f"w - k * (total - IF(to = part, k, 0D)) / {whole!r}D")
    best = offers.select("node", "part", "to", gain.alias("g")).groupBy("node", "part").agg(F.max(F.when(F.col("to") == F.col("part"), F.col("g"))).alias("here"), F.max("g").alias("top"), F.sort_array(F.collect_list(F.struct((-F.col("g")).alias("bad"), "to")))[0].alias("best"))
    return best.filter(F.col("top") > F.col("here") + GAIN * whole).select("node", "part", F.col("best.to").alias("to"), (F.col("top") - F.col("here")).alias("gain"))


def _apart(movers: DataFrame) -> DataFrame:
    """Movers that are the best of all that touch either of their two parts: their gains add up exactly."""
    touch = movers.select("node", "gain", F.explode(F.array("part", "to")).alias("p"))
    best = touch.groupBy("p").agg(F.sort_array(F.collect_list(F.struct((-F.col("gain")).alias("bad"), "node")))[0].alias("b")).select("p", F.col("b.node").alias("node"))
    return movers.join(best.groupBy("node").agg(F.count("*").alias("n")).filter("n = 2"), "node", "left_semi")


def _moved(parts: DataFrame, movers: DataFrame) -> DataFrame:
    return stored(parts.join(movers.select("node", "to"), "node", "left").select("node", F.coalesce("to", "part").alias("part")), "parts")


def _level(g: DataFrame) -> tuple[DataFrame, bool]:
    """(node, part) after moves that only ever raise modularity, and whether any was made."""
    strength = stored(g.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k")), "strength")
    whole = strength.agg(F.sum("k")).first()[0] or 1.0
    parts = stored(strength.select("node", F.col("node").alias("part")), "parts")
    quality, any_, idle = _quality(g, parts), False, 0
    for turn in range(ROUNDS):
        movers = stored(_movers(g, parts, strength, whole), "movers")
        if movers.isEmpty():
            break
        # nodes of one class move together; where that lowers modularity, only moves that don't touch each other
        some = movers.filter(F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(CLASSES)) == turn % CLASSES)
        tried = _moved(parts, some)
        now = _quality(g, tried)
        if now <= quality + GAIN:
            release(tried)
            tried = _moved(parts, _apart(movers))
            now = _quality(g, tried)
        release(movers)
        if now <= quality + GAIN:
            release(tried)
            break
        before, parts, quality, any_ = parts, tried, now, True
        release(before)
    release(strength)
    return parts, any_


def louvain(edges: DataFrame) -> DataFrame:
    """(node, community): the smallest node of each community, by modularity. edges has both directions of each edge.

    A round's offers are one aggregate over the edges; nodes of one of CLASSES hashed classes move at once, and where that would
    lower modularity the moves that touch no common community do, whose gains are exact: modularity only rises. Communities then
    become the nodes of a smaller graph, until no level moves. A node's offers are as many as the communities next to it."""
    g = stored(edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "graph")
    names = stored(g.select(F.col("src").alias("node"), F.col("src").alias("part")).distinct(), "names")
    for _ in range(LEVELS):
        parts, moved = _level(g)
        if not moved:
            release(parts)
            break
        old, names = names, stored(names.join(parts.select(F.col("node").alias("part"), F.col("part").alias("up")), "part").select("node", F.col("up").alias("part")), "names")
        a, b = parts.select(F.col("node").alias("src"), F.col("part").alias("a")), parts.select(F.col("node").alias("dst"), F.col("part").alias("b"))
        small = stored(g.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight")), "graph")
        release(old, g, parts)
        g = small
    release(g)
    least = names.groupBy("part").agg(F.min("node").alias("community"))
    return names.join(least, "part").select("node", "community")
