"""Ends of the spectrum of the normalised Laplacian without a matrix: Lanczos steps as joins and sums, for all components at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.session import release, stored

STEPS = 300
EXACT = 1e-7


def _ends(alpha: list[float], beta: list[float]) -> tuple[float, float, float]:
    """Largest and smallest Ritz value of the steps so far, and how far the true ends may lie off."""
    t = np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1)
    values, vectors = np.linalg.eigh(t)
    off = beta[len(alpha) - 1] * np.abs(vectors[-1])
    return float(values[-1]), float(values[0]), float(max(off[-1], off[0]))


def laplacian_ends(edges: DataFrame, comps: DataFrame, steps: int = STEPS, exact: float = EXACT) -> DataFrame:
    """(component, gap, largest, energy, error) of each component in comps (node, component) that has an edge.

    gap and largest: the least eigenvalue above the trivial 0 and the largest, each with `error` at most between it and the
    nearest eigenvalue; energy: the sum of all absolute values, which is the trace, as none is negative for weights above 0.

    A step multiplies by the scaled adjacency (a join and a sum), takes out what lies along the known null vector and all
    vectors before, and writes the vectors, as an array of each node; their lengths stay beside them. Steps end when all
    components are `exact`, or exhausted, or after `steps`. The driver keeps a number for each step and component, and two of each
    pair of steps: comps should be large components."""
    inner = edges.join(comps.select(F.col("node").alias("src"), "component"), "src")
    deg = inner.groupBy("component", F.col("src").alias("node")).agg(F.sum("weight").alias("d"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("weight")).otherwise(0.0)).alias("loop"))
    deg = stored(deg, "deg")
    size = deg.groupBy("component").agg(F.sum("d").alias("all"), F.sum(1 - F.col("loop") / F.col("d")).alias("energy"), F.count("*").alias("n"))
    energy = {r["component"]: (r["energy"], r["n"]) for r in size.select("component", "energy", "n").collect()}
    scaled = edges.join(deg.select(F.col("node").alias("src"), F.col("d").alias("d1"), "component"), "src").join(deg.select(F.col("node").alias("dst"), F.col("d").alias("d2")), "dst")
    scaled = stored(scaled.select("component", "src", "dst", (F.col("weight") / F.sqrt(F.col("d1") * F.col("d2"))).alias("a")), "scaled")
    spark, kind = edges.sparkSession, dict(comps.dtypes)["component"]
    # the null vector first, then a vector from hashes; it is made orthogonal like the others
    vs = deg.join(size.select("component", "all"), "component").select("component", "node", F.array(F.sqrt(F.col("d") / F.col("all"))).alias("vs"))
    w = stored(vs.withColumn("w", F.pmod(F.xxhash64("node"), F.lit(2_000_003)) / 1_000_001.5 - 1), "w")
    lengths = {c: [1.0] for c in energy}
    alpha, beta = {c: [] for c in energy}, {c: [] for c in energy}
    out = {c: (0.0, 0.0, 0.0) for c in energy}  # a single node has but the trivial value
    for k in range(1, steps + 2):
        # shares along the vectors so far, by their lengths; what is left becomes the next vector, as it is
        shares = w.groupBy("component").agg(F.array(*(F.sum(F.col("vs")[j] * F.col("w")) for j in range(k))).alias("c")).collect()
        take = [(r["component"], [c / n**2 for c, n in zip(r["c"], lengths[r["component"]])]) for r in shares]
        part = spark.createDataFrame(take, f"component {kind}, c array<double>")  # a row of k numbers for each component
        less = F.aggregate(F.zip_with("vs", "c", lambda v, c: v * c), F.lit(0.0), lambda s, x: s + x)
        vs = stored(w.join(F.broadcast(part), "component").select("component", "node", F.concat("vs", F.array(F.col("w") - less)).alias("vs")), "vs")
        release(w)
        norms = {r["component"]: r["n"] for r in vs.groupBy("component").agg(F.sqrt(F.sum(F.col("vs")[k] * F.col("vs")[k])).alias("n")).collect()}
        going = []
        for r in shares:
            c, norm = r["component"], norms[r["component"]]
            if k > 1:  # w was the product with the last vector of length 1
                alpha[c].append(r["c"][-1] / lengths[c][-1])
                beta[c].append(norm)
                high, low, off = _ends(alpha[c], beta[c])
                out[c] = (1 - high, 1 - low, off)
                if off <= exact:
                    continue
            lengths[c].append(norm)
            if norm > 1e-10:
                going.append((c, norm))
        if not going or k > steps:
            break
        keep = spark.createDataFrame(going, f"component {kind}, norm double")
        x = vs.join(F.broadcast(keep), "component").select(F.col("node").alias("src"), (F.col("vs")[k] / F.col("norm")).alias("x"))
        y = scaled.join(x, "src").groupBy("component", F.col("dst").alias("node")).agg(F.sum(F.col("a") * F.col("x")).alias("w"))
        w = stored(vs.join(F.broadcast(keep), "component", "left_semi").join(y, ["component", "node"], "left").select("component", "node", "vs", F.coalesce("w", F.lit(0.0)).alias("w")), "w")
        release(vs)
    release(vs, scaled, deg)
    return spark.createDataFrame([(c, *out[c][:2], energy[c][0], out[c][2]) for c in energy], f"component {kind}, gap double, largest double, energy double, error double")
