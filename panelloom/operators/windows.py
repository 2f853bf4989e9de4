"""What models read: windows of samples, phase scalers, draws and batches, and what they give back.

A sample table is (sample, first_t, last_t, ...) as `split.samples` makes it; windows stay long rows (sample, step, node, ...).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators import cells, scores

#: Keeps a zero scale from dividing by zero (fixed value of the transform).
SCALE_EPS = 1e-6


def materialise(panel: DataFrame, samples: DataFrame, window: int, horizon: int = 0, trend: DataFrame | None = None, scaler: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """(sample, part, step, t, node, x, y, mask, eval): the `window` steps of each sample (part 'window'), and the `horizon`
    steps after them (part 'horizon').

    x is the value less its trend, scaled by (bias, scale), and 0 where it isn't for training; y is the value less its trend.
    trend: (t, node, trend); scaler: (bias, scale) by the columns `by` (none: one row)."""
    steps = samples.select("sample", "first_t", F.posexplode(F.sequence("first_t", F.col("first_t") + window + horizon - 1)).alias("step", "t"))
    rows = steps.join(panel.select("t", "node", "value", "observed", "eval"), "t")
    if trend is not None:
        rows = rows.join(trend.select("t", "node", "trend"), ["t", "node"], "left")
    y = F.col("value") - F.coalesce("trend", F.lit(0.0)) if trend is not None else F.col("value")
    rows = rows.withColumn("y", y)
    x = F.col("y")
    if scaler is not None:
        rows = rows.join(scaler, by) if by else rows.join(F.broadcast(scaler))  # no keys: one row
        x = (F.col("y") - F.col("bias")) / (F.col("scale") + SCALE_EPS)
    mask = F.col("observed") & ~F.col("eval")
    part = F.when(F.col("step") < window, "window").otherwise("horizon")
    return rows.select("sample", part.alias("part"), "step", "t", "node", F.when(mask, x).otherwise(0.0).alias("x"), "y", mask.alias("mask"), "eval")


def phase_steps(samples: DataFrame) -> DataFrame:
    """(t) of every step of the samples given: the merged slice of a phase."""
    return samples.select(F.explode(F.sequence("first_t", "last_t")).alias("t")).distinct()


SCALERS = {"std": cells.standard_scaler, "minmax": cells.minmax_scaler}


def phase_scaler(panel: DataFrame, samples: DataFrame, kind: str = "std", by: list[str] | None = None) -> DataFrame:
    """bias and scale of all observed cells (evaluation cells too) at the steps of the samples given, usually the training ones."""
    if kind not in SCALERS:
        raise NotImplementedError(f"unknown scaler {kind!r}: one of {sorted(SCALERS)}")
    rows = panel.join(phase_steps(samples), "t", "left_semi").filter("observed")
    return SCALERS[kind](rows, by or [])


def preprocess(rows: DataFrame, column: str = "value") -> DataFrame:
    """(x - trend - bias) / (scale + 1e-6), from columns trend, bias and scale."""
    return rows.withColumn(column, (F.col(column) - F.col("trend") - F.col("bias")) / (F.col("scale") + SCALE_EPS))


def postprocess(rows: DataFrame, column: str = "value") -> DataFrame:
    """The inverse of preprocess."""
    return rows.withColumn(column, F.col(column) * (F.col("scale") + SCALE_EPS) + F.col("bias") + F.col("trend"))


def trim(rows: DataFrame, warm_up: int, by: list[str], step: str = "step") -> DataFrame:
    """Rows without the first and last `warm_up` steps of each group."""
    w = Window.partitionBy(*by)
    return rows.withColumns({"_lo": F.min(step).over(w), "_hi": F.max(step).over(w)}).filter((F.col(step) >= F.col("_lo") + warm_up) & (F.col(step) <= F.col("_hi") - warm_up)).drop("_lo", "_hi")


def reverse(rows: DataFrame, by: list[str], step: str = "step") -> DataFrame:
    """Steps of each group counted from its end."""
    w = Window.partitionBy(*by)
    return rows.withColumn(step, F.min(step).over(w) + F.max(step).over(w) - F.col(step))


def numbered(samples: DataFrame, key: Column | None = None, width: int = 4096) -> DataFrame:
    """samples with _i, their number from 0 on by the key and the sample: counts of blocks of `width` keys, then numbers within
    blocks, so that no task holds the table."""
    key = F.col("sample") if key is None else key
    block = F.floor(key / width)
    sizes = samples.groupBy(block.alias("_b")).agg(F.count("*").alias("_n"))  # a 4096th of the rows
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_b", before.alias("_start"))
    inner = F.row_number().over(Window.partitionBy("_b").orderBy(key, "sample")) - 1
    return samples.withColumn("_b", block).join(starts, "_b").withColumn("_i", F.col("_start") + inner).drop("_b", "_start")


def draw(samples: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n samples with replacement: (draw, sample, ...), by an arithmetic hash of the draw and the seed."""
    rows = numbered(samples)
    size = rows.agg(F.count("*").alias("_size"))  # one row
    u = (F.col("draw") * 1103515245 + (seed + 1) * 12345) % 2147483647
    draws = samples.sparkSession.range(n).select(F.col("id").alias("draw")).join(F.broadcast(size)).filter("_size > 0").select("draw", F.floor(u * F.col("_size") / 2147483647).alias("_i"))
    return draws.join(rows, "_i").drop("_i")


def batches(samples: DataFrame, size: int, shuffle_seed: int | None = None, drop_last: bool = False) -> DataFrame:
    """samples with batch and place in it, in order or shuffled by an arithmetic hash; an incomplete last batch may go."""
    if size < 1:
        raise ValueError("a batch holds one sample or more")
    if shuffle_seed is None:
        rows = numbered(samples)
    else:
        rows = numbered(samples, (F.col("sample") * 1103515245 + (shuffle_seed + 1) * 12345) % 2147483647, 1 << 19)
    out = rows.withColumns({"batch": F.floor(F.col("_i") / size), "place": (F.col("_i") % size).cast("int")}).drop("_i")
    if drop_last:
        whole = rows.agg(F.floor(F.count("*") / size).alias("_whole"))  # one row
        out = out.join(F.broadcast(whole)).filter("batch < _whole").drop("_whole")
    return out


def available(panel: DataFrame) -> DataFrame:
    """The steps at which any node has a training value, with all their cells."""
    some = panel.groupBy("t").agg(F.bool_or(F.col("observed") & ~F.col("eval")).alias("_any")).filter("_any").select("t")
    return panel.join(some, "t", "left_semi")


def out_of_sample_mask(panel: DataFrame, train: DataFrame) -> DataFrame:
    """observed also where a training step's cell is held out for evaluation: train has the training samples."""
    steps = phase_steps(train).withColumn("_train", F.lit(True))
    return panel.join(steps, "t", "left").withColumn("observed", F.col("observed") | (F.coalesce("_train", F.lit(False)) & F.col("eval"))).drop("_train")


def collect_predictions(phases: dict[str, DataFrame]) -> DataFrame:
    """Predictions of several phases under one another, with their phase."""
    return reduce(DataFrame.unionByName, (df.withColumn("phase", F.lit(name)) for name, df in phases.items()))


def phase_metrics(predictions: DataFrame) -> DataFrame:
    """Errors of each phase, in one pass."""
    return scores.errors(predictions, ["phase"])


def peak_loss(rows: DataFrame) -> DataFrame:
    """Mean squared error of the highest and lowest prediction of each sample and node against the target's."""
    ends = rows.groupBy("sample", "node").agg(*(f(c).alias(f"{n}_{c}") for n, f in (("max", F.max), ("min", F.min)) for c in ("prediction", "target")))
    miss = lambda n: F.pow(F.col(f"{n}_prediction") - F.col(f"{n}_target"), 2)
    return ends.agg(((F.sum(miss("max")) + F.sum(miss("min"))) / (F.count(miss("max")) + F.count(miss("min")))).alias("peak_loss"))
