"""Scores of predictions (prediction, target): masked errors and correlations in one pass, and overlap aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def error_columns(p: Column, t: Column) -> dict[str, Column]:
    e = p - t
    size = F.abs(p) + F.abs(t)
    absolute = F.sum(F.abs(e))
    return {
        "n": F.count(F.when(e.isNotNull(), 1)),
        "mae": F.avg(F.abs(e)),
        "mse": F.avg(e * e),
        "rmse": F.sqrt(F.avg(e * e)),
        "mape": F.avg(F.abs(F.try_divide(e, t))),
        "mre": F.when(F.sum(t) > 1e-6, F.try_divide(absolute, F.sum(t))).otherwise(absolute),
        "mre2": F.avg(F.abs(e) / (F.abs(t) + 1e-6)),
        "smape": F.avg(F.when(size > 1e-6, 2 * F.abs(e) / (size + 1e-6)).otherwise(F.when(size.isNotNull(), 0.0))),
        "wape": F.try_divide(absolute, F.sum(t)),
        "nmae": F.try_divide(F.avg(F.abs(e)), F.max(t) - F.min(t)),
        "nrmse": F.try_divide(F.sqrt(F.avg(e * e)), F.max(t) - F.min(t)),
        "nrmse_2": F.sqrt(F.try_divide(F.sum(e * e), F.sum(t * t))),
        "r2": 1 - F.try_divide(F.sum(e * e), F.sum(t * t) - F.sum(t) * F.try_divide(F.sum(t), F.count(t))),
    }


def correlation_columns(x: Column, y: Column) -> dict[str, Column]:
    mx, my = F.avg(x), F.avg(y)
    cov = F.avg(x * y) - mx * my
    vx, vy = F.greatest(F.avg(x * x) - mx * mx, F.lit(0.0)), F.greatest(F.avg(y * y) - my * my, F.lit(0.0))
    return {
        "pearson": F.coalesce(cov / F.greatest(F.sqrt(vx) * F.sqrt(vy), F.lit(1e-6)), F.lit(0.0)),
        "ccc": F.coalesce(2 * cov / (vx + vy + (mx - my) * (mx - my) + 1e-8), F.lit(0.0)),
        "cosine": F.sum(x * y) / (F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y)) + 1e-8),
    }


def masked_loss(rows: DataFrame, kind: str = "absolute", reduction: str = "mean", finite_only: bool = True) -> DataFrame:
    """One row (loss): absolute or squared errors where `mask`, as their mean (0 where nothing is masked in) or sum.

    finite_only: errors that are NaN or infinite count for nothing."""
    if kind not in ("absolute", "squared") or reduction not in ("mean", "sum"):
        raise ValueError("kind must be absolute or squared, reduction mean or sum")
    e = F.abs(F.col("prediction") - F.col("target"))
    loss = e if kind == "absolute" else e * e
    keep = F.col("mask") & loss.isNotNull()
    if finite_only:
        keep = keep & ~F.isnan(loss) & (loss < float("inf"))
    total = F.coalesce(F.sum(F.when(keep, loss)), F.lit(0.0))
    return rows.agg((total if reduction == "sum" else total / F.greatest(F.count_if(keep).cast("double"), F.lit(1e-6))).alias("loss"))


def errors(rows: DataFrame, by: list[str] | None = None, at: int | None = None) -> DataFrame:
    """Errors over all rows where prediction and target are there, or by group; at: of that step (column `step`) alone."""
    valid = rows.filter("prediction IS NOT NULL AND target IS NOT NULL")
    if at is not None:
        valid = valid.filter(F.col("step") == at)
    return valid.groupBy(*(by or [])).agg(*(c.alias(k) for k, c in error_columns(F.col("prediction"), F.col("target")).items()))


def correlations(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    valid = rows.filter("prediction IS NOT NULL AND target IS NOT NULL")
    return valid.groupBy(*(by or [])).agg(*(c.alias(k) for k, c in correlation_columns(F.col("prediction"), F.col("target")).items()))


def lag_correlation(rows: DataFrame, lag: int = 1) -> DataFrame:
    """Correlation of the prediction with the target `lag` steps before, over time within each node."""
    before = F.lag("target", lag).over(Window.partitionBy("node").orderBy("t"))
    pairs = rows.withColumn("_y", before).filter("prediction IS NOT NULL AND _y IS NOT NULL")
    return pairs.agg(correlation_columns(F.col("prediction"), F.col("_y"))["pearson"].alias("lag"))


def overlap(predictions: DataFrame, how: str = "mean") -> DataFrame:
    """One prediction a (node, t) from overlapping samples: mean, central, last or smooth_central."""
    keys = ["node", "t"]
    if how == "mean":
        return predictions.groupBy(*keys).agg(F.avg("prediction").alias("prediction"))
    if how == "last":  # the first sample that holds the step has it in its last place; missing predictions don't count
        return predictions.filter("prediction IS NOT NULL").groupBy(*keys).agg(F.min_by("prediction", "sample").alias("prediction"))
    order = Window.partitionBy(*keys).orderBy("sample")
    ranked = predictions.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    if how == "central":
        return ranked.filter("_i = floor(_n / 2)").select(*keys, "prediction")
    if how == "smooth_central":
        w = F.exp(-0.5 * F.pow(F.col("_i") - (F.col("_n") - 1) / 2, 2))
        return ranked.groupBy(*keys).agg((F.sum(w * F.col("prediction")) / F.sum(w)).alias("prediction"))
    raise ValueError("how must be mean, central, last or smooth_central")


def runtimes(rows: DataFrame, seconds: str) -> DataFrame:
    """Total, mean and population deviation of timings."""
    s = F.col(seconds)
    return rows.agg(F.sum(s).alias("total"), (F.sum(s) / F.greatest(F.count(s), F.lit(1))).alias("mean"), F.stddev_pop(s).alias("std"))


def long_report(row: DataFrame, phase: str, epoch: int) -> DataFrame:
    """One row of scores as (phase, epoch, metric, value)."""
    return row.select([F.col(c).cast("double").alias(c) for c in row.columns]).unpivot([], row.columns, "metric", "value").select(F.lit(phase).alias("phase"), F.lit(epoch).alias("epoch"), "metric", "value")
