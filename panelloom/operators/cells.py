"""Masks, fills, resampling and scaling of panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def training(df: DataFrame) -> DataFrame:
    """train: observed and not held out; x: the value where train, else 0."""
    train = F.col("observed") & ~F.col("eval")
    return df.withColumn("train", train).withColumn("x", F.when(train, F.col("value")).otherwise(0.0))


def mask_counts(df: DataFrame, mask: str = "observed", other: str = "eval") -> DataFrame:
    """How two masks relate: one row of counts and flags."""
    a, b = F.col(mask), F.col(other)
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(a & b).alias("overlap"),
        F.count_if(a & ~b).alias("only_mask"),
        F.count_if(~a & b).alias("only_other"),
        F.count_if(~a & ~b).alias("neither"),
        F.bool_and(a == b).alias("equal"),
        F.bool_and(~b | a).alias("other_in_mask"),
    )


def mean_fill(df: DataFrame) -> DataFrame:
    """Missing values by the node's mean."""
    return df.withColumn("filled", F.coalesce("value", F.avg("value").over(Window.partitionBy("node"))))


def hierarchical_fill(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Missing values by ever coarser calendar means of the node, each over what the level before has filled; then the
    value before, then the value after."""
    keys = {
        "year": F.year("ts"),
        "week": F.weekofyear("ts"),
        "month": F.month("ts"),
        "hour": F.hour("ts"),
    }
    levels = (("year", "week", "hour"), ("year", "month", "hour"), ("month", "hour"), ("hour",))
    out = df.withColumns({f"_{k}": v for k, v in keys.items()}).withColumn("filled", F.col("value"))
    for level in levels:
        mean = F.avg("filled").over(Window.partitionBy("node", *(f"_{k}" for k in level)))
        out = out.withColumn("filled", F.coalesce("filled", F.round(mean, digits) if digits is not None else mean))
    return fill_gaps(out.drop(*(f"_{k}" for k in keys)), "filled")


def fill_gaps(df: DataFrame, column: str = "value", out: str | None = None) -> DataFrame:
    """The last value before, or where there is none the first after."""
    by_time = Window.partitionBy("node").orderBy("t")
    before = F.last(column, ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(column, ignorenulls=True).over(by_time.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(out or column, F.coalesce(before, after))


def resample(df: DataFrame, factor: int) -> DataFrame:
    """`factor` steps to one: mean, sum, nearest (first observed step) and whether all were observed."""
    return (
        df.groupBy("node", F.floor(F.col("t") / factor).alias("bucket"))
        .agg(
            F.avg("value").alias("mean"),
            F.sum("value").alias("sum"),
            F.min_by("value", F.when(F.col("observed"), F.col("t"))).alias("nearest"),
            F.bool_and("observed").alias("observed"),
        )
    )


RESAMPLES = ("mean", "sum", "nearest")


def resample_to(df: DataFrame, freq: str, how: str = "nearest") -> DataFrame:
    """(node, ts, value, observed) on a coarser calendar grid such as '6 hours': the mean or sum of a bucket, or its cell that is
    nearest to the bucket's begin; a bucket is observed if all its cells are."""
    if how not in RESAMPLES:
        raise ValueError(f"unknown aggregation {how!r}: one of {RESAMPLES}")
    bucket = F.window("ts", freq).start
    value = {"mean": F.avg("value"), "sum": F.sum("value"), "nearest": F.min_by("value", "ts")}[how]
    return df.groupBy("node", bucket.alias("ts")).agg(value.alias("value"), F.bool_and("observed").alias("observed"))


def nan_mean(value: Column) -> Column:
    """Mean of what is there; 0 where nothing is."""
    return F.coalesce(F.avg(value), F.lit(0.0))


def nan_std(value: Column) -> Column:
    """Sample deviation of what is there; 0 where fewer than two are."""
    return F.coalesce(F.stddev_samp(value), F.lit(0.0))


def standard_scaler(df: DataFrame, by: list[str], where: Column | None = None) -> DataFrame:
    """bias and scale of each group: mean and population deviation."""
    rows = df if where is None else df.filter(where)
    return rows.groupBy(*by).agg(F.avg("value").alias("bias"), F.stddev_pop("value").alias("scale"))


def minmax_scaler(df: DataFrame, by: list[str], where: Column | None = None) -> DataFrame:
    """bias and scale of each group: minimum and range."""
    rows = df if where is None else df.filter(where)
    return rows.groupBy(*by).agg(F.min("value").alias("bias"), (F.max("value") - F.min("value")).alias("scale"))


def scale(df: DataFrame, params: DataFrame, by: list[str]) -> DataFrame:
    """scaled = (value - bias) / scale; a zero scale gives NULL."""
    joined = df.join(params, by) if by else df.join(F.broadcast(params))
    return joined.withColumn("scaled", F.try_divide(F.col("value") - F.col("bias"), F.col("scale")))


def unscale(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.col("scaled") * F.col("scale") + F.col("bias"))


def whiten(df: DataFrame, keep: float = 0.95, seed: int = 42) -> DataFrame:
    """Keep a share of the observed cells for training, by an arithmetic hash of the cell (nodes are numbers); the others become
    evaluation cells."""
    first = (F.col("t") * 69069 + F.col("node") * 1103515245 + seed * 12345) % 2147483647
    u = (first * 48271) % 2147483647 / 2147483647.0
    kept = F.col("observed") & (u < keep)
    return df.withColumn("kept", kept).withColumn("eval", (F.col("observed") | F.col("eval")) & ~kept)
