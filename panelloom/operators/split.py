"""Sliding samples, calendar splits and evaluation masks inferred from neighbouring months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def samples(df: DataFrame, window: int, stride: int = 1, horizon: int = 0) -> DataFrame:
    """Samples (sample, first_t, last_t, start_ts, end_ts) of whole windows over the panel's steps."""
    steps = df.select("t", "ts").distinct()
    span = window + horizon
    ends = steps.select((F.col("t") - (span - 1)).alias("first_t"), F.col("ts").alias("end_ts"))
    starts = steps.filter(F.col("t") % stride == 0).select(F.col("t").alias("first_t"), F.col("ts").alias("start_ts"))
    return starts.join(ends, "first_t").select((F.col("first_t") / stride).cast("long").alias("sample"), "first_t", (F.col("first_t") + span - 1).alias("last_t"), "start_ts", "end_ts")


def members(samples_: DataFrame) -> DataFrame:
    """(sample, t) of every step of every sample."""
    return samples_.select("sample", F.explode(F.sequence("first_t", "last_t")).alias("t"))


def horizon_members(samples_: DataFrame, horizon: int) -> DataFrame:
    """(sample, t) of every step of the windows and of the `horizon` steps after them."""
    after = samples_.select("sample", F.explode(F.sequence(F.col("last_t") + 1, F.col("last_t") + horizon)).alias("t"))
    return members(samples_).unionByName(after).distinct()


def in_sample(samples_: DataFrame, test: tuple[int, ...] = (3, 6, 9, 12)) -> DataFrame:
    """(sample, phase): all samples are for training; those of the test and validation months are told once more."""
    told = month_split(samples_, test).filter("phase IN ('test', 'val')").select("sample", "phase")
    return samples_.select("sample", F.lit("train").alias("phase")).unionByName(told)


def month_split(samples_: DataFrame, test: tuple[int, ...] = (3, 6, 9, 12)) -> DataFrame:
    """phase of each sample: test or val if both ends lie in those months (val: the month before each test month), train
    if both lie outside of the two, else NULL (straddlers)."""
    val = [(m - 2) % 12 + 1 for m in test]
    a, b = F.month("start_ts"), F.month("end_ts")
    both = lambda months: a.isin(list(months)) & b.isin(list(months))
    other = [m for m in range(1, 13) if m not in test and m not in val]
    return samples_.withColumn("phase", F.when(both(test), "test").when(both(val), "val").when(both(other), "train"))


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Samples of left that share a step with any sample of right."""
    steps = members(right).select("t").distinct()
    return members(left).join(steps, "t", "left_semi").select("sample").distinct()


def out_of_sample(samples_: DataFrame, window: int, test: tuple[int, ...] = (3, 6, 9, 12), share: float = 0.1) -> DataFrame:
    """Test: samples with both ends in test months. Validation: from those with both ends in the other months, blocks of
    samples that end `window` samples before a run of test samples begins; train: the rest that shares no step with them."""
    a, b = F.month("start_ts"), F.month("end_ts")
    rows = samples_.withColumn("is_test", a.isin(list(test)) & b.isin(list(test))).withColumn("is_rest", ~a.isin(list(test)) & ~b.isin(list(test)))
    tests = rows.filter("is_test").select("sample")
    # a run of test samples begins where the sample before isn't one
    starts = tests.join(tests.select((F.col("sample") + 1).alias("sample")), "sample", "left_anti")
    block = rows.agg(F.floor(F.floor(F.count_if("is_rest") * share) / 4).cast("long").alias("size"))
    heads = starts.select((F.col("sample") - window).alias("stop")).join(F.broadcast(block))
    # blocks that begin before the first sample go on at the last one
    total = rows.agg(F.count("*").alias("total"))
    val = heads.filter("size > 0").select(F.explode(F.sequence(F.col("stop") - F.col("size"), F.col("stop") - 1)).alias("sample"))
    val = val.join(F.broadcast(total)).select(F.expr("pmod(sample, total)").alias("sample")).distinct()
    val = rows.filter("is_rest").join(val, "sample", "left_semi").drop("is_test", "is_rest")
    rest = rows.filter("is_rest").drop("is_test", "is_rest")
    hit = overlapping(rest, val)
    train = rest.join(hit, "sample", "left_anti")
    mark = lambda df, phase: df.select("sample", F.lit(phase).alias("phase"))
    return mark(rows.filter("is_test"), "test").unionByName(mark(val, "val")).unionByName(mark(train, "train"))


def month_shift_mask(df: DataFrame, infer_from: str = "next") -> DataFrame:
    """eval: observed here, missing in the next (or previous) month at the same day and time.

    Months are those of the panel, in order; the month after the last one is the first. Days that a month doesn't have fall on
    its last day, where the first to come counts; cells without a counterpart aren't for evaluation."""
    if infer_from not in ("next", "previous"):
        raise ValueError("infer_from must be 'next' or 'previous'")
    offset = 1 if infer_from == "next" else -1
    month = (F.year("ts") * 12 + F.month("ts") - 1).cast("int")
    grid = df.select(month.alias("m")).distinct().agg(F.array_sort(F.collect_set("m")).alias("g"))  # one row, a number a month
    # month i takes over the rows of the month beside it: shifted by as many months as lie between the two
    moves = grid.select(F.posexplode("g").alias("i", "to"), "g").select("to", F.expr(f"element_at(g, CAST(pmod(i + {offset}, size(g)) AS INT) + 1)").alias("m"))
    later = df.select("node", "t", "ts", F.col("observed").alias("later"), month.alias("m")).join(F.broadcast(moves), "m")
    shifted = later.select("node", F.expr("ts + make_ym_interval(0, to - m)").alias("ts"), "t", "later")
    first = shifted.groupBy("node", "ts").agg(F.min_by("later", "t").alias("later"))
    return df.join(first, ["node", "ts"], "left").withColumn("eval", F.col("observed") & ~F.coalesce("later", F.lit(True))).drop("later")
