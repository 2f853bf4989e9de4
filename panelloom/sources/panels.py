"""Panels: long tables (node, ts, t, value, observed, eval) from raw events; t counts whole steps from the first one.

A missing cell is NULL and not observed. NaN becomes NULL on the way in, so that Spark's aggregates skip it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType

SECONDS = {"hour": 3600, "day": 86400}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observed(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def eval_rule(t: Column, node_number: Column) -> Column:
    """A deterministic tenth of the cells."""
    return (t * 31 + node_number * 17) % 10 == 0


def panel(rows: DataFrame, step: str = "hour", per_unit: int = 64) -> DataFrame:
    """rows (node, ts, value) as a gap-aware panel: every node has every step between the first and the last of all nodes.

    A cell is the mean of its rows, to the nearest 1/per_unit: a power of two, so that sums of cells are exact in any order
    and a distributed run gives the same bits each time."""
    cell = F.date_trunc(step, F.col("ts")).cast("timestamp_ntz")
    value = F.when(observed(F.col("value")), F.col("value"))
    cells = rows.groupBy("node", cell.alias("ts")).agg((F.round(F.avg(value) * per_unit) / per_unit).alias("value"))
    bounds = cells.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))  # one row
    nodes = cells.select("node").distinct()
    steps = F.expr(f"sequence(lo, hi, interval 1 {step})")
    grid = nodes.join(F.broadcast(bounds)).select("node", "lo", F.explode(steps).alias("ts"))
    t = F.expr(f"timestampdiff({step.upper()}, lo, ts)")
    return grid.join(cells, ["node", "ts"], "left").select("node", "ts", t.cast("long").alias("t"), "value", observed(F.col("value")).alias("observed"))


def hourly(spark: SparkSession, sf_dir: str, nodes: int = 36) -> DataFrame:
    """Events by user_id modulo `nodes`, hourly, with a deterministic evaluation mask on observed cells."""
    events = read(spark, sf_dir, "events").select((F.col("user_id") % nodes).alias("node"), "ts", "value")
    return panel(events).withColumn("eval", F.col("observed") & eval_rule(F.col("t"), F.col("node")))


def by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by their type, hourly: a small dense panel."""
    return panel(read(spark, sf_dir, "events").select(F.col("event_type").alias("node"), "ts", "value"))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order price by priority, daily: years of data for calendar splits."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("node"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_totalprice").cast("double").alias("value"))
    return panel(orders, "day")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invented, stable coordinates for the nations."""
    key = F.col("n_nationkey").cast("long")
    return read(spark, sf_dir, "nation").select(key.alias("node"), (key * 37 % 121 - 60).cast("double").alias("latitude"), (key * 53 % 360 - 180).cast("double").alias("longitude"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


#: Named panels, by which a caller picks a data set.
PANELS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"hourly": hourly, "by_type": by_type, "daily_orders": daily_orders}


def load(spark: SparkSession, sf_dir: str, name: str, freq: str | None = None, aggregation: str = "nearest", infer_from: str | None = None, masked: list | None = None, impute: str | None = None) -> DataFrame:
    """A named panel, and in this order, where asked for: resampled to a coarser grid; with an evaluation mask inferred from the
    'next' or 'previous' month; with all cells of the `masked` nodes held out; with `filled` values, by 'mean', 'zero', 'calendar'
    (hierarchical means) or 'neighbours' in time."""
    from panelloom.operators import cells, split

    if name not in PANELS:
        raise ValueError(f"unknown panel {name!r}: one of {sorted(PANELS)}")
    fills = {"mean": cells.mean_fill, "zero": lambda p: p.withColumn("filled", F.coalesce("value", F.lit(0.0))), "calendar": cells.hierarchical_fill, "neighbours": lambda p: cells.fill_gaps(p, out="filled")}
    if impute is not None and impute not in fills:
        raise ValueError(f"unknown fill {impute!r}: one of {sorted(fills)}")
    out = PANELS[name](spark, sf_dir)
    if freq is not None:
        coarse = cells.resample_to(out, freq, aggregation)
        bounds = coarse.agg(F.min("ts").alias("_lo"), F.min("ts").alias("_any"))  # one row
        step = F.expr(f"unix_micros(CAST(TIMESTAMP_NTZ '1970-01-01' + INTERVAL {freq} AS TIMESTAMP)) - unix_micros(CAST(TIMESTAMP_NTZ '1970-01-01' AS TIMESTAMP))")
        t = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_lo").cast("timestamp"))) / step
        out = coarse.join(F.broadcast(bounds)).withColumn("t", F.round(t).cast("long")).drop("_lo", "_any")
    if infer_from is not None:
        out = split.month_shift_mask(out, infer_from)
    elif "eval" not in out.columns:
        out = out.withColumn("eval", F.lit(False))
    if masked:
        out = mask_nodes(out, masked)
    return out if impute is None else fills[impute](out)


def mask_nodes(df: DataFrame, nodes: list) -> DataFrame:
    """The evaluation mask extended to all observed cells of the listed nodes."""
    return df.withColumn("eval", F.col("eval") | (F.col("node").isin(nodes) & F.col("observed")))


def unpivot(wide: DataFrame, ts_col: str = "ts") -> DataFrame:
    """A wide table (one column a node) as long rows (ts, node, value)."""
    return wide.unpivot([ts_col], [c for c in wide.columns if c != ts_col], "node", "value")


def arrays_to_long(samples: DataFrame, column: str, window: int | None = None) -> DataFrame:
    """(sample, <column> array of steps of arrays of nodes) as long rows, cut to the first `window` steps."""
    steps = F.slice(column, 1, window) if window else F.col(column)
    by_step = samples.select("sample", F.posexplode(steps).alias("t", "nodes"))
    return by_step.select("sample", "t", F.posexplode("nodes").alias("node", "value"))


def adjacency_to_edges(samples: DataFrame, column: str = "adj", zeros: bool = False) -> DataFrame:
    """(sample, <column> square array of arrays) as edges (sample, src, dst, weight) of the entries that aren't 0 or NULL; zeros:
    of those that aren't NULL."""
    rows = samples.select("sample", F.posexplode(column).alias("src", "_row"))
    return rows.select("sample", "src", F.posexplode("_row").alias("dst", "weight")).filter("weight IS NOT NULL" if zeros else "weight <> 0")


def as_series(df: DataFrame, value: str = "x", series: str | None = None, step: str = "t") -> DataFrame:
    """Columns of any table as series (series, t, x double), as the operators on series take them; without `series` it is one.

    A missing column is a KeyError; values that aren't numbers, or steps that aren't whole ones, are a TypeError; both are told
    from the schema, before any data is read. NULL, NaN and infinite values, and steps that repeat or leave a gap, fail the
    job that reads them."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for c in (value, step, *([series] if series else [])):
        if c not in kinds:
            raise KeyError(f"no column {c!r}: there are {sorted(kinds)}")
    if not isinstance(kinds[value], NumericType):
        raise TypeError(f"{value!r} holds {kinds[value].simpleString()}, not numbers")
    if not isinstance(kinds[step], IntegralType):
        raise TypeError(f"{step!r} holds {kinds[step].simpleString()}, not whole steps")
    key = F.col(series) if series else F.lit(0)
    rows = df.select(key.alias("series"), F.col(step).cast("long").alias("t"), F.col(value).cast("double").alias("x"))
    order = F.row_number().over(Window.partitionBy("series").orderBy("t")) - 1
    bad = F.col("x").isNull() | F.isnan("x") | (F.abs("x") == float("inf"))
    whole = F.when(bad, F.raise_error(F.lit("a series holds NULL, NaN or an infinite value"))).otherwise(F.col("x"))
    dense = F.when(F.col("_at") != F.col("t"), F.raise_error(F.lit("steps of a series must count 0, 1, 2 ..."))).otherwise(F.col("t"))
    return rows.withColumn("_at", order).select("series", dense.cast("long").alias("t"), whole.cast("double").alias("x"))


def noise(t: Column, seed: int = 1) -> Column:
    """Uniform in -1 ... 1, by two steps of a multiplicative generator from t."""
    return ((t + seed) * 48271 % 2147483647 * 69621 % 2147483647) / 2147483647.0 * 2 - 1


def recurrent(spark: SparkSession, kind: str, n: int) -> DataFrame:
    """Test series (t, x) whose steps build on the one before: random_walk, ar1 or lorenz (a noisy approach to a fixed point)."""
    u = lambda i: noise(i.cast("long"))
    forms = {
        "random_walk": (u(F.lit(0)), lambda x, i: x + u(i)),
        "ar1": (u(F.lit(0)), lambda x, i: F.lit(0.7) * x + F.lit(0.5) * u(i)),
        "lorenz": (F.lit(0.1), lambda x, i: x + F.lit(0.1) * (F.lit(10.0) * (F.lit(0.5) - x) + F.lit(0.1) * u(i))),
    }
    if kind not in forms:
        raise ValueError(f"unknown series {kind!r}: one of {sorted(forms)}")
    first, step = forms[kind]
    steps = F.sequence(F.lit(1), F.lit(n - 1)) if n > 1 else F.array().cast("array<int>")
    grown = F.aggregate(steps, F.array(first), lambda seen, i: F.concat(seen, F.array(step(F.element_at(seen, -1), i))))
    return spark.range(1).select(F.posexplode(grown).alias("t", "x")).withColumn("t", F.col("t").cast("long"))


def closed_form(spark: SparkSession, kind: str, n: int, amplitude: float = 1.0, frequency: float = 0.1) -> DataFrame:
    """Test series (t, x) by formula: sine, linear, constant or multi_frequency."""
    t = F.col("t").cast("double")
    forms = {
        "sine": amplitude * F.sin(2 * F.pi() * frequency * t),
        "linear": amplitude * t,
        "constant": F.lit(float(amplitude)),
        "random": amplitude * noise(F.col("t")),
        "noisy_sine": amplitude * F.sin(2 * F.pi() * frequency * t) + 0.1 * noise(F.col("t")),
        "multi_frequency": F.sin(2 * F.pi() * frequency * t) + 0.5 * F.sin(6 * F.pi() * frequency * t),
    }
    if kind not in forms:
        raise ValueError(f"unknown series {kind!r}: one of {sorted(forms)}")
    return spark.range(n).select(F.col("id").alias("t")).withColumn("x", forms[kind])


def logistic(spark: SparkSession, n: int, r: float = 3.8, x0: float = 0.4) -> DataFrame:
    """The logistic map, a recurrence, as a recursive query."""
    return spark.sql(
        f"WITH RECURSIVE s(t, x) AS (SELECT 0L, CAST({x0} AS DOUBLE) UNION ALL SELECT t + 1, {r}D * x * (1 - x) FROM s WHERE t < {n - 1}) SELECT t, x FROM s"
    )
