"""Small DataFrame helpers that several operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelloom import session
from panelloom.session import release, shared_dir, stored, stored_by  # noqa: F401  operators take them from here

#: Rows and bytes of an Arrow batch to Python workers, where the session doesn't say (Spark's own are 10,000 rows and 64 MB):
#: whole texts, so less at once. Spark reads them when a query runs, so they stay set in the session.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}

#: Bits of the semi-filter: 2**25 bits are 1,024 rows of 4 KB, 4 MB, whatever the input; that bounds the broadcast.
FILTER_BITS = 1 << 25
_ROW_BITS = 32768


def ship_package(spark: SparkSession) -> None:
    """Make the package known to the executors, and batches of texts small where the session leaves that to Spark."""
    session.ship_package(spark)
    for name, small in BATCH.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, small)


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def key_bitmap(keys: DataFrame, key: Column) -> DataFrame:
    """A fixed-size bitmap of hashed keys: at most FILTER_BITS/32768 rows of 4 KB."""
    return (
        keys.select(_bit(key).alias("b"))
        .groupBy(F.expr(f"b div {_ROW_BITS}").alias("_slot"))
        .agg(F.expr(f"bitmap_construct_agg(b % {_ROW_BITS})").alias("_bits"))
    )


def maybe_in(df: DataFrame, key: Column, bitmap: DataFrame) -> DataFrame:
    """df with a boolean _maybe: false only where the key is surely not among the bitmap's; null keys are false.

    The broadcast side is the bitmap, of fixed size; false positives cost time only, an exact join follows.
    """
    hit = F.expr(f"shiftright(CAST(conv(hex(substring(_bits, CAST((_bit % {_ROW_BITS}) div 8 + 1 AS INT), 1)), 16, 10) AS INT), CAST(_bit % 8 AS INT)) & 1 = 1")
    return (
        df.withColumn("_bit", _bit(key))
        .withColumn("_slot", F.expr(f"_bit div {_ROW_BITS}"))
        .join(F.broadcast(bitmap), "_slot", "left")
        .withColumn("_maybe", F.coalesce(hit, F.lit(False)) & key.isNotNull())
        .drop("_slot", "_bits", "_bit")
    )


def without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """df without the rows whose keys (none null) are among those of gone; rows that the bitmap clears aren't shuffled."""
    split = maybe_in(df, F.xxhash64(*keys), key_bitmap(gone, F.xxhash64(*keys)))
    sure, others = split.filter("NOT _maybe").drop("_maybe"), split.filter("_maybe").drop("_maybe")
    return sure.unionByName(others.join(gone, keys, "left_anti"))


def with_columns(df: DataFrame, make, ddl: str) -> DataFrame:
    """df with the columns of ddl, made by the Arrow mapper make(kept): kept are df's columns to pass on.

    One rule for clashing names: a new column takes the place of df's columns of that name, whatever their case; the mapper
    still reads them. Columns are told apart as Spark does, so df must not have one name twice."""
    new = StructType.fromDDL(ddl)
    taken = {f.name.lower() for f in new.fields}
    kept = [c for c in df.columns if c.lower() not in taken]
    return df.mapInArrow(make(kept), StructType([*(df.schema[c] for c in kept), *new.fields]))


def batch(piece: pa.RecordBatch, kept: list[str], **new: pa.Array) -> pa.RecordBatch:
    """The kept columns of a piece and new ones."""
    return pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), *new.values()], names=[*kept, *new])
