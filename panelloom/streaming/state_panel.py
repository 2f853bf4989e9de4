"""The hourly panel as an append-only stream with state: cells leave when the watermark has passed them, gaps are filled forward.

Each node keeps the sums of its open hours, its last hour that left and that hour's value. A timer stands at the end of the
earliest open hour; when the watermark passes it, the node's hours up to there leave in order, those without rows with the value
before them. Rows behind the watermark are late: Spark drops them before they reach the state, and a run tells how many.
State per node: the hours inside the watermark's delay, whatever the length of the stream. Restarts go on from the checkpoint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from panelloom.session import ship_package

HOUR = 3_600_000
SHAPE = "node long, ts timestamp, value double, observed boolean, filled double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Cells(StatefulProcessor):
    """Hours of one node. Milliseconds throughout; a cell is the mean of its rows to the nearest 1/64."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "hour long", "total double, n long")
        self.last = handle.getValueState("last", "hour long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sums: dict[int, tuple[float, int]] = {}
        for pdf in rows:
            hour = pdf["ms"] // HOUR * HOUR
            for h, g in pdf["value"].groupby(hour):
                total, n = sums.get(int(h), (0.0, 0))
                sums[int(h)] = (total + float(g.sum()), n + int(g.count()))
        seen = self.last.get()[0] if self.last.exists() else -1
        for h, (total, n) in sums.items():
            if h <= seen:  # its hour has left, though the row is not behind the watermark of this batch
                continue
            if self.open.containsKey((h,)):
                before = self.open.getValue((h,))
                total, n = total + before[0], n + before[1]
            self.open.updateValue((h,), (total, n))
            self.handle.registerTimer(h + HOUR)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        seen, value = self.last.get() if self.last.exists() else (-1, math.nan)
        hour = end - HOUR
        if not self.open.containsKey((hour,)):
            yield pd.DataFrame()
            return
        out = []
        for h in range(seen + HOUR if seen >= 0 else hour, hour, HOUR):
            out.append((h, None, False, None if math.isnan(value) else value))
        total, n = self.open.getValue((hour,))
        self.open.removeKey((hour,))
        # halves away from 0, as Spark rounds
        cell = math.copysign(math.floor(abs(total / n) * 64 + 0.5), total) / 64 if n else None
        value = value if cell is None else cell
        out.append((hour, cell, cell is not None, None if math.isnan(value) else value))
        self.last.update((hour, value))
        at, cells, observed, filled = zip(*out)
        yield pd.DataFrame({"node": key[0], "ts": pd.to_datetime(list(at), unit="ms"), "value": pd.array(cells, "Float64"), "observed": list(observed), "filled": pd.array(filled, "Float64")})

    def close(self) -> None:
        pass


def gap_filled(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """A stream (node, ts, value) as cells (node, ts, value, observed, filled), appended hour by hour of each node.

    Rows without a time or a value, or with NaN, are dropped; nodes that send nothing more send no more cells."""
    ship_package(events.sparkSession)
    rows = events.select(F.col("node").cast("long").alias("node"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value")).filter("ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")
    marked = rows.withWatermark("ts", delay).select("node", "ts", F.unix_millis("ts").alias("ms"), "value")
    return marked.groupBy("node").transformWithStateInPandas(Cells(), SHAPE, "Append", "eventTime")


def events_stream(spark: SparkSession, folder: str, glob: str = "*.parquet", nodes: int = 36, files: int | None = None) -> DataFrame:
    """Events of the Parquet files of a folder whose names match, as a stream (node, ts, value); at most `files` new files in a batch."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    return reader.parquet(folder).select((F.col("user_id") % nodes).alias("node"), "ts", "value")


def run_available(stream: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """Run a stream over what is there now, appending Parquet under folder/cells, with its checkpoint beside: all cells so far, and
    how many rows of this run came too late.

    Called again with new input, it goes on where it stopped. The state store is RocksDB, which keyed state with timers needs;
    the session's own choice is put back afterwards."""
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/cells").trigger(availableNow=True).start()
        query.awaitTermination()
        late = sum(state.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for state in p["stateOperators"])
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/cells"), late
