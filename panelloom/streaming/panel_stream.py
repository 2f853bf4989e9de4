"""The hourly panel as a stream: watermarked tumbling windows, equal to the batch panel's observed cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly_stream(spark: SparkSession, path: str, nodes: int = 36, late: str = "1 day") -> DataFrame:
    """A streaming aggregate over Parquet files of events in a folder."""
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).parquet(path)
    rows = events.select((F.col("user_id") % nodes).alias("node"), F.col("ts").cast("timestamp").alias("ts"), "value")
    cells = rows.withWatermark("ts", late).groupBy("node", F.window("ts", "1 hour").alias("w")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    return cells.select("node", F.col("w.start").alias("ts"), "value", "n")


def run_available(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now, into an in-memory table of the session (for tests and small results)."""
    query = stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
