"""What runs leave behind: metrics and graph records as JSON, imputations as a table, specifications as JSON text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.operators.spatial import SimilarityGraph


def run_record(config: dict, epochs: DataFrame, metrics: DataFrame, timings: DataFrame) -> DataFrame:
    """One row (record): a run's configuration, epoch rows (phase, epoch, metric, value), scores and timings as a JSON text.

    epochs has some rows an epoch; metrics and timings are single rows."""
    listed = epochs.agg(F.sort_array(F.collect_list(F.struct("epoch", "phase", "metric", "value"))).alias("epochs"))
    scores = metrics.select(F.struct("*").alias("prediction_metrics"))
    times = timings.select(F.struct("*").alias("timings"))
    whole = listed.join(F.broadcast(scores)).join(F.broadcast(times))  # one row each
    fixed = F.parse_json(F.lit(json.dumps(config, sort_keys=True)))
    return whole.select(F.to_json(F.struct(fixed.alias("config"), "epochs", "prediction_metrics", "timings")).alias("record"))


def write_json(df: DataFrame, path: str) -> None:
    """A row a line, by Spark's own writer."""
    df.write.mode("overwrite").json(path)


IMPUTATION = ["ts", "node", "prediction", "target", "eval", "observed"]


def imputation_table(rows: DataFrame) -> DataFrame:
    """Cells with their imputation: ts, node, prediction, target, eval, observed."""
    return rows.select("ts", "node", "prediction", F.col("value").alias("target"), "eval", "observed")


def write_imputation(rows: DataFrame, path: str) -> None:
    imputation_table(rows).write.mode("overwrite").option("compression", "gzip").parquet(path)


def save_spec(graph: SimilarityGraph, path: str) -> None:
    """The specification as JSON text, by Spark's writer, so that any store will do."""
    from pyspark.sql import SparkSession

    SparkSession.active().createDataFrame([(json.dumps(graph.to_dict(), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_spec(path: str) -> SimilarityGraph:
    from pyspark.sql import SparkSession

    return SimilarityGraph.from_dict(json.loads(SparkSession.active().read.text(path).first()[0]))
