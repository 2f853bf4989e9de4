"""Session helpers: a local session for tests, shared storage for cut lineage, and shipping the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own
    (tests), and a cluster an error, since its machines would not see each other's files."""
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir", None):
        return folder
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(sc, "_own_shared_dir", None):
        sc._own_shared_dir = "file://" + tempfile.mkdtemp(prefix="panelloom-")
    return sc._own_shared_dir


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def stored_by(df: DataFrame, key: str, parts: int, name: str = "step") -> DataFrame:
    """As stored, in `parts` buckets by the key: joins on the key with frames dealt into as many parts don't shuffle it."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{table}"
    df.write.bucketBy(parts, key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._stored_at = path
    out.schema  # resolved: the files stay when the name goes
    spark.sql(f"DROP TABLE {table}")
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of stored frames that nothing will read again: what was made of them is stored itself."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once a context, so that Python tasks can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_panelloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="panelloom-ship-"), "panelloom_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    sc._panelloom_shipped = True
