"""Session defaults for local runs; on a cluster the submitted configuration is used as it is."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "auditframe") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_ready(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder the cluster names; only a local test gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir():
        return
    if named:
        spark.sparkContext.setCheckpointDir(named)
    elif spark.sparkContext.master.startswith("local"):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="auditframe-"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate table that several later steps read, and cut its lineage there.

    The rows go to the shared folder as Parquet, so they survive lost executors,
    and later plans start from a scan with column pruning and statistics.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written table, next to the checkpoints."""
    checkpoint_ready(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
