"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that suit both a laptop and a cluster.  The shuffle partition count
# is an upper bound: adaptive execution coalesces it to the data.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # window groups up to this many rows stay in plain memory; the default of 4096
    # sends every mid-sized group through a sorter
    "spark.sql.windowExec.buffer.in.memory.threshold": "65536",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: str = "8", partitions: int = 8, app: str = "compovec") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(partitions))
    b = b.config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", os.environ.get("COMPOVEC_DRIVER_MEMORY", "8g"))
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where it is unset and the session is local does a temporary folder
    stand in; a cluster session without the setting is an error, because a
    machine-local folder would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="compovec-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut the lineage by writing a table to the shared folder and reading it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files of frames that nobody holds any more go now, not when the driver happens to collect its garbage: for loops of large rounds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def is_small(df: DataFrame, max_bytes: int = 64 * 1024 * 1024) -> bool:
    """Whether the optimizer's size estimate of a plan is below a broadcast bound."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes())) <= max_bytes


def spread(df: DataFrame, max_bytes: int = 1 << 30) -> DataFrame:
    """Spread a small scan over all cores.

    A file with one row group is read by one task however many cores there are.
    Below ``max_bytes`` a round-robin exchange costs little and lets the heavy
    text expressions run in parallel; larger inputs have enough splits already
    and pass through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if cores > 1 and len(df.inputFiles()) < cores and is_small(df, max_bytes):
        return df.repartition(cores)
    return df
