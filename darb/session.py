"""Session defaults and the one way lineage is cut: reliable checkpoints in the cluster's shared folder."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has at most so many rows (of a few numbers each: under 10 MB).
BROADCAST_ROWS = 100_000


def local_session(app: str = "darb", cpus: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of spark.checkpoint.dir; only a local master may do without that setting (as tests do) and gets a temporary folder.

    On a cluster a missing setting is an error, as a folder of one machine would not outlive an executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "darb-checkpoints"))


def durable(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint of `df`, which survives the loss of any executor.

    Spark removes its files once nothing refers to it if spark.cleaner.referenceTracking.cleanCheckpoints is set, as
    local_session() does; else they stay until the folder is emptied.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
