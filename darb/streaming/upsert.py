"""A ledger kept up to date by a stream: latest row per key, written as whole versions."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from darb.operators.metrics import latest


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def current_version(spark: SparkSession, path: str) -> int:
    """Highest version whose write finished, or -1."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return -1
    done = [s.getPath().getName() for s in fs.listStatus(p) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max((int(n[2:]) for n in done if n.startswith("v=")), default=-1)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    version = current_version(spark, path)
    return None if version < 0 else spark.read.parquet(os.path.join(path, f"v={version}"))


def upsert_batch(path: str, keys: list[str], order: list[str]):
    """A foreachBatch function: merges a micro-batch into the ledger and writes the next version.

    A batch that is run again writes the same version again, so restarts don't double rows; a version counts
    once it is complete.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = min(current_version(spark, path), batch_id - 1)
        rows = batch if before < 0 else spark.read.parquet(os.path.join(path, f"v={before}")).unionByName(batch)
        latest(rows, keys, order).write.mode("overwrite").parquet(os.path.join(path, f"v={batch_id}"))

    return run
