"""Shared storage for intermediate tables.

Intermediate results are written as Parquet below the folder named by ``spark.checkpoint.dir``: a
lost executor then costs a re-read instead of a recomputation, and later reads prune columns. Only
where a session names no folder (tests on one machine) a local one is set.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; sets a temporary one only where the session has none."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="actaspark-")
        spark.sparkContext.setCheckpointDir(held)
        spark.conf.set("spark.checkpoint.dir", held)
    return held.rstrip("/")


def materialise(df: DataFrame, name: str = "t", partition_by: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back, so its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/actaspark/{name}-{uuid.uuid4().hex}"
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release() -> None:
    """Removes every table written by ``materialise`` so far."""
    while _written:
        spark, path = _written.pop()
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone; then only a local folder can still be removed
            local = path.removeprefix("file://")
            if os.path.isdir(local):
                import shutil

                shutil.rmtree(local, ignore_errors=True)


atexit.register(release)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than that plus one."""
    return df.limit(rows + 1).count() <= rows


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if its files give fewer (a file of one row group is one partition).

    Larger inputs have more partitions than cores and pass through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df
