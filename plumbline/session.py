"""Session settings and shared scratch storage."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None
_written: list[str] = []


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A single-machine session for tests and benchmarks. Clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("plumbline")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def let_workers_import(spark: SparkSession) -> None:
    """Python workers look for this library where the driver has it (a cluster installs it there or elsewhere on the path)."""
    root = str(Path(__file__).resolve().parents[1])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared checkpoint folder.

    The folder is read from ``spark.checkpoint.dir``; only a local session without that
    setting gets a folder on this machine, since executors elsewhere could not read it.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        if _local_root is None:
            _local_root = tempfile.mkdtemp(prefix="plumbline-")
        root = _local_root
    _written.append(f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return _written[-1]


def release_scratch(spark: SparkSession) -> None:
    """Remove every folder that this process has named so far.

    For the end of a job, or between jobs: frames that were read from scratch cannot be read any more.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to shared scratch and read it back.

    Cuts the lineage so that several later passes see the same rows in the same
    partitions, survives the loss of executors, and stays columnar for pruned re-reads.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
