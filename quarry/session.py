"""Spark session and shared-folder helpers.

On a cluster the shared folder comes from ``spark.checkpoint.dir`` and must be
set; a local temporary folder is made only for a local master without it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import SparkSession


def build_session(cores: int | str | None = None, shuffle_partitions: int | None = None,
                  app: str = "quarry") -> SparkSession:
    """A session with adaptive execution. ``cores`` asks for a local master
    with 16 GB; without it the master, the memory and the shuffle partitions
    are those that spark-submit or the defaults set (all local cores if no
    master is set at all)."""
    conf = SparkConf()
    builder = SparkSession.builder.appName(app)
    if cores is not None or not conf.contains("spark.master"):
        builder = builder.master(f"local[{cores or '*'}]")
        if not conf.contains("spark.driver.memory"):
            builder = builder.config("spark.driver.memory", "16g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = (
        builder
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    Uses ``spark.checkpoint.dir`` when the session has it; otherwise (local
    runs and tests only) makes a fresh temporary folder and registers it.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if root:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(root)
        return root
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-ckpt-",
                                         dir=os.environ.get("TMPDIR", "/tmp")))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder under the shared root for one written table."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def scratch_root(spark: SparkSession) -> str:
    """The application's own folder of written tables."""
    return f"{checkpoint_root(spark).rstrip('/')}/quarry-tables/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove the tables that this application wrote. Results that are still
    to be read must be saved before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

