"""Session helpers: local builder, and the shared folder for written tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cores: int | str = 8, shuffle_partitions: int = 8, checkpoint_dir: str | None = None
) -> SparkSession:
    """A local session for tests and the benchmark. Clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("norrsken")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        # Long rule lists fuse into methods that the JIT refuses to compile; beyond this size Spark
        # splits them instead, which more than halves the time of the base score and the gate.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # Recording the Python call site of every column call costs more than building the plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame written to and read back from the shared folder, which cuts its lineage.

    A written table survives lost executors, and its size is known to the planner.
    """
    folder = shared_folder(df.sparkSession, "checkpoint")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def sorted_side(df: DataFrame) -> DataFrame:
    """A side that grows with the data, for a sort-merge join.

    Spark takes a written table's size on disk, less the columns left out, for its size in memory. A few MB of
    well packed columns are millions of rows, which a broadcast would hold in the driver and in every executor.
    """
    return df.hint("merge")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unique folder below the cluster's ``spark.checkpoint.dir``.

    The setting is read from the session. Only a local session may lack it: driver and executors are
    then one process, and a temporary folder stands in until that process ends. On a cluster a missing
    setting is an error, because executors would write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="norrsken-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
