"""Session settings that the plans rely on, lineage cuts that survive lost executors, and folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine. On a cluster the submitter makes the session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir as the session has it.

    Where it is unset, a temporary folder serves, but only for a master `local`, whose executors are on this machine; on a
    cluster that is an error, as executors would write to disks of their own.
    """
    context = spark.sparkContext
    there = context._jsc.sc().getCheckpointDir()
    if there.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lexspark-")
        context.setCheckpointDir(folder)
        there = context._jsc.sc().getCheckpointDir()
    return there.get()


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder for tables of a run, beside the checkpoints."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """`df`, written once to the folder in spark.checkpoint.dir. Files go when nothing refers to them any more and
    spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
