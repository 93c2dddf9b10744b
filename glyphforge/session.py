"""Session helpers shared by tests, benchmarks and the command line."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "glyphforge", cores: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the library is tested with."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GLYPHFORGE_DRIVER_MEMORY", memory))
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where its files give fewer partitions than that; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def settle(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder and read from there, so that what reads it twice computes it once.

    Where no folder is named (spark.checkpoint.dir), a single machine gets one of its own; a
    cluster must name one.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="glyphforge-"))
    return df.checkpoint(eager=True)
