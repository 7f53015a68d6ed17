"""Session helpers shared by the tests, the benchmark and the registered queries."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Names the number of tasks that local sessions deal the test texts to; unset on a cluster.
LOCAL_SPREAD = "spark.postflow.localSpread"


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("postflow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(LOCAL_SPREAD, str(os.cpu_count() if cores == "*" else cores))
        .config("spark.driver.memory", os.environ.get("POSTFLOW_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    ``spark.checkpoint.dir`` is the cluster's setting.  Only a session on one machine may do
    without: a temporary folder is made and remembered in the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """Hint a broadcast only when the known row count stays under ``limit``."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if rows <= limit else df
