"""File inventory and run history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dates import file_timestamp


def scan_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Path, size and mtime.  The content column is pruned, so no file is opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", F.col("modificationTime").alias("mtime"))


def age_days(path: Column, mtime: Column, now: dt.datetime) -> Column:
    """Age by the timestamp in the file name, else by mtime."""
    name = F.element_at(F.split(path, "/"), -1)
    stamp = F.coalesce(file_timestamp(name), mtime)
    return (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(stamp)) / F.lit(86_400_000_000)


RUN_FILE = """schedules array<struct<id string, name string, enabled boolean,
 execution_history array<struct<run_id string, started_at string, completed_at string,
 status string, output string, error string, exit_code int,
 step_results array<struct<success boolean, output string, error string, exit_code int,
 started_at string, completed_at string>>>>>>"""


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return explode_runs(spark.read.schema(RUN_FILE).option("multiLine", "true").json(path))


def explode_runs(files: DataFrame) -> DataFrame:
    """One row per run; ``position`` 0 is the newest of its schedule."""
    return files.select(F.explode("schedules").alias("s")) \
        .select(F.col("s.id").alias("schedule_id"), F.col("s.name").alias("schedule_name"),
                F.posexplode("s.execution_history").alias("position", "run")) \
        .select("schedule_id", "schedule_name", "position", "run.*")


def explode_steps(runs: DataFrame) -> DataFrame:
    """One row per step."""
    return runs.select("schedule_id", "run_id",
                       F.posexplode("step_results").alias("step", "result")) \
        .select("schedule_id", "run_id", "step", "result.*")
