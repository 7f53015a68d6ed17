"""Incremental ingestion over landed entries.

State lives in snapshot folders ``v=<n>``; a snapshot counts once its marker is written.
Batch ``b`` reads snapshot ``b`` and writes snapshot ``b + 1``, so a repeated batch
rewrites the same result.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import urls
from ..model import FEED_ENTRY
from ..plans import routing
from ..plans.routing import Setup, State

TABLES = [f.name for f in dataclasses.fields(State)]


class SnapshotStore:
    """Versioned state tables in a folder that all executors share."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")

    def _path(self, version: int, name: str) -> str:
        return f"{self.base}/v={version}/{name}"

    def complete(self, version: int) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._path(version, "done/_SUCCESS"))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, version: int) -> State:
        if version == 0 or not self.complete(version):
            if version > 0:
                raise ValueError(f"snapshot {version} is not complete")
            return routing.empty_state(self.spark)
        return State(**{t: self.spark.read.parquet(self._path(version, t)) for t in TABLES})

    def write(self, version: int, state: State, extra: dict[str, DataFrame] | None = None) -> None:
        tables = {**{t: getattr(state, t) for t in TABLES}, **(extra or {})}
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(self._path(version, name))
        # The marker comes last: readers never see half a snapshot.
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(self._path(version, "done"))

    def table(self, name: str) -> DataFrame:
        """All versions of a per-run table such as the entry classes."""
        return self.spark.read.option("basePath", self.base).parquet(f"{self.base}/v=*/{name}")


def batch_writer(store: SnapshotStore, pages: Callable[[], DataFrame], setup: Setup) -> Callable[[DataFrame, int], None]:
    """The body of ``foreachBatch``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if store.complete(batch_id + 1):
            return
        result = routing.run(batch, store.read(batch_id), pages(), setup)
        store.write(batch_id + 1, result.state, {"classes": result.classes, "rejections": result.rejections})

    return write


def ingest(spark: SparkSession, landing: str, store: SnapshotStore, pages: Callable[[], DataFrame], setup: Setup,
           checkpoint: str, files_per_batch: int = 1000):
    """Process what has landed since the last run and stop."""
    entries = spark.readStream.schema(FEED_ENTRY).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    return entries.writeStream.foreachBatch(batch_writer(store, pages, setup)) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_stream(entries: DataFrame, undated: dt.datetime, delay: str = "120 days") -> DataFrame:
    """T2/T3, streaming form: one row per URL; its state expires with the watermark.

    Entries without a date count as published at ``undated``.
    """
    return entries.withColumn("url_key", urls.identity_url(F.col("link"))) \
        .withColumn("published", F.coalesce("published", F.lit(undated))) \
        .withWatermark("published", delay).dropDuplicatesWithinWatermark(["url_key"])


def drop_late(entries: DataFrame, key: list[str], delay: str = "7 days") -> DataFrame:
    """T7, event-time form: entries older than the watermark go, undated ones stay.

    A watermark drops rows only in an operator that keeps state, here one that knows the
    ``key`` of each entry until the watermark has passed it.
    """
    dated = entries.where(F.col("published").isNotNull())
    return dated.withWatermark("published", delay).dropDuplicatesWithinWatermark(key) \
        .unionByName(entries.where(F.col("published").isNull()))
