"""Keyed state as a log of deltas: a batch writes only the rows that it changes.

A delta folder ``delta=<batch>`` holds the new rows of a batch and tombstones of the keys it removes, dealt to
hash buckets of the key.  A reader merges the newest base with the deltas after it: the last row of a key
counts, unless it is a tombstone.  ``compact`` writes a base on its own schedule.  A folder counts once Spark has
put its success mark there; a repeated batch overwrites its own folder, so it changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

BATCH, GONE, BUCKET = "_batch", "_gone", "_bucket"


@dataclass(frozen=True)
class DeltaLog:
    """``schema`` are the columns of a row, of which ``keys`` name it; ``path`` is in a folder all executors share."""

    path: str
    keys: tuple[str, ...]
    schema: StructType
    buckets: int = 64

    def _folders(self, spark: SparkSession, kind: str) -> list[int]:
        """The numbers of the complete folders of a kind, ascending."""
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith(f"{kind}=")]
        done = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def complete(self, spark: SparkSession, batch: int) -> bool:
        return batch in self._folders(spark, "delta")

    def append(self, rows: DataFrame, batch: int) -> None:
        """Writes a batch's rows, one per key; those with a true column ``_gone`` remove their key."""
        gone = F.coalesce(GONE, F.lit(False)) if GONE in rows.columns else F.lit(False)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows.select(*self.schema.names, gone.alias(GONE), bucket.alias(BUCKET)).repartition(BUCKET).sortWithinPartitions(BUCKET, *self.keys) \
            .write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/delta={batch}")

    def _parts(self, spark: SparkSession, before: int | None) -> DataFrame:
        stored = StructType(list(self.schema.fields)).add(GONE, "boolean").add(BUCKET, IntegerType())
        base = max((b for b in self._folders(spark, "base") if before is None or b < before), default=None)
        after = [d for d in self._folders(spark, "delta") if (base is None or d > base) and (before is None or d < before)]
        parts = [] if base is None else [spark.read.schema(stored).parquet(f"{self.path}/base={base}").withColumn(BATCH, F.lit(-1))]
        if after:
            seen = StructType(list(stored.fields)).add("delta", IntegerType())
            deltas = spark.read.schema(seen).option("basePath", self.path).parquet(*[f"{self.path}/delta={d}" for d in after])
            parts.append(deltas.withColumnRenamed("delta", BATCH))
        if not parts:
            return spark.createDataFrame([], StructType(list(stored.fields)).add(BATCH, IntegerType()))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def read(self, spark: SparkSession, before: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """The rows as they are, or as they were before a batch; ``only`` names the keys that are asked for."""
        rows = self._parts(spark, before)
        if only is not None:
            rows = rows.join(only.select(*self.keys).distinct(), list(self.keys), "left_semi")
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*self.schema.names, GONE), BATCH).alias("_v"))
        return last.where(f"not _v.{GONE}").select(*[F.col(f"_v.{c}").alias(c) for c in self.schema.names])

    def compact(self, spark: SparkSession) -> None:
        """Merges all deltas into a new base; tombstones end here.  Readers of older batches keep the old folders."""
        deltas = self._folders(spark, "delta")
        if deltas:
            bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
            self.read(spark).select("*", F.lit(False).alias(GONE), bucket.alias(BUCKET)).repartition(BUCKET).sortWithinPartitions(BUCKET, *self.keys) \
                .write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/base={deltas[-1]}")
