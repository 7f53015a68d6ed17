"""Schema upgrade with a collision gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..model import SCHEMA_VERSION
from ..sources.frontmatter import parse, to_records


class IdCollision(ValueError):
    """Two v1 rows would get the same id; nothing was written."""


def version_inventory(documents: DataFrame) -> DataFrame:
    """Rows per schema version; rows without a usable version are unreadable."""
    raw = F.col("header")["schema_version"]
    version = F.when(raw.isNull(), 1).otherwise(F.trim(raw).try_cast("int"))
    label = F.when(version.isNull(), "unreadable").when(version >= SCHEMA_VERSION, "v2").otherwise("v1")
    return documents.groupBy(label.alias("version")).agg(F.count("*").alias("n"))


def collisions(records: DataFrame) -> DataFrame:
    """Ids given to more than one row.

    Only ids and counts leave the aggregate, so one id on a third of all rows is no problem;
    join back by ``project_id`` for the rows themselves.
    """
    return records.where(F.coalesce("project_id", F.lit("")) != "").groupBy("project_id") \
        .agg(F.count("*").alias("n"), F.min("path").alias("first_path"), F.max("path").alias("last_path")) \
        .where("n > 1")


def upgrade(documents: DataFrame, target: str | None = None, dry_run: bool = True) -> DataFrame:
    """S3: documents (path, content) to v2 records; v2 rows pass through unchanged.

    The old path stays as it is and serves as the backup.  Running it again is a no-op,
    because upgraded rows are v2.
    """
    records = to_records(parse(documents))
    v1 = records.where(F.col("source_version") < SCHEMA_VERSION)
    clash = collisions(v1).limit(5).collect()  # a sample for the message
    if clash:
        raise IdCollision(", ".join(f"{r['project_id']} ({r['n']} rows)" for r in clash))
    if target and not dry_run:
        records.write.mode("errorifexists").partitionBy("state").parquet(target)
    return records
