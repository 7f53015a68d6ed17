"""Profile texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def clean_profile(text: Column) -> Column:
    """Comments, placeholders and heading marks become blanks."""
    for pattern in (r"(?s)<!--.*?-->", r"\[PLACEHOLDER[^\]]*\]", r"(?mU)^#{1,6}\s+"):
        text = F.regexp_replace(text, pattern, " ")
    return text


def read_profiles(spark: SparkSession, path: str, profile_ids: list[str] | None = None) -> DataFrame:
    """One row per ``<profile_id>.md``; ids without a file are simply absent."""
    df = spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.md\z", 1).alias("profile_id"),
        F.col("value").alias("text"))
    return df.where(F.col("profile_id").isin(profile_ids)) if profile_ids else df


def with_stubs(profiles: DataFrame, ids: DataFrame) -> DataFrame:
    """The evaluator's reading: an id without a file gets a stub text."""
    stub = F.concat(F.lit("# "), F.col("profile_id"), F.lit("\n[Profil nicht gefunden]"))
    return ids.join(profiles, "profile_id", "left").withColumn("text", F.coalesce("text", stub))
