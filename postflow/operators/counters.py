"""Ingestion counters and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..model import CLASSES

GROUP_COUNTERS = ["entries_found", "projects_saved", "urls_skipped_dedupe", "projects_filtered",
                  "projects_unsuitable", "errors"]


def group_counters(outcomes: DataFrame) -> DataFrame:
    """Per group, per group and provider, and in total, in one pass.

    ``outcomes`` has one row per (entry, group) with an ``outcome``; ``level`` tells the
    granularity of a result row.
    """
    outcome = F.col("outcome")
    levels = F.when((F.grouping("group_id") == 0) & (F.grouping("provider") == 0), "group_provider") \
        .when(F.grouping("group_id") == 0, "group").otherwise("total")
    return outcomes.groupingSets(
        [["group_id", "provider"], ["group_id"], []], "group_id", "provider").agg(
        levels.alias("level"),
        F.count("*").alias("entries_found"),
        F.count_if(outcome == "created").alias("projects_saved"),
        F.count_if(outcome.isin("merged", "skipped", "known")).alias("urls_skipped_dedupe"),
        F.count_if(outcome == "filtered").alias("projects_filtered"),
        F.count_if(F.coalesce("unsuitable", F.lit(False))).alias("projects_unsuitable"),
        F.count_if(outcome == "errors").alias("errors"),
        F.count_if(outcome == "deferred").alias("deferred"))


def feed_counters(classes: DataFrame) -> DataFrame:
    """Per feed, entries and one count per class."""
    return classes.groupBy("label").agg(
        F.count("*").alias("entries"),
        *[F.count_if(F.col("entry_class") == c).alias(c) for c in CLASSES])


def provider_totals(summaries: DataFrame, measures: list[str]) -> DataFrame:
    """Sums per provider with the grand total (provider null)."""
    return summaries.rollup("provider").agg(*[F.sum(m).cast("bigint").alias(m) for m in measures])


def latest_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    """Newest first per schedule, bounded before the shuffle."""
    w = Window.partitionBy("schedule_id").orderBy(F.desc("started_at"), F.desc("run_id"))
    return runs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def run_statistics(runs: DataFrame) -> DataFrame:
    """Counts by status, durations and the last status per schedule."""
    seconds = F.unix_timestamp(F.try_to_timestamp("completed_at")) - F.unix_timestamp(F.try_to_timestamp("started_at"))
    return runs.groupBy("schedule_id").agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum(seconds).alias("total_seconds"), F.max(seconds).alias("max_seconds"),
        F.max_by("status", F.struct("started_at", "run_id")).alias("last_status"))


def run_output(steps: DataFrame) -> DataFrame:
    """Outputs of a run's steps in order; blank ones are left out."""
    said = F.when(F.trim(F.coalesce("output", F.lit(""))) != "", F.struct("step", "output"))
    return steps.groupBy("schedule_id", "run_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(said)), lambda s: s["output"]), "\n---\n").alias("output"),
        F.max_by("exit_code", "step").alias("exit_code"),
        F.bool_and(F.coalesce("success", F.lit(False))).alias("success"))
