"""Retention sets."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.markdown import section_scores
from ..functions.text import with_fixed
from ..sources.inventory import age_days

# --- Fixed values: retention in days by category, thresholds, exclusions -----
RETENTION = {
    "logs": 30, "temp_files": 7, "backups": 365, "scraped": 7, "rejected_low_pre_eval": 1,
    "rejected_low_llm": 3, "rejected_other": 14, "accepted": 30, "applied": 90, "sent": 180,
    "open": 365, "archived": 180,
}
PRE_THRESHOLD, FIT_THRESHOLD = 10, 85
MAX_DELETIONS = 1000
EXCLUDED = [".git/**", "venv/**", "config.yaml", "requirements.txt", "README.md"]


def posting_category(state: Column, pre_score: Column, fit_score: Column,
                     pre_threshold: int = PRE_THRESHOLD, fit_threshold: int = FIT_THRESHOLD) -> Column:
    """F16: rejected postings are split by their scores."""
    state = F.coalesce(state, F.lit("scraped"))
    return F.when(state != "rejected", state) \
        .when(F.coalesce(pre_score, F.lit(0)) < pre_threshold, "rejected_low_pre_eval") \
        .when(F.coalesce(fit_score, F.lit(0)) < fit_threshold, "rejected_low_llm") \
        .otherwise("rejected_other")


def body_category(state: Column, body: Column) -> Column:
    pre, fit = section_scores(body)
    return posting_category(state, pre, fit)


def file_category(path: Column, posting: Column) -> Column:
    """Category by path; postings bring their own."""
    parts = F.split(path, "/")
    return F.when(path.endswith(".log") | F.array_contains(parts, "log"), "logs") \
        .when(F.array_contains(parts, "projects") & path.endswith(".md"), posting) \
        .when(path.rlike(r"\.(?:tmp|temp)\z") | F.array_contains(parts, "temp"), "temp_files") \
        .when(path.contains("backup"), "backups").otherwise("other")


def excluded(path: Column, patterns: list[str] = EXCLUDED) -> Column:
    """One test: whole paths by list, folders by one alternation."""
    folders = [re.escape(p[:-3]) for p in patterns if p.endswith("/**")]
    inside = path.rlike(rf"(?:^|/)(?:{'|'.join(folders)})/") if folders else F.lit(False)
    return path.isin([p for p in patterns if not p.endswith("/**")]) | inside


def purge_candidates(files: DataFrame, now: dt.datetime, retention: dict[str, int] | None = None) -> DataFrame:
    """F16: files (path, mtime, category) older than their category's retention."""
    days = retention or RETENTION
    limit = F.create_map(*[F.lit(v) for item in days.items() for v in item])[F.col("category")]
    order = F.create_map(*[F.lit(v) for i, c in enumerate(days) for v in (c, i)])[F.col("category")]
    aged = with_fixed(files, "age_days", age_days(F.col("path"), F.col("mtime"), now))
    return with_fixed(aged, "category", F.col("category")).withColumn("category_ord", order) \
        .where(limit.isNotNull() & ~excluded(F.col("path")) & (F.col("age_days") > limit))


def purge_set(candidates: DataFrame, max_deletions: int = MAX_DELETIONS, tie: str | None = None) -> DataFrame:
    """The first files in category order; a distributed top-n."""
    return candidates.orderBy("category_ord", "path", *([tie] if tie else [])).limit(max_deletions)


def purge_statistics(candidates: DataFrame, max_deletions: int = MAX_DELETIONS) -> DataFrame:
    """Found per category, and how many one run deletes."""
    found = candidates.groupBy("category", "category_ord").agg(F.count("*").alias("found"))
    before = F.coalesce(F.sum("found").over(Window.orderBy("category_ord").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))  # one row per category
    return found.withColumn("deleted", F.greatest(F.lit(0), F.least(
        F.col("found"), F.lit(max_deletions) - before)).cast("bigint")).drop("category_ord")
