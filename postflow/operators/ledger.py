"""Seen ledger and dispatch.

The ledger is two tables: one row per URL, and one row per (URL, group) decision.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import blank_to_null
from ..model import CAPTURED, CREATED, ERROR, EXISTING, FILTERED, MERGED, SKIPPED

# --- Fixed values: sizes kept in the ledger ----------------------------------
SUMMARY_CHARS, ERROR_CHARS, RETENTION_DAYS = 600, 300, 120

LEDGER_FILE = ("version int, entries map<string, struct<url:string,title:string,summary:string,"
               "provider:string,feed:string,first_seen:string,last_seen:string,status:string,"
               "basis:string,groups:map<string,struct<decision:string,terms:string>>,"
               "errors:int,last_error:string>>")


def from_json(files: DataFrame, raw: str = "value") -> tuple[DataFrame, DataFrame]:
    """Ledger files in map form to (entries, decisions); a corrupt file gives no rows.

    The other columns of ``files`` are kept in both: several files may know the same URL.
    """
    keep = [c for c in files.columns if c != raw]
    parsed = F.from_json(raw, LEDGER_FILE)
    rows = files.select(*keep, F.explode(parsed["entries"]).alias("url_key", "e"))
    entries = rows.select(
        *keep, "url_key", "e.url", "e.title", "e.summary", "e.provider", "e.feed",
        F.try_to_timestamp("e.first_seen").alias("first_seen"),
        F.try_to_timestamp("e.last_seen").alias("last_seen"),
        "e.status", "e.basis", "e.errors", "e.last_error")
    decisions = rows.select(*keep, "url_key", F.explode("e.groups").alias("group_id", "d")) \
        .select(*keep, "url_key", "group_id", "d.decision", "d.terms")
    return entries, decisions


def valid_decision(decision: Column, stored: Column, current: Column, status: Column) -> Column:
    """Captured and existing always hold, filtered only under the same rules."""
    return F.when(status == ERROR, F.lit(None).cast("string")) \
        .when(decision.isin(CAPTURED, EXISTING), decision) \
        .when(stored == current, decision)


def lookup(entries: DataFrame, ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """(url_key, group_id, terms, …) plus the valid ``decision``; null means pending."""
    status = ledger.select("url_key", F.col("status").alias("_status"))
    stored = decisions.select("url_key", "group_id", F.col("decision").alias("_d"), F.col("terms").alias("_t"))
    return entries.join(status, "url_key", "left").join(stored, ["url_key", "group_id"], "left") \
        .withColumn("decision", valid_decision(F.col("_d"), F.col("_t"), F.col("terms"), F.col("_status"))) \
        .drop("_status", "_d", "_t")


def status_of(decisions: DataFrame) -> DataFrame:
    """Captured over existing over filtered, as the maximum of a priority."""
    rank = F.when(F.col("decision") == CAPTURED, 3).when(F.col("decision") == EXISTING, 2).otherwise(1)
    return decisions.groupBy("url_key").agg(F.max(rank).alias("_r")).select(
        "url_key", F.when(F.col("_r") == 3, CAPTURED).when(F.col("_r") == 2, EXISTING)
        .otherwise(FILTERED).alias("status"))


def merge_decisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new decision of a (URL, group) replaces the old one."""
    both = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)))
    return both.groupBy("url_key", "group_id").agg(
        F.max_by(F.struct("decision", "terms"), "_gen").alias("v")).select("url_key", "group_id", "v.*")


def sightings(entries: DataFrame, now: dt.datetime) -> DataFrame:
    """One ledger row per URL seen now; the last sighting gives title and summary,
    the first one URL, provider and feed."""
    order = F.struct("feed", "entry_ord")
    return entries.groupBy("url_key").agg(
        F.min_by(F.struct(F.col("link").alias("url"), "provider", "feed"), order).alias("a"),
        F.max_by(F.struct("title", F.substring(F.coalesce("summary", F.lit("")), 1, SUMMARY_CHARS)
                          .alias("summary")), order).alias("b")) \
        .select("url_key", "a.url", "b.title", "b.summary", "a.provider", "a.feed",
                F.lit(now).cast("timestamp").alias("first_seen"),
                F.lit(now).cast("timestamp").alias("last_seen"))


def merge_ledger(ledger: DataFrame, seen: DataFrame, decisions: DataFrame, basis: DataFrame,
                 errors: DataFrame, now: dt.datetime, max_age_days: int = RETENTION_DAYS) -> DataFrame:
    """The next ledger snapshot.

    ``decisions`` are all merged decisions, ``basis`` (url_key, basis) the URLs decided in
    this run and ``errors`` (url_key, error) its failures.  ``first_seen`` is kept, rows not
    seen for ``max_age_days`` are dropped, a failure keeps earlier decisions.
    """
    names = ["url", "title", "summary", "provider", "feed", "first_seen", "last_seen"]
    new = seen.select("url_key", *[F.col(c).alias(f"_{c}") for c in names])
    df = ledger.join(new, "url_key", "full_outer") \
        .join(status_of(decisions).withColumnRenamed("status", "_status"), "url_key", "left") \
        .join(basis.withColumnRenamed("basis", "_basis"), "url_key", "left") \
        .join(errors.withColumnRenamed("error", "_error"), "url_key", "left")
    failed = F.col("_error").isNotNull()
    merged = df.select(
        "url_key", F.coalesce("url", "_url").alias("url"),
        F.coalesce("_title", "title").alias("title"), F.coalesce("_summary", "summary").alias("summary"),
        F.coalesce("provider", "_provider").alias("provider"), F.coalesce("feed", "_feed").alias("feed"),
        F.coalesce("first_seen", "_first_seen").alias("first_seen"),
        F.coalesce("_last_seen", "last_seen").alias("last_seen"),
        F.when(failed & F.col("_status").isNull(), ERROR)
        .otherwise(F.coalesce("_status", "status")).alias("status"),
        F.coalesce("_basis", "basis").alias("basis"),
        (F.coalesce("errors", F.lit(0)) + failed.cast("int")).alias("errors"),
        F.when(failed, F.substring("_error", 1, ERROR_CHARS))
        .when(F.col("_basis").isNull(), F.col("last_error")).alias("last_error"))
    return expire(merged, now, max_age_days)


def expire(ledger: DataFrame, now: dt.datetime, max_age_days: int = RETENTION_DAYS) -> DataFrame:
    """T3."""
    return ledger.where(F.col("last_seen") >= F.lit(now - dt.timedelta(days=max_age_days)))


def stale(ledger: DataFrame, decisions: DataFrame, current: DataFrame, seen: DataFrame) -> DataFrame:
    """Filtered URLs outside the feed, per group whose rules have changed since.

    ``current`` is (group_id, terms) — one row per group, so it is broadcast.
    """
    now_terms = F.broadcast(current.select("group_id", F.col("terms").alias("_now")))
    filtered = ledger.where(F.col("status") == FILTERED).join(seen.select("url_key"), "url_key", "left_anti")
    return filtered.join(decisions, "url_key").join(now_terms, "group_id") \
        .where(~F.col("terms").eqNullSafe(F.col("_now"))).drop("_now")


def merge_postings(existing: DataFrame, captured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next postings, actions).

    ``captured`` has one row per (project_id, group_id) with the posting fields and the
    sighting (provider, url, discovered_at, channel).  Groups and sources are appended once,
    in order; identity is ``project_id`` alone.
    """
    old_groups = existing.select("project_id", F.posexplode("search_groups").alias("_o", "group_id")) \
        .select("project_id", "group_id").withColumn("_has", F.lit(True))
    ids = existing.select("project_id").withColumn("_known", F.lit(True))
    keyed = captured.join(ids, "project_id", "left").join(old_groups, ["project_id", "group_id"], "left")
    # The first group of an unknown posting creates it, its other groups are merged in.
    first = captured.groupBy("project_id").agg(F.min("group_ord").alias("_first"))
    keyed = keyed.join(first, "project_id")
    action = F.when(F.col("_has").isNotNull(), SKIPPED) \
        .when(F.col("_known").isNull() & (F.col("group_ord") == F.col("_first")), CREATED).otherwise(MERGED)
    actions = keyed.withColumn("action", action).select(
        "project_id", "group_id", "url", "provider", "action")

    fields = ["title", "description", "created_at"]
    new = captured.groupBy("project_id").agg(
        F.min_by(F.struct(*fields), F.struct("group_ord", "url")).alias("n"),
        # Distinct groups of one posting: bounded by the configuration.
        F.array_sort(F.collect_set(F.struct("group_ord", "group_id"))).alias("g"))
    sources = first_sources(captured)
    nested = sources.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct(
        "ord", F.struct("provider", "url", "discovered_at", "channel").alias("s")))).alias("s"))
    incoming = new.join(nested, "project_id").select(
        "project_id", *[F.col(f"n.{f}").alias(f"_{f}") for f in fields],
        F.transform("g", lambda x: x["group_id"]).alias("_groups"),
        F.transform("s", lambda x: x["s"]).alias("_sources"))
    empty_g = F.expr("cast(array() as array<string>)")
    old_sources = F.coalesce("sources", F.slice("_sources", 1, 0))
    fresh = F.filter(F.coalesce("_sources", F.slice("sources", 1, 0)), lambda s: ~F.exists(
        old_sources, lambda o: o["url"] == s["url"]))
    postings = existing.join(incoming, "project_id", "full_outer").select(
        "project_id", *[F.coalesce(f, f"_{f}").alias(f) for f in fields],
        F.coalesce("state", F.lit("scraped")).alias("state"),
        F.array_union(F.coalesce("search_groups", empty_g), F.coalesce("_groups", empty_g)).alias("search_groups"),
        F.concat(old_sources, fresh).alias("sources"))
    return postings, actions


def first_sources(sightings_: DataFrame) -> DataFrame:
    """W13 in long form: the first sighting of every (posting, URL), as an aggregate."""
    order = F.struct("discovered_at", "provider", "channel")
    return sightings_.groupBy("project_id", "url").agg(
        F.min_by(F.struct("provider", "discovered_at", "channel"), order).alias("v")) \
        .select("project_id", "url", "v.*") \
        .withColumn("ord", F.struct("discovered_at", "url"))


def processed_keys(captured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys to add after a run: project ids and ``provider:url`` keys."""
    return (captured.select("project_id").distinct(),
            captured.select(F.concat("provider", F.lit(":"), "url_key").alias("url_key")).distinct())


def processed_count(keys: DataFrame, provider: str | None = None) -> DataFrame:
    """A17."""
    hit = F.lit(True) if provider is None else F.col("url_key").startswith(f"{provider}:")
    return keys.agg(F.count_if(hit).alias("n"))


def nonblank_link(entries: DataFrame) -> DataFrame:
    return entries.where(blank_to_null(F.trim("link")).isNotNull())
