"""The ingestion pass: entries to decisions, postings and the next ledger."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import terms as T, urls
from ..functions.text import rstrip
from ..model import CAPTURED, ERROR, EXISTING, FILTERED
from ..operators import ledger as L, lifecycle, matching, suitability
from ..session import broadcast_if_small, cut_lineage
from ..sources import config, feeds
from ..sources.config import SearchGroup

# --- Fixed values: marks of appended sections --------------------------------
APPENDED = r"## Vorbewertung|## 🤖 AI Evaluation Results"


@dataclass(frozen=True)
class State:
    """What earlier runs left behind."""

    ledger: DataFrame       # model.LEDGER
    decisions: DataFrame    # model.LEDGER_DECISION
    processed: DataFrame    # project_id
    postings: DataFrame     # project_id, title, description, created_at, state, search_groups, sources


@dataclass(frozen=True)
class Setup:
    groups: list[SearchGroup]
    now: dt.datetime
    prefilter: list = field(default_factory=list)
    max_page_reads: int | None = None  # W9: pages one run may read
    suitability_rules: dict | None = None
    channel: str = "rss"


@dataclass(frozen=True)
class Outcome:
    routed: DataFrame       # one row per URL, checkpointed
    classes: DataFrame      # one row per entry with its class
    outcomes: DataFrame     # one row per (entry, group)
    rejections: DataFrame   # one row per rejected (URL, group)
    state: State            # for the next run
    actions: DataFrame      # created / merged / skipped per (project, group)


def scan_entries(entries: DataFrame, setup: Setup) -> DataFrame:
    """Subscribed entries with their groups and keys."""
    spark = entries.sparkSession
    subs = config.subscriptions(spark, setup.groups)
    shared = config.shared_feeds(subs)
    largest = max((limit for g in setup.groups for _, _, limit, _ in g.feeds if limit), default=0)
    joined = entries.join(F.broadcast(shared), ["provider", "feed"])  # configuration-sized
    found = feeds.first_entries(joined, limit="limit", max_limit=largest, by=("provider", "feed"))
    found = L.nonblank_link(feeds.recent(found, setup.now, "max_age_days"))
    return found.withColumn("url_key", urls.identity_url(F.col("link"))) \
        .withColumn("project_id", urls.project_id(F.col("link"), F.col("title"))) \
        .drop("limit", "max_age_days")


def _per_url(entries: DataFrame) -> DataFrame:
    """One row per URL: its first sighting and the union of its feeds' groups."""
    order = F.struct("feed", "entry_ord")
    return entries.groupBy("url_key").agg(
        F.min_by(F.struct("link", "title", "summary", "provider", "feed", "entry_ord", "project_id"), order).alias("v"),
        F.array_distinct(F.flatten(F.collect_set("groups"))).alias("groups")).select("url_key", "v.*", "groups")


def _open_groups(rows: DataFrame, state: State, setup: Setup) -> DataFrame:
    """J4 on one row per URL: still open groups, and whether any is captured already."""
    stored = state.decisions.groupBy("url_key").agg(  # at most one entry per group
        F.map_from_entries(F.collect_list(F.struct("group_id", F.struct("decision", "terms")))).alias("_stored"))
    status = state.ledger.select("url_key", F.col("status").alias("_status"))
    df = rows.join(status, "url_key", "left").join(stored, "url_key", "left")
    current = F.create_map(*[F.lit(v) for g in setup.groups for v in (g.group_id, g.fingerprint)])

    def valid(g: Column) -> Column:
        entry = F.col("_stored")[g]
        return L.valid_decision(entry["decision"], entry["terms"], current[g], F.coalesce("_status", F.lit("")))

    return df.withColumn("had_decisions", F.coalesce(F.size("_stored"), F.lit(0)) > 0) \
        .withColumn("any_captured", F.exists("groups", lambda g: F.coalesce(
            valid(g).isin(CAPTURED, EXISTING), F.lit(False)))) \
        .withColumn("pending", F.filter("groups", lambda g: valid(g).isNull())) \
        .withColumn("settled", F.filter(F.transform("groups", lambda g: F.struct(
            g.alias("group_id"), valid(g).alias("decision"))), lambda s: s["decision"].isNotNull())) \
        .drop("_status", "_stored")


def take_pages(rows: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` pages of the run, by a distributed top-n; the rest is deferred."""
    if n is None:
        return rows.withColumn("deferred", F.lit(False))
    wanted = F.col("needs_page")
    taken = rows.where(wanted).select("url_key", "feed", "entry_ord").orderBy("feed", "entry_ord", "url_key") \
        .limit(n).select("url_key", F.lit(True).alias("_taken"))
    return rows.join(broadcast_if_small(taken, n), "url_key", "left") \
        .withColumn("deferred", wanted & F.col("_taken").isNull()).drop("_taken")


def route(entries: DataFrame, state: State, pages: DataFrame, setup: Setup) -> DataFrame:
    """One row per URL with its route and the filter result of every open group.

    ``pages`` holds (url_key, page_title, description, schlagworte) of landed pages; a
    page that has not landed is a failed read.
    """
    rows = _open_groups(_per_url(entries), state, setup)
    known = state.processed.select("project_id").distinct().withColumn("_known", F.lit(True))
    rows = rows.join(known, "project_id", "left").withColumn("known", F.coalesce("_known", F.lit(False))).drop("_known")
    is_open = F.size("pending") > 0
    excluded = matching.title_prefilter(F.col("title"), F.col("summary"), T.compile_terms(setup.prefilter),
                                        setup.groups, F.col("pending"))
    rows = rows.withColumn("excluded_by", F.when(is_open & ~F.col("known"), excluded))
    rows = rows.withColumn("needs_page", is_open & ~F.col("known") & F.col("excluded_by").isNull())
    # Cheap decisions first: page texts are joined to the few URLs that need them.
    rows = take_pages(cut_lineage(rows), setup.max_page_reads)
    to_read = rows.where(F.col("needs_page") & ~F.col("deferred")).select("url_key")
    if setup.max_page_reads is not None:
        # At most the cap, so the page table is filtered where it lies.
        to_read = broadcast_if_small(to_read, setup.max_page_reads)
    texts = pages.join(to_read, "url_key", "left_semi").withColumn("_landed", F.lit(True))
    rows = rows.join(texts, "url_key", "left")
    # Stored texts likewise: only of known postings that a changed or new group asks about.
    asked = rows.where(is_open & F.col("known") & F.col("had_decisions")).select("project_id").distinct()
    stored = state.postings.join(asked, "project_id", "left_semi").select(
        "project_id", F.col("title").alias("_old_title"), F.col("description").alias("_old_text"))
    rows = rows.join(stored, "project_id", "left")

    old_text = rstrip(F.element_at(F.split("_old_text", APPENDED, 2), 1))
    from_page = F.col("needs_page")
    rows = rows.withColumn("route", F.when(~is_open, "decided")
                           .when(F.col("known") & ~F.col("had_decisions"), "existing")
                           .when(F.col("excluded_by").isNotNull(), "prefiltered")
                           .when(F.col("deferred"), "deferred")
                           .when(from_page & F.col("_landed").isNull(), "error")
                           .when(~from_page & F.col("_old_text").isNull(), "error")
                           .otherwise("check"))
    checked = rows.withColumnRenamed("title", "entry_title") \
        .withColumn("title", F.when(from_page, F.coalesce("page_title", "entry_title"))
                    .otherwise(F.coalesce("_old_title", "entry_title"))) \
        .withColumn("description", F.when(from_page, F.col("description")).otherwise(old_text)) \
        .withColumn("entry_summary", F.col("summary")).drop("summary", "_old_title", "_old_text", "page_title", "_landed")
    checked = matching.with_texts(checked)
    results = matching.filter_results(checked, setup.groups, setup.now, "pending")
    return checked.withColumn("results", F.when(F.col("route") == "check", results)
                              .otherwise(F.slice(results, 1, 0))) \
        .drop("full_text", "topic_low", "full_low")


def _decisions(routed: DataFrame, setup: Setup) -> DataFrame:
    """New decisions per (URL, group); failures and deferrals decide nothing."""
    current = F.create_map(*[F.lit(v) for g in setup.groups for v in (g.group_id, g.fingerprint)])
    blanket = F.when(F.col("route") == "existing", EXISTING).when(F.col("route") == "prefiltered", FILTERED)
    decided = F.when(blanket.isNotNull(), F.transform("pending", lambda g: F.struct(
        g.alias("group_id"), blanket.alias("decision")))) \
        .otherwise(F.transform("results", lambda r: F.struct(
            r["group_id"].alias("group_id"), F.when(r["passed"], CAPTURED).otherwise(FILTERED).alias("decision"))))
    return routed.select("url_key", F.explode(decided).alias("d")).select(
        "url_key", "d.group_id", "d.decision", current[F.col("d.group_id")].alias("terms"))


def _class_of(route_: Column, any_captured: Column, passed: Column, known: Column) -> Column:
    kept = F.when(any_captured, "known").otherwise("filtered")
    return F.when(route_ == "existing", "known").when(route_ == "deferred", "deferred") \
        .when(route_ == "error", "errors").when((route_ == "check") & passed & ~known, "new") \
        .when((route_ == "check") & passed, "known").otherwise(kept)


def run(entries: DataFrame, state: State, pages: DataFrame, setup: Setup, replay: bool = False) -> Outcome:
    """One pass.  ``replay`` also re-opens filtered URLs whose rules changed."""
    spark = entries.sparkSession
    active = config.active_groups(setup.groups)
    setup = Setup(active, setup.now, setup.prefilter, setup.max_page_reads, setup.suitability_rules, setup.channel)
    scanned = scan_entries(entries, setup)
    to_route = scanned
    if replay:
        current = spark.createDataFrame([(g.group_id, g.fingerprint) for g in active], "group_id string, terms string")
        stale = L.stale(state.ledger, state.decisions, current, scanned.select("url_key").distinct())
        reopened = stale.groupBy("url_key").agg(F.collect_set("group_id").alias("groups"), F.first(F.struct(
            F.col("url").alias("link"), "title", "summary", "provider")).alias("v")).select(
            "url_key", "v.*", "groups", F.lit("NEUBEWERTUNG").alias("feed"), F.lit(0).cast("bigint").alias("entry_ord"))
        to_route = scanned.unionByName(reopened.withColumn(
            "project_id", urls.project_id(F.col("link"), F.col("title"))), allowMissingColumns=True)
    routed = cut_lineage(route(to_route, state, pages, setup))

    passed = F.exists("results", lambda r: r["passed"])
    url_class = routed.select("url_key", F.col("feed").alias("_feed"), F.col("entry_ord").alias("_ord"), "known",
                              _class_of(F.col("route"), F.col("any_captured"), passed, F.col("known")).alias("_class"),
                              "route", "pending", "settled", "results")
    seen = to_route.select("provider", "feed", "entry_ord", "url_key", "groups").join(url_class, "url_key")
    first = (F.col("feed") == F.col("_feed")) & (F.col("entry_ord") == F.col("_ord"))
    # A repeated sighting finds what the first one decided.
    entry_class = F.when(~first & (F.col("_class") == "new"), "known").otherwise(F.col("_class"))
    seen = seen.withColumn("entry_class", entry_class).withColumn("first", first)
    label = F.when(F.col("feed") == "NEUBEWERTUNG", F.col("feed")).otherwise(
        urls.feed_label(F.col("provider"), F.col("feed")))
    classes = seen.select("provider", "feed", "entry_ord", "url_key", label.alias("label"), "entry_class")
    outcomes = seen.select("provider", "feed", "entry_ord", "url_key", "first", "known", "route", "pending",
                           "settled", "results", F.explode("groups").alias("group_id")) \
        .withColumn("outcome", _group_outcome()).drop("pending", "settled", "results", "route", "first", "known")

    new_decisions = _decisions(routed, setup)
    decisions = cut_lineage(L.merge_decisions(state.decisions, new_decisions))
    basis = routed.where(F.col("route").isin("existing", "prefiltered", "check")).select(
        "url_key", F.when(F.col("route") == "existing", "existing").when(F.col("route") == "prefiltered", "rss_title")
        .when(F.col("known"), "file").otherwise("page").alias("basis"))
    errors = routed.where(F.col("route") == "error").select("url_key", F.lit("page not available").alias("error"))
    next_ledger = L.merge_ledger(state.ledger, L.sightings(scanned, setup.now), decisions, basis, errors, setup.now)
    decisions = decisions.join(next_ledger.select("url_key"), "url_key", "left_semi")

    captured, rejected = _captured(routed, setup)
    postings, actions = L.merge_postings(state.postings, captured)
    if rejected is not None:
        events = lifecycle.auto_rejections(
            actions.where("action = 'created'").select("project_id", "action").distinct().join(rejected, "project_id"))
        postings = postings.join(events.select("project_id", F.lit(True).alias("_no")), "project_id", "left") \
            .withColumn("state", F.when(F.col("_no").isNotNull(), "rejected").otherwise(F.col("state"))).drop("_no")
    rejections = _rejections(routed, setup)
    processed = state.processed.select("project_id").unionByName(captured.select("project_id")).distinct()
    return Outcome(routed, classes, outcomes, rejections,
                   State(next_ledger, decisions, processed, postings), actions)


def _group_outcome() -> Column:
    g = F.col("group_id")
    result = F.get(F.filter("results", lambda r: r["group_id"] == g), F.lit(0))
    settled = F.get(F.filter("settled", lambda r: r["group_id"] == g), F.lit(0))["decision"]
    # The first passing group creates a posting, the others are merged into it.
    creator = F.get(F.filter("results", lambda r: r["passed"]), F.lit(0))["group_id"]
    return F.when(settled.isin(CAPTURED, EXISTING), "known").when(settled == FILTERED, "filtered") \
        .when(F.col("route") == "existing", "known").when(F.col("route") == "prefiltered", "filtered") \
        .when(F.col("route") == "deferred", "deferred").when(F.col("route") == ERROR, "errors") \
        .when(~result["passed"], "filtered") \
        .when(~F.col("first"), "known") \
        .when(~F.col("known") & (creator == g), "created").otherwise("merged")


def _captured(routed: DataFrame, setup: Setup) -> tuple[DataFrame, DataFrame | None]:
    """Passing (posting, group) rows, and the postings whose suitability is a rejection."""
    passing = routed.where(F.exists("results", lambda r: r["passed"]))
    rejected = None
    if setup.suitability_rules:
        rejected = suitability.score(passing.select("project_id", "title", "description", "schlagworte"),
                                     setup.suitability_rules, setup.now.date()) \
            .select("project_id", F.col("suitability.reject_reason").alias("reject_reason"))
    order = F.create_map(*[F.lit(v) for i, g in enumerate(setup.groups) for v in (g.group_id, i)])
    rows = passing.select(
        "url_key", "project_id", F.col("link").alias("url"), "provider", "title", "description",
        F.lit(setup.now.isoformat()).alias("created_at"), F.lit(setup.now.isoformat()).alias("discovered_at"),
        F.lit(setup.channel).alias("channel"), F.explode(F.filter("results", lambda r: r["passed"])).alias("r"))
    return rows.withColumn("group_id", F.col("r.group_id")).withColumn(
        "group_ord", order[F.col("r.group_id")]).drop("r"), rejected


def _rejections(routed: DataFrame, setup: Setup) -> DataFrame:
    """What to append to the rejection log."""
    failed = routed.select("link", "title", "provider", F.explode(
        F.filter("results", lambda r: ~r["passed"])).alias("r")).select(
        F.col("r.group_id").alias("search_group_id"), F.col("provider").alias("provider_id"),
        F.col("link").alias("provider_url"), "title",
        F.transform(F.filter("r.checks", lambda c: ~c["passed"]), lambda c: c["criterion"]).alias("failed_criteria"),
        F.col("r.checks").alias("checks"))
    checks_type = dict(failed.dtypes)["checks"]
    check = F.struct(
        F.lit("rss_title_prefilter").alias("criterion"), F.lit(False).alias("passed"),
        F.concat(F.lit("Fachfremder Titel laut RSS: '"), "excluded_by", F.lit("' (Projektseite nicht abgerufen)")).alias("reason"),
        F.col("excluded_by").alias("value_found"), F.lit(False).alias("was_unknown"))
    early = routed.where("route = 'prefiltered'").select(
        F.explode("pending").alias("search_group_id"), F.col("provider").alias("provider_id"),
        F.col("link").alias("provider_url"), F.col("entry_title").alias("title"),
        F.array(F.lit("rss_title_prefilter")).alias("failed_criteria"), F.array(check).cast(checks_type).alias("checks"))
    return failed.unionByName(early).withColumn("channel", F.lit(setup.channel)) \
        .withColumn("discovered_at", F.lit(setup.now.isoformat()))


def empty_state(spark) -> State:
    from ..model import LEDGER, LEDGER_DECISION, SOURCE
    postings = ("project_id string, title string, description string, created_at string, state string, "
                f"search_groups array<string>, sources array<{SOURCE.simpleString()}>")
    return State(spark.createDataFrame([], LEDGER), spark.createDataFrame([], LEDGER_DECISION),
                 spark.createDataFrame([], "project_id string"), spark.createDataFrame([], postings))
