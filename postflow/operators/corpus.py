"""Corpus queries, pages, statistics."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import resolve_server_range
from ..functions.text import blank_to_null
from ..model import DEFAULT_PROVIDER
from .lifecycle import last_changes


@dataclass(frozen=True)
class CorpusFilter:
    """The 15 optional predicates of a corpus query."""

    search: str | None = None
    statuses: list[str] = field(default_factory=list)
    companies: list[str] = field(default_factory=list)
    providers: list[str] = field(default_factory=list)
    channels: list[str] = field(default_factory=list)
    date_from: str | None = None
    date_to: str | None = None
    pre_eval_score_min: int | None = None
    pre_eval_score_max: int | None = None
    llm_score_min: int | None = None
    llm_score_max: int | None = None
    search_groups: list[str] = field(default_factory=list)
    profile_ids: list[str] = field(default_factory=list)
    priority_labels: list[str] = field(default_factory=list)
    evaluation_statuses: list[str] = field(default_factory=list)
    default_provider: str = DEFAULT_PROVIDER


def resolve_dates(f: CorpusFilter, today: dt.date) -> CorpusFilter:
    """P30 for a filter with relative dates."""
    start, end = resolve_server_range(f.date_from, today)
    end = end or (today.isoformat() if f.date_to == "today" else f.date_to)
    return CorpusFilter(**{**f.__dict__, "date_from": start, "date_to": end})


def corpus_query(view: DataFrame, f: CorpusFilter) -> DataFrame:
    """a conjunction of plain predicates, so that they reach the scan."""
    out = view

    def where(predicate: Column) -> None:
        nonlocal out
        out = out.where(predicate)

    if f.search:
        word = f.search.lower()
        where(F.lower(F.coalesce("title", F.lit(""))).contains(word)
              | F.lower(F.coalesce("company", F.lit(""))).contains(word))
    if f.statuses:
        where(F.col("status").isin(f.statuses))
    if f.companies:
        where(F.col("company").isin(f.companies))
    if f.providers:
        provider = F.lower(F.coalesce(blank_to_null(F.col("provider_name")), F.lit(f.default_provider)))
        where(provider.isin([p.lower() for p in f.providers]))
    if f.channels:
        where(F.col("collection_channel").isin(f.channels))
    if f.date_from or f.date_to:
        typed = dict(out.dtypes)["retrieval_date"] != "string"
        # A typed column is compared as it is, so that the range reaches the scan.
        day = F.col("retrieval_date") if typed else F.try_to_date(F.substring("retrieval_date", 1, 10), "yyyy-MM-dd")
        where(day.isNotNull())
        if f.date_from:
            where(day >= F.lit(dt.date.fromisoformat(f.date_from)))
        if f.date_to:
            where(day < F.lit(dt.date.fromisoformat(f.date_to) + dt.timedelta(days=1)))
    for name in ("pre_eval_score", "llm_score"):
        low, high = getattr(f, f"{name}_min"), getattr(f, f"{name}_max")
        if low is not None:
            where(F.col(name) >= low)
        if high is not None:
            where(F.col(name) <= high)
    if f.search_groups:
        where(in_groups(F.col("search_groups"), f.search_groups))
    if f.profile_ids:
        where(F.coalesce("best_profile", F.lit("")).isin(f.profile_ids))
    if f.priority_labels:
        where(F.coalesce(blank_to_null(F.col("llm_priority")), F.lit("not_evaluated")).isin(f.priority_labels))
    if f.evaluation_statuses:
        where(F.coalesce(blank_to_null(F.col("evaluation_status")), F.lit("not_evaluated"))
              .isin(f.evaluation_statuses))
    return out


def in_groups(groups: Column, wanted: list[str]) -> Column:
    """U4."""
    return F.arrays_overlap(groups, F.array(*[F.lit(g) for g in wanted]))


def by_state(postings: DataFrame, state: str | None = None, company: str | None = None) -> DataFrame:
    """F11."""
    out = postings
    if state:
        out = out.where(F.col("state") == state)
    if company:
        out = out.where(F.col("company") == company)
    return out


def newest_first(view: DataFrame, key: str = "id") -> DataFrame:
    """O1: undated rows last; the key makes the order total."""
    return view.orderBy(F.coalesce("retrieval_date", F.lit("")).desc(), F.col(key))


def ui_order(view: DataFrame, column: str, ascending: bool = True, key: str = "id") -> DataFrame:
    """O3: case-insensitive, null as the empty string."""
    value = F.lower(F.coalesce(F.col(column).cast("string"), F.lit(""))) \
        if dict(view.dtypes)[column] == "string" else F.coalesce(F.col(column), F.lit(0))
    return view.orderBy(value.asc() if ascending else value.desc(), F.col(key))


def page(ordered: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """O2: size 0 means all rows."""
    return ordered if size == 0 else ordered.offset((number - 1) * size).limit(size)


def page_info(matching: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """O2: one row with total, has_next and has_prev."""
    total = F.col("total")
    info = matching.agg(F.count("*").alias("total"))
    if size == 0:
        return info.select("total", F.lit(number).alias("page"), total.alias("page_size"),
                           F.lit(False).alias("has_next"), F.lit(False).alias("has_prev"))
    return info.select("total", F.lit(number).alias("page"), F.lit(size).cast("bigint").alias("page_size"),
                       (F.lit(number * size) < total).alias("has_next"), F.lit(number > 1).alias("has_prev"))


def best_score(llm: Column, fit: Column, pre: Column) -> Column:
    """0 falls through like a missing score."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in (llm, fit, pre)], F.lit(0))


def dashboard_counters(view: DataFrame) -> DataFrame:
    """A3: all counters in one pass; status counts follow by :func:`by_status`."""
    status = F.col("evaluation_status")
    return view.agg(
        F.count("*").alias("total_projects"),
        F.count_if(status == "ok").alias("llm_evaluated"),
        F.count_if(status == "pending_retry").alias("llm_pending"),
        F.count_if(status.isin("failed", "unsafe_content")).alias("llm_failed"),
        F.count_if(F.col("llm_priority") == "high_priority").alias("llm_high_priority"))


def by_status(view: DataFrame) -> DataFrame:
    return view.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def recent_activity(events: DataFrame, key: str, order: list[str], per_posting: int = 3, n: int = 10) -> DataFrame:
    """O4 over W2: two bounded tops, no full sort."""
    return last_changes(events, key, order, per_posting) \
        .orderBy(*[F.desc(c) for c in order]).limit(n)


def distinct_values(view: DataFrame, column: str, extra: list[str] | None = None) -> DataFrame:
    """Sorted values plus the fixed ones."""
    values = view.select(F.col(column).alias("value")).where("value is not null and value <> ''").distinct()
    if extra:
        fixed = view.sparkSession.createDataFrame([(v,) for v in extra], "value string")
        values = values.unionByName(fixed).distinct()
    return values.orderBy("value")


def with_score(postings: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Score by posting, 0 when absent."""
    return postings.join(scores, key, "left").withColumn("score", F.coalesce("score", F.lit(0)))
