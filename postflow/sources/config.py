"""Search groups and rule lists as dimensions.

Configuration is read on the driver: it is a handful of rows by nature.  Both YAML and
JSON files are accepted.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, types as T

from ..functions.terms import Term, compile_terms, exclude_pattern
from ..functions.urls import rules_fingerprint


def load_file(path: str) -> dict:
    with open(path, encoding="utf-8") as fh:
        text = fh.read()
    try:
        return json.loads(text)
    except ValueError:
        import yaml  # only YAML files need it
        return yaml.safe_load(text) or {}


@dataclass(frozen=True)
class Choice:
    allowed: tuple[str, ...]
    reject_if_unknown: bool = False


@dataclass(frozen=True)
class RateBounds:
    min_hourly: float | None = None
    max_hourly: float | None = None
    min_daily: float | None = None
    max_daily: float | None = None
    reject_if_unknown: bool = False

    @property
    def active(self) -> bool:
        return any(v is not None for v in (
            self.min_hourly, self.max_hourly, self.min_daily, self.max_daily))


@dataclass(frozen=True)
class Filters:
    """Hard filters of a group, compiled once at load."""

    include: tuple[Term, ...] = ()
    include_min: int = 1
    exclude: tuple[tuple[str, str], ...] = ()
    contract_type: Choice | None = None
    work_mode: Choice | None = None
    rate: RateBounds | None = None
    language: Choice | None = None
    max_age_days: int | None = None

    @classmethod
    def of(cls, d: dict | None) -> "Filters":
        d = d or {}

        def choice(key: str) -> Choice | None:
            c = d.get(key)
            if not c or not c.get("allowed"):
                return None
            return Choice(tuple(str(v).lower() for v in c["allowed"]),
                          bool(c.get("reject_if_unknown", False)))

        rate = d.get("rate") or {}
        bounds = RateBounds(**{k: (None if rate.get(k) is None else float(rate[k])) for k in (
            "min_hourly", "max_hourly", "min_daily", "max_daily")},
            reject_if_unknown=bool(rate.get("reject_if_unknown", False)))
        age = d.get("max_age_days")
        return cls(
            include=tuple(compile_terms(d.get("include_terms"))),
            include_min=max(1, int(d.get("include_min_matches") or 1)),
            exclude=tuple((t, exclude_pattern(t)) for t in d.get("exclude_terms") or []),
            contract_type=choice("contract_type"), work_mode=choice("work_mode"),
            rate=bounds if bounds.active else None, language=choice("language"),
            max_age_days=None if age is None else int(age))


@dataclass(frozen=True)
class SearchGroup:
    group_id: str
    filters: Filters
    fingerprint: str
    display_name: str = ""
    priority: int = 10
    enabled: bool = True
    feeds: tuple[tuple[str, str, int | None, int], ...] = field(default=())  # provider, url, limit, age


def overlay_defaults(groups: dict, defaults: dict) -> dict:
    """A group without a term list takes the default; an empty list stays empty."""
    merged = {}
    for gid, group in groups.items():
        filters = dict(group.get("filters") or {})
        default = defaults.get(gid) or {}
        if "include_terms" not in filters and default.get("include_terms"):
            filters["include_terms"] = list(default["include_terms"])
            filters.setdefault("include_min_matches", default.get("include_min_matches", 1))
        merged[gid] = {**group, "filters": filters}
    return merged


def load_groups(config: dict, prefilter_terms: list[str] | None = None) -> list[SearchGroup]:
    """Validated groups in priority order; all errors are reported together."""
    errors, groups = [], []
    for gid, raw in (config.get("search_groups") or {}).items():
        if not isinstance(raw, dict):
            errors.append(f"{gid}: must be a mapping")
            continue
        providers = raw.get("providers") or {}
        if not providers:
            errors.append(f"{gid}: needs at least one provider")
        feeds = []
        for provider, cfg in providers.items():
            rss = (cfg.get("channels") or {}).get("rss")
            if rss is None:
                continue
            limit = rss.get("limit", 25)  # None: every entry
            limit = None if limit is None else int(limit)
            if not rss.get("feed_urls"):
                errors.append(f"{gid}.{provider}: feed_urls must not be empty")
            if limit is not None and limit < 1:
                errors.append(f"{gid}.{provider}: limit must be >= 1")
            feeds += [(provider, u, limit, int(rss.get("max_age_days", 7)))
                      for u in rss.get("feed_urls") or []]
        groups.append(SearchGroup(
            gid, Filters.of(raw.get("filters")),
            rules_fingerprint(raw.get("filters") or {}, prefilter_terms or []),
            str(raw.get("display_name", gid)), int(raw.get("priority", 10)),
            bool(raw.get("enabled", True)), tuple(feeds)))
    if errors:
        raise ValueError("invalid search groups: " + "; ".join(errors))
    return sorted(groups, key=lambda g: g.priority)  # O5, stable


def active_groups(groups: list[SearchGroup], requested: list[str] | None = None) -> list[SearchGroup]:
    """F15."""
    return [g for g in groups if g.enabled and (requested is None or g.group_id in requested)]


TERM_RULE = T.StructType([
    T.StructField("group_id", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("term", T.StringType()), T.StructField("context_terms", T.ArrayType(T.StringType())),
    T.StructField("pattern", T.StringType()), T.StructField("needle", T.StringType()),
    T.StructField("term_ord", T.IntegerType()),
])


def term_rules(spark: SparkSession, groups: list[SearchGroup]) -> DataFrame:
    """The include terms of all groups as one dimension table."""
    if any(c.context for g in groups for t in g.filters.include for c in t.context):
        raise ValueError("context terms with contexts of their own need the literal form")
    rows = [(g.group_id, "include", t.term, [c.term for c in t.context], t.pattern, t.needle, i)
            for g in groups for i, t in enumerate(g.filters.include)]
    return spark.createDataFrame(rows, TERM_RULE)


SUBSCRIPTION = T.StructType([
    T.StructField("group_id", T.StringType()), T.StructField("provider", T.StringType()),
    T.StructField("feed", T.StringType()), T.StructField("limit", T.IntegerType()),
    T.StructField("max_age_days", T.IntegerType()), T.StructField("priority", T.IntegerType()),
])


def subscriptions(spark: SparkSession, groups: list[SearchGroup]) -> DataFrame:
    """One row per (group, provider, feed)."""
    rows = [(g.group_id, p, u, limit, age, g.priority)
            for g in groups for p, u, limit, age in g.feeds]
    return spark.createDataFrame(rows, SUBSCRIPTION)


def shared_feeds(subs: DataFrame) -> "DataFrame":
    """Each feed once, with its groups, the largest limit (null: none) and the largest age."""
    from pyspark.sql import functions as F

    return subs.groupBy("provider", "feed").agg(
        F.array_sort(F.collect_list(F.struct("priority", "group_id"))).alias("g"),
        F.when(F.count("limit") == F.count("*"), F.max("limit")).alias("limit"), F.max("max_age_days").alias("max_age_days")) \
        .withColumn("groups", F.col("g.group_id")).drop("g")
