"""Identity, canonical URLs, keys and fingerprints."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, functions as F

from ..model import DEFAULT_PROVIDER
from .text import strip

# --- Fixed values: query parameters that only track where a click came from --
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "msclkid", "ref", "source",
]

_SCHEME = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?"
_AUTHORITY = _SCHEME + r"(?://([^/?#]*))?"
_PATH = _AUTHORITY + r"([^?#]*)"
_QUERY = _PATH + r"(?:\?([^#]*))?"


def _part(url: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(url, pattern, group)


def _path(url: Column) -> Column:
    return F.regexp_replace(_part(url, _PATH, 3), r";[^/]*\z", "")


def _rstrip_slash(col: Column) -> Column:
    return F.regexp_replace(col, r"/+\z", "")


def identity_url(url: Column) -> Column:
    """Lower-case scheme and host, path without trailing slash, nothing else."""
    u = strip(url)
    return F.concat(
        F.lower(_part(u, _SCHEME, 1)), F.lit("://"), F.lower(_part(u, _AUTHORITY, 2)),
        _rstrip_slash(_path(u)),
    )


def _short_sha(col: Column) -> Column:
    return F.substring(F.sha2(col, 256), 1, 12)


def title_slug(title: Column) -> Column:
    dashed = F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, r"^-+|-+\z", ""), 1, 48)


def project_id(url: Column, title: Column, row_content: Column | None = None) -> Column:
    """``url-``/``ttl-`` plus 12 hex digits; with neither, a hash of the row."""
    fallback = F.coalesce(row_content, F.lit("")) if row_content is not None else F.lit("")
    return (
        F.when(strip(F.coalesce(url, F.lit(""))) != "",
               F.concat(F.lit("url-"), _short_sha(identity_url(url))))
        .when(strip(F.coalesce(title, F.lit(""))) != "",
              F.concat(F.lit("ttl-"), _short_sha(title_slug(title))))
        .otherwise(F.concat(F.lit("unk-"), _short_sha(fallback)))
    )


def tracking_free_url(url: Column, tracking: list[str] | None = None) -> Column:
    """Keep the query, but only the first value of each non-tracking key."""
    tracked = tracking if tracking is not None else TRACKING_PARAMS

    def decode(c: Column) -> Column:
        return F.coalesce(F.try_url_decode(c), c)

    raw = F.filter(
        F.split(_part(url, _QUERY, 4), "&"),
        lambda p: p.rlike(r"(?s)^[^=]*=.+"),
    )
    pairs = F.transform(raw, lambda p: F.struct(
        decode(F.substring_index(p, "=", 1)).alias("k"),
        decode(F.regexp_extract(p, r"(?s)^[^=]*=(.*)\z", 1)).alias("v"),
    ))
    kept = F.filter(pairs, lambda p: ~p["k"].isin(tracked))
    first = F.aggregate(
        kept,
        F.expr("cast(array() as array<struct<k:string,v:string>>)"),
        lambda acc, p: F.when(F.exists(acc, lambda a: a["k"] == p["k"]), acc)
        .otherwise(F.concat(acc, F.array(p))),
    )
    query = F.array_join(F.transform(first, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    params = F.regexp_extract(_part(url, _PATH, 3), r";([^/]*)\z", 1)
    return F.concat(
        F.lower(_part(url, _SCHEME, 1)), F.lit("://"), F.lower(_part(url, _AUTHORITY, 2)),
        _rstrip_slash(_path(url)),
        F.when(params != "", F.concat(F.lit(";"), params)).otherwise(""),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def provider_key(provider: Column, url: Column) -> Column:
    """``provider:canonical_url``."""
    return F.concat(provider, F.lit(":"), url)


def feed_label(provider: Column, feed_url: Column, default_provider: str = DEFAULT_PROVIDER) -> Column:
    """P5: last path segment without extension, upper case, provider prefix if needed."""
    segment = F.element_at(F.split(_rstrip_slash(_path(feed_url)), "/"), -1)
    name = F.regexp_replace(segment, r"\.[^.]*\z", "")
    label = F.upper(F.when(name != "", name).otherwise(provider))
    return F.when(provider == default_provider, label).otherwise(
        F.concat(provider, F.lit(":"), label))


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(_part(strip(url), _AUTHORITY, 2), r"^.*@|:\d+\z", ""))


def rules_fingerprint(filters: dict, prefilter_terms: list[str]) -> str:
    """P6 on the driver: short SHA-1 of the canonical rule text (rules are config-sized)."""
    text = json.dumps({"filters": filters or {}, "prefilter": list(prefilter_terms)},
                      sort_keys=True, ensure_ascii=False, default=str)
    return hashlib.sha1(text.encode("utf-8")).hexdigest()[:12]


def fingerprint(canonical: Column) -> Column:
    """P6 as a column, for rule tables that live in Spark."""
    return F.substring(F.sha1(canonical), 1, 12)


def cache_key(text: Column, profiles_hash: Column, prompt_version: Column, model: Column,
              high: Column, low: Column) -> Column:
    """Everything that may change an evaluation, joined by a pipe."""
    parts = [text, profiles_hash, prompt_version, model, high.cast("string"), low.cast("string")]
    return F.sha2(F.concat_ws("|", *parts), 256)


def profiles_hash(profiles: dict[str, str]) -> str:
    """16 hex digits over the profile texts in id order (config-sized)."""
    joined = "".join(profiles[p] for p in sorted(profiles))
    return hashlib.sha256(joined.encode("utf-8")).hexdigest()[:16]
