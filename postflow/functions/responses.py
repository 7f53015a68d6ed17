"""External evaluations: prompt text, answers and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..model import RESPONSE
from .text import blank_to_null, strip

# --- Fixed values: limits of an answer and the digest of a profile -----------
MAX_ITEMS, MAX_ITEM_CHARS, MAX_RATIONALE = 7, 120, 500
MAX_DIGEST, MAX_KEYWORD = 800, 120
HIGH_THRESHOLD, LOW_THRESHOLD = 65, 35
TRUNCATION_NOTE = (
    "\n\nHINWEIS: Der Projekttext wurde aus Kapazitätsgründen gekürzt. "
    "Bewerte nur auf Basis der vorhandenen Informationen. "
    "Falls wesentliche Anforderungen fehlen, gib score=0 und erkläre dies "
    "im rationale-Feld. Erzeuge keine Scheingenauigkeit."
)


def profile_digest(text: Column) -> Column:
    """The keyword lines of a profile, at most 800 characters."""
    plain = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    lines = F.transform(F.split(plain, r"\r\n|\n|\r"), strip)
    lines = F.filter(lines, lambda v: (v != "") & ~v.startswith("#") & ~v.contains("[PLACEHOLDER"))
    words = F.transform(lines, lambda v: strip(F.regexp_replace(v, r"(?U)^[-*•]\s*", "")))
    words = F.filter(words, lambda v: (v != "") & (F.length(v) < MAX_KEYWORD))
    digest = F.array_join(F.transform(words, lambda v: F.concat(F.lit("- "), v)), "\n")
    return F.when(F.length(digest) > MAX_DIGEST,
                  F.concat(F.substring(digest, 1, MAX_DIGEST), F.lit("\n[...gekürzt]"))
                  ).otherwise(digest)


def prompt(template: str, text: Column, digests: dict[str, str], truncated: Column) -> Column:
    """Fill ``{note}``, ``{profiles}``, ``{profile_ids}`` and ``{text}`` of a template.

    The digests are config-sized constants, so a prompt is one projection.  The caller
    brings the template; nothing here calls a model.
    """
    profiles = "\n\n".join(f'<profile id="{p}">\n{d}\n</profile>' for p, d in digests.items())
    ids = "[" + ", ".join(f'"{p}"' for p in digests) + "]"
    filled = template.replace("{profiles}", profiles).replace("{profile_ids}", ids)
    pieces = []
    for piece in re.split(r"(\{note\}|\{text\})", filled):
        if piece == "{note}":
            pieces.append(F.when(truncated, F.lit(TRUNCATION_NOTE)).otherwise(""))
        elif piece == "{text}":
            pieces.append(text)
        elif piece:
            pieces.append(F.lit(piece))
    return F.concat(*pieces)


def _clean_list(raw: Column) -> Column:
    """Items of a JSON array given as text: at most 7, 120 characters, no control characters."""
    items = F.slice(F.from_json(raw, "array<string>"), 1, MAX_ITEMS)
    cleaned = F.transform(items, lambda v: strip(F.regexp_replace(
        F.substring(F.coalesce(v, F.lit("None")), 1, MAX_ITEM_CHARS), r"[\x00-\x1f]", " ")))
    return F.coalesce(F.filter(cleaned, lambda v: v != ""), F.expr("cast(array() as array<string>)"))


def _entry_error(entry: Column, pos: Column, ids: Column, profile_ids: list[str]) -> Column:
    """The first fault of one entry, in the order in which its fields are read."""
    pid = F.coalesce(F.get(ids, pos), F.lit(""))
    kind = F.coalesce(F.schema_of_variant(F.try_variant_get(entry, "$.score", "variant")), F.lit("VOID"))
    return F.when(~F.schema_of_variant(entry).startswith("OBJECT"), F.concat(F.lit("no object as entry "), pos.cast("string"))) \
        .when(~pid.isin(profile_ids), F.concat(F.lit("unknown profile_id: "), pid)) \
        .when(F.array_position(ids, pid) <= pos, F.concat(F.lit("duplicate profile_id: "), pid)) \
        .when(~kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|BOOLEAN)$"), F.concat(F.lit("score is no number for "), pid)) \
        .when(~F.coalesce(_score(entry).between(0, 100), F.lit(False)), F.concat(F.lit("score outside [0,100] for "), pid))


def _score(entry: Column) -> Column:
    """A number cut to whole points; true and false count as 1 and 0."""
    return F.coalesce(F.try_variant_get(entry, "$.score", "double").try_cast("int"),
                      F.try_variant_get(entry, "$.score", "boolean").cast("int"))


def validate_response(raw: Column, profile_ids: list[str]) -> Column:
    """struct(evaluations, error); exactly one of the two is set.

    The entries are checked in order and the first fault of the first faulty entry is told.
    """
    body = blank_to_null(F.regexp_extract(raw, r"(?s)\{.*\}", 0))
    document = F.try_parse_json(body)
    entries = F.try_variant_get(document, "$.evaluations", "array<variant>")
    items = F.from_json(body, RESPONSE)["evaluations"]
    n = len(profile_ids)
    ids = F.transform(entries, lambda e: F.coalesce(F.try_variant_get(e, "$.profile_id", "string"), F.lit("")))
    faults = F.array_compact(F.transform(entries, lambda e, i: _entry_error(e, i, ids, profile_ids)))
    error = (
        F.when(body.isNull(), "no JSON object in the answer")
        .when(document.isNull(), "JSON does not parse")
        .when(entries.isNull(), "key 'evaluations' is missing or no list")
        .when(F.size(entries) != n, F.concat(F.lit(f"expected {n} entries, got "), F.size(entries).cast("string")))
        .otherwise(F.get(faults, F.lit(0)))
    )
    valid = F.transform(items, lambda e, i: F.struct(
        e["profile_id"].alias("profile_id"),
        _score(F.get(entries, i)).alias("score"),
        _clean_list(e["matched"]).alias("matched"),
        _clean_list(e["missing"]).alias("missing"),
        F.substring(F.coalesce(e["rationale"], F.lit("")), 1, MAX_RATIONALE).alias("rationale"),
    ))
    return F.struct(F.when(error.isNull(), valid).alias("evaluations"), error.alias("error"))


def priority_label(score: Column, high: int = HIGH_THRESHOLD, low: int = LOW_THRESHOLD) -> Column:
    """P36."""
    return F.when(score >= high, "high_priority").when(score >= low, "review") \
        .otherwise("low_priority")


def budget_share(spent: Column, budget: Column) -> Column:
    """Whole percent, at most 100, 0 without a budget."""
    return F.when(F.coalesce(budget, F.lit(0)) <= 0, F.lit(0)) \
        .otherwise(F.least(F.lit(100), F.floor(spent / budget * 100 + 0.5))).cast("int")
