"""Routing postings by term rules and hard filters."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import postings as P, terms as T
from ..functions.markdown import iso_timestamp
from ..functions.text import blank_to_null, full_text, let, shown_float, strip, tag_text
from ..model import CHECK
from ..sources.config import Choice, Filters, SearchGroup

TEXT_FIELDS = ["title", "description", "summary", "body", "content"]
TAG_FIELDS = ["schlagworte", "keywords", "skills", "tags"]
DATE_FIELDS = ["published_date", "discovered_at", "scraped_date", "created_at"]


def _present(df: DataFrame, names: list[str]) -> list[Column]:
    return [F.col(n) for n in names if n in df.columns]


def with_texts(df: DataFrame) -> DataFrame:
    """The texts the filters look at, assembled once per posting."""
    tags = [F.col(c) for c in TAG_FIELDS if c in df.columns]
    text = full_text(*_present(df, TEXT_FIELDS))
    df = df.withColumn("full_text", text).withColumn("full_low", T.search_form(F.col("full_text")))
    return df.withColumn("topic_low", F.concat_ws(" ; ", blank_to_null(F.col("full_low")),
                                                  *([blank_to_null(T.search_form(tag_text(*tags)))] if tags else [])))


def _check(criterion: str, passed: Column, reason: Column, value: Column | None = None,
           unknown: Column | bool = False) -> Column:
    value = F.lit(None) if value is None else value
    unknown = F.lit(unknown) if isinstance(unknown, bool) else unknown
    return F.struct(F.lit(criterion).alias("criterion"), passed.alias("passed"),
                    reason.alias("reason"), value.cast("string").alias("value_found"),
                    unknown.alias("was_unknown")).cast(CHECK)


def check_include(terms, needed: int, low: Column) -> Column:
    """no hit is a rejection, not an unknown."""
    return let(T.matched(list(terms), low), lambda hit: _include_result(hit, needed))


def _include_result(hit: Column, needed: int) -> Column:
    n = F.size(hit)
    reason = F.when(n >= needed, F.concat(F.lit("Fachlicher Treffer: "),
                                          F.array_join(F.slice(hit, 1, 8), ", "))) \
        .when(n > 0, F.concat(F.lit("Nur "), n.cast("string"),
                              F.lit(f" von {needed} nötigen Fachbegriffen gefunden: "),
                              F.array_join(hit, ", "))) \
        .otherwise("Kein Fachbegriff der Suchgruppe gefunden")
    return _check("include_terms", n >= needed, reason, F.array_join(hit, ", "))


def check_exclude(terms, text: Column, low: Column | None = None) -> Column:
    """the first hit rejects.  A term of ASCII letters and digits is looked up in the search form, if at hand."""
    def hit(term: str, pattern: str) -> Column:
        plain = low is not None and re.fullmatch("[A-Za-z0-9]+", term)
        return low.contains(term.lower()) if plain else text.rlike(pattern)

    return let(F.coalesce(*[F.when(hit(t, p), F.lit(t)) for t, p in terms]), _exclude_result)


def _exclude_result(hit: Column) -> Column:
    reason = F.when(hit.isNotNull(), F.concat(F.lit("Ausschlussbegriff gefunden: '"), hit, F.lit("'"))) \
        .otherwise("Kein Ausschlussbegriff gefunden")
    return _check("exclude_terms", hit.isNull(), reason, hit)


def _check_choice(criterion: str, label: str, value: Column, cfg: Choice, unknown_pass: str,
                  unknown_fail: str) -> Column:
    return let(value, lambda v: _choice_result(criterion, label, v, cfg, unknown_pass, unknown_fail))


def _choice_result(criterion: str, label: str, value: Column, cfg: Choice, unknown_pass: str,
                   unknown_fail: str) -> Column:
    known = value.isNotNull()
    passed = F.coalesce(value.isin(list(cfg.allowed)), F.lit(not cfg.reject_if_unknown))
    reason = F.when(~known, f"{label} nicht bestimmbar — " + (
        unknown_fail if cfg.reject_if_unknown else unknown_pass)) \
        .when(passed, F.concat(F.lit(f"{label} '"), value, F.lit("' ist erlaubt"))) \
        .otherwise(F.concat(F.lit(f"{label} '"), value,
                            F.lit(f"' ist nicht erlaubt (erlaubt: {list(cfg.allowed)})")))
    return _check(criterion, passed, reason, value, ~known)


def _low(df: DataFrame) -> Column | None:
    return F.col("full_low") if "full_low" in df.columns else None


def _explicit_or(df: DataFrame, field: str, normalise, text: Column) -> Column:
    if field not in df.columns:
        return normalise(text, _low(df))
    raw = strip(F.coalesce(F.col(field), F.lit("")))
    return F.when(raw != "", normalise(raw)).otherwise(normalise(text, _low(df)))


def check_work_mode(df: DataFrame, cfg: Choice, text: Column) -> Column:
    """F4."""
    value = _explicit_or(df, "work_mode", P.work_mode, text)
    return _check_choice("work_mode", "Arbeitsmodell", value, cfg,
                         "akzeptiert (Standardverhalten: unbekannt → pass)",
                         "abgelehnt (reject_if_unknown=true)")


def check_contract_type(df: DataFrame, cfg: Choice, text: Column) -> Column:
    """F5."""
    value = _explicit_or(df, "contract_type", P.contract_type, text)
    return _check_choice("contract_type", "Vertragstyp", value, cfg,
                         "akzeptiert (unbekannt → pass)", "abgelehnt")


def check_rate(df: DataFrame, cfg, text: Column) -> Column:
    """text is read only when both explicit rates are missing."""
    none = F.lit(None).cast("double")
    hourly = F.col("hourly_rate").cast("double") if "hourly_rate" in df.columns else none
    daily = F.col("daily_rate").cast("double") if "daily_rate" in df.columns else none
    missing = hourly.isNull() & daily.isNull()
    given = F.struct(hourly.alias("hourly"), daily.alias("daily"))
    return let(F.when(missing, P.rates(text, _low(df))).otherwise(given), lambda r: _rate_result(r["hourly"], r["daily"], cfg))


def _rate_result(hourly: Column, daily: Column, cfg) -> Column:
    def fail(value: Column, label: str, bound: float | None, sign: str) -> Column:
        if bound is None:
            return F.lit(None).cast("string")
        bad = value < bound if sign == "<" else value > bound
        word = "Minimum" if sign == "<" else "Maximum"
        return F.when(bad, F.concat(F.lit(f"{label} "), shown_float(value),
                                    F.lit(f"€ {sign} {word} {bound}€")))

    failures = F.array_compact(F.array(
        fail(hourly, "Stundensatz", cfg.min_hourly, "<"), fail(hourly, "Stundensatz", cfg.max_hourly, ">"),
        fail(daily, "Tagessatz", cfg.min_daily, "<"), fail(daily, "Tagessatz", cfg.max_daily, ">")))
    unknown = hourly.isNull() & daily.isNull()
    shown_h, shown_d = (F.coalesce(shown_float(v), F.lit("None")) for v in (hourly, daily))
    passed = F.when(unknown, not cfg.reject_if_unknown).otherwise(F.size(failures) == 0)
    reason = F.when(unknown, "Stunden-/Tagessatz nicht angegeben — " + (
        "abgelehnt" if cfg.reject_if_unknown else "akzeptiert (unbekannt → pass)")) \
        .when(F.size(failures) > 0, F.array_join(failures, "; ")) \
        .otherwise(F.concat(F.lit("Satz akzeptiert (Std: "), shown_h, F.lit("€, Tag: "), shown_d, F.lit("€)")))
    value = F.when(~unknown, F.concat(F.lit("hourly="), shown_h, F.lit(", daily="), shown_d))
    return _check("rate", passed, reason, value, unknown)


def check_language(df: DataFrame, cfg: Choice, text: Column) -> Column:
    """F7."""
    found = P.languages(text, _low(df))
    if "language" in df.columns:
        explicit = F.lower(strip(F.coalesce(F.col("language"), F.lit(""))))
        found = F.when(explicit != "", F.array(explicit)).otherwise(found)
    return let(found, lambda v: _language_result(v, cfg))


def _language_result(found: Column, cfg: Choice) -> Column:
    allowed = F.array(*[F.lit(v) for v in cfg.allowed])
    unknown = F.size(found) == 0
    overlap = F.array_intersect(found, allowed)
    passed = F.when(unknown, not cfg.reject_if_unknown).otherwise(F.arrays_overlap(found, allowed))

    def shown(a: Column) -> Column:
        return F.concat(F.lit("['"), F.array_join(a, "', '"), F.lit("']"))

    reason = F.when(unknown, "Projektsprache nicht erkennbar — " + (
        "abgelehnt" if cfg.reject_if_unknown else "akzeptiert (unbekannt → pass)")) \
        .when(passed, F.concat(F.lit("Sprache(n) "), shown(found), F.lit(" enthält erlaubte: "), shown(overlap))) \
        .otherwise(F.concat(F.lit("Sprache(n) "), shown(found),
                            F.lit(f" nicht in erlaubten Sprachen: {list(cfg.allowed)}")))
    return _check("language", passed, reason, F.when(~unknown, F.array_join(found, ", ")), unknown)


def check_age(df: DataFrame, max_age_days: int, now: dt.datetime) -> Column:
    """F8: the first readable of four date fields."""
    fields = [f for f in DATE_FIELDS if f in df.columns]
    parsed = [F.struct(iso_timestamp(F.rtrim(F.col(f), F.lit("Z"))).alias("ts"), F.lit(f).alias("field"))
              for f in fields]
    first = F.get(F.filter(F.array(*parsed), lambda s: s["ts"].isNotNull()), F.lit(0)) if parsed \
        else F.lit(None).cast("struct<ts:timestamp,field:string>")
    return let(first, lambda v: _age_result(v, max_age_days, now))


def _age_result(first: Column, max_age_days: int, now: dt.datetime) -> Column:
    micros = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(first["ts"])
    days = F.floor(micros / F.lit(86_400_000_000)).cast("int")
    passed = F.coalesce(micros <= F.lit(max_age_days * 86_400_000_000), F.lit(True))
    reason = F.when(first.isNull(), "Veröffentlichungsdatum nicht bestimmbar — akzeptiert (unbekannt → pass)") \
        .otherwise(F.concat(F.lit("Alter "), days.cast("string"), F.lit(" Tage"),
                            F.when(passed, " ≤ ").otherwise(" > "),
                            F.lit(f"Limit {max_age_days} Tage (Quelle: "), first["field"], F.lit(")")))
    return _check("max_age_days", passed, reason, days, first.isNull())


def filter_checks(df: DataFrame, cfg: Filters, now: dt.datetime) -> Column:
    """every configured criterion is checked, none is skipped after a failure."""
    text, low = F.col("full_text"), F.col("topic_low")
    checks = []
    if cfg.include:
        checks.append(check_include(cfg.include, cfg.include_min, low))
    if cfg.exclude:
        checks.append(check_exclude(cfg.exclude, text, _low(df)))
    if cfg.contract_type:
        checks.append(check_contract_type(df, cfg.contract_type, text))
    if cfg.work_mode:
        checks.append(check_work_mode(df, cfg.work_mode, text))
    if cfg.rate:
        checks.append(check_rate(df, cfg.rate, text))
    if cfg.language:
        checks.append(check_language(df, cfg.language, text))
    if cfg.max_age_days is not None:
        checks.append(check_age(df, cfg.max_age_days, now))
    return F.array(*checks) if checks else F.array().cast(f"array<{CHECK.simpleString()}>")


def filter_results(df: DataFrame, groups: list[SearchGroup], now: dt.datetime,
                   pending: str | None = None) -> Column:
    """F1 for every group as one array of struct(group_id, terms, checks, passed).

    ``pending`` may name an array column with the groups still open for a posting; the
    others are not evaluated.  The rules are literals of one projection: no join, no shuffle.
    """
    def one(g: SearchGroup) -> Column:
        result = let(filter_checks(df, g.filters, now), lambda checks: F.struct(
            F.lit(g.group_id).alias("group_id"), F.lit(g.fingerprint).alias("terms"),
            checks.alias("checks"), F.forall(checks, lambda c: c["passed"]).alias("passed")))
        return F.when(F.array_contains(pending, g.group_id), result) if pending else result

    return F.array_compact(F.array(*[one(g) for g in groups]))


def apply_filters(df: DataFrame, groups: list[SearchGroup], now: dt.datetime,
                  pending: str | None = None) -> DataFrame:
    """F1 as rows: one per (posting, group) with ``checks``, ``passed`` and the criteria."""
    keep = df.columns
    df = df if "topic_low" in df.columns else with_texts(df)
    out = df.withColumn("_result", F.explode(filter_results(df, groups, now, pending)))
    return out.select(*keep, "_result.*") \
        .withColumn("failed_criteria", F.transform(F.filter("checks", lambda c: ~c["passed"]),
                                                   lambda c: c["criterion"])) \
        .withColumn("unknown_criteria", F.transform(F.filter("checks", lambda c: c["was_unknown"]),
                                                    lambda c: c["criterion"]))


def match_terms(df: DataFrame, groups: list[SearchGroup]) -> DataFrame:
    """J2 with literal rules: one row per (posting, group) with the matched terms.

    For up to some hundred terms this is the plan to take: one scan, patterns compiled
    once per task, a substring test in front of each pattern.
    """
    df = df if "topic_low" in df.columns else with_texts(df)
    per_group = [F.struct(F.lit(g.group_id).alias("group_id"), T.matched(
        list(g.filters.include), F.col("topic_low")).alias("matched"))
        for g in groups]
    return df.withColumn("_m", F.explode(F.array(*per_group))).select(
        *df.columns, "_m.*").drop("full_text", "topic_low", "full_low")


PREFIX = 4
WORDS = r"[0-9a-zäöüß]+"
#: Up to so many rules every text tests all of them in its row, which costs less than listing its word beginnings.
RULES_IN_ROW = 500


def _begin_keys(low: Column) -> Column:
    """The distinct word beginnings (1 to 4 letters) and other signs of a text."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(low, F.lit(WORDS), F.lit(0)), lambda w: F.substring(w, 1, PREFIX)))
    begins = F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w)), lambda n: F.substring(w, F.lit(1), n)))))
    others = F.array_distinct(F.regexp_extract_all(low, F.lit(r"[^0-9a-zäöüß\s]"), F.lit(0)))
    return F.concat(begins, F.transform(others, lambda c: F.concat(F.lit("\1"), c)))


def match_rule_table(df: DataFrame, rules: DataFrame, key: str, in_row: int = RULES_IN_ROW) -> DataFrame:
    """J2 for rule tables: (posting, group, term); the result equals :func:`match_terms`.  ``key`` is unique.

    Up to ``in_row`` rules (counted first) go as one broadcast row to the texts, which stay where they are.
    More rules meet the texts by an equi-join on word beginnings: a term starts at a word start, so the text must
    hold a word that begins like the first word of the term; a term without such letters is keyed by its first
    sign.  The distinct keys of a text meet the rules without the text; only the candidates (key, rule) then
    meet the text, all of one text at once.
    """
    df = df if "topic_low" in df.columns else with_texts(df)
    rule, low = F.struct("group_id", "term", "context_terms", "pattern", "needle", "term_ord"), F.col("topic_low")
    if rules.limit(in_row + 1).count() <= in_row:
        listed = df.select(key, "topic_low").crossJoin(F.broadcast(rules.agg(F.collect_list(rule).alias("_rules"))))
    else:
        low_term = T.search_form(F.trim(F.col("term")))
        word = F.regexp_extract(low_term, WORDS, 0)
        keyed = rules.select(rule.alias("_rule"), F.when(word != "", F.substring(word, 1, PREFIX))
                             .otherwise(F.concat(F.lit("\1"), F.substring(low_term, 1, 1))).alias("_begin"))
        pairs = df.select(key, F.explode(_begin_keys(low)).alias("_begin")).join(keyed, "_begin")
        listed = pairs.groupBy(key).agg(F.collect_list("_rule").alias("_rules")).join(df.select(key, "topic_low"), key)
    found = F.filter("_rules", lambda r: low.contains(r["needle"]) & F.rlike(low, r["pattern"]) & (
        (F.size(r["context_terms"]) == 0) | F.exists(r["context_terms"], lambda c: F.rlike(low, T.term_pattern(c)))))
    return listed.select(key, F.explode(found).alias("_r")).select(key, "_r.group_id", "_r.term", "_r.term_ord")


def title_prefilter(title: Column, summary: Column, exclude: list, groups: list[SearchGroup],
                    pending: Column | None = None) -> Column:
    """the title-exclude term that rules a posting out, null when it may go on.

    It rules out only when no include term of any pending group is in title or summary.
    """
    rss = F.concat_ws(" ; ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit("")))
    low, title_low = T.search_form(rss), T.search_form(title)
    hits = []
    for g in groups:
        hit = T.any_match(list(g.filters.include), low)
        hits.append(hit & F.array_contains(pending, g.group_id) if pending is not None else hit)
    any_hit = reduce(lambda a, b: a | b, hits) if hits else F.lit(False)
    return F.when(~any_hit, T.first_match(exclude, title_low))


def keyword_score(text: Column, config: dict | None) -> tuple[Column, Column]:
    """(score, rationale); -1 forbidden, 0 required tag missing, else the weighted share."""
    if not config:
        return F.lit(100), F.lit("No pre-evaluation rules configured. Skipping.")
    low = F.lower(text)
    forbidden, required = config.get("forbidden_tags") or [], config.get("required_tags") or []
    weights = config.get("weighted_tags") or {}
    bad = F.coalesce(*[F.when(low.rlike(r"(?U)\b" + T._escape(t.lower()) + r"\b"), F.lit(t))
                       for t in forbidden], F.lit(None).cast("string"))
    missing = F.coalesce(*[F.when(~low.contains(t.lower()), F.lit(t)) for t in required],
                         F.lit(None).cast("string"))
    total = sum(weights.values())
    if not weights:
        score, why = F.lit(100), F.lit("Passed: No weighted tags to score against.")
    elif total == 0:
        score, why = F.lit(100), F.lit("Passed: No weighted tags configured.")
    else:
        points = sum((F.when(low.contains(t.lower()), F.lit(w)).otherwise(0)
                      for t, w in weights.items()), F.lit(0))
        found = F.array_compact(F.array(*[F.when(low.contains(t.lower()), F.lit(t)) for t in weights]))
        score = F.floor(points / F.lit(total) * 100).cast("int")
        listed = F.when(F.size(found) > 0, F.concat(F.lit("['"), F.array_join(found, "', '"), F.lit("']"))) \
            .otherwise("[]")
        why = F.concat(F.lit("Score: "), score.cast("string"), F.lit("%. Found tags: "), listed)
    score = F.when(bad.isNotNull(), -1).when(missing.isNotNull(), 0).otherwise(score)
    why = F.when(bad.isNotNull(), F.concat(F.lit("Rejected: Contains forbidden tag '"), bad, F.lit("'."))) \
        .when(missing.isNotNull(), F.concat(F.lit("Rejected: Missing required tag '"), missing, F.lit("'."))) \
        .otherwise(why)
    return score, why


def acceptance(pre_score: Column, fit_score: Column, pre_threshold: int = 50, fit_threshold: int = 85,
               force: bool = False, pre_only: bool = False) -> Column:
    """final state."""
    passed = F.lit(True) if force else pre_score >= pre_threshold
    if pre_only:
        return F.when(passed, "accepted").otherwise("rejected")
    return F.when(passed & (F.coalesce(fit_score, F.lit(0)) >= fit_threshold), "accepted").otherwise("rejected")
