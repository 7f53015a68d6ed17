"""Rule-based suitability of a posting."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import postings as P, terms as T
from ..functions.text import blank_to_null, full_text, let, tag_text, with_fixed
from .matching import TAG_FIELDS, TEXT_FIELDS

# --- Fixed values: categories, classes, recommendations ----------------------
CATEGORIES = {
    "high": "Hohe Priorität",
    "medium": "Mittlere Priorität",
    "transferable": "Nur übertragbare Kompetenz (keine eigene Praxis)",
    "low_priority": "Niedrige Priorität",
}
HIGH, MEDIUM, LOW, REJECT = "hoch", "mittel", "niedrig", "abgelehnt"
APPLY, REVIEW, SKIP = "Bewerben", "Prüfen", "Nicht bewerben"
CONDITION_NAMES = {"work_mode": "Arbeitsort", "workload": "Auslastung", "start": "Starttermin"}


def capped_points(hits: Column, weight: int, cap: int | None) -> Column:
    """A10: a negative cap is a floor."""
    points = hits * weight
    if cap is None:
        return points
    return F.greatest(points, F.lit(cap)) if cap < 0 else F.least(points, F.lit(cap))


def bonus_points(rule: dict, low: Column) -> Column:
    """Once per rule, when a prerequisite is in the text."""
    skills = T.matched(T.compile_terms(rule.get("skills")), low)
    needed = T.any_match(T.compile_terms(rule.get("requires")), low)
    points = F.least(F.lit(int(rule.get("max_points", 10))), F.size(skills) * int(rule.get("points_per_skill", 5)))
    return F.when(needed, points).otherwise(0)


def _signed(points: Column) -> Column:
    return F.format_string("%+d", points.cast("int"))


def _matched(entries, text: str, words: str | None = None) -> Column:
    return T.matched(T.compile_terms(entries), F.col(text + "_low"), F.col(words) if words else None)


def _condition(status: Column, value: Column, note: Column) -> Column:
    return F.struct(status.alias("status"), value.cast("string").alias("value"),
                    note.cast("string").alias("note"))


def work_mode_condition(cfg: dict, text: str, words: str | None = None) -> Column:
    """P22 and the term lists of the work-place condition; ``words`` names the column of its :func:`terms.term_words`."""
    facts = F.struct(_matched(cfg.get("onsite_only"), text, words).alias("onsite"),
                     P.remote_share(F.col(text), F.col(text + "_low")).alias("share"))
    return let(facts, lambda v: _work_mode_result(v["onsite"], v["share"], cfg, text, words))


def _work_mode_result(onsite: Column, share: Column, cfg: dict, text: str, words: str | None) -> Column:
    none = F.lit(None).cast("string")
    return F.when(F.size(onsite) > 0, _condition(
        F.lit(P.NOT_OK), F.lit("vollständig vor Ort"), F.concat(F.lit("Angabe: "), F.get(onsite, F.lit(0))))) \
        .when(share >= 100, _condition(F.lit(P.OK), F.lit("100 % remote"), none)) \
        .when(share <= 0, _condition(F.lit(P.NOT_OK), F.lit("0 % remote"), none)) \
        .when(share.isNotNull(), _condition(
            F.lit(P.PARTIAL), F.concat(share.cast("string"), F.lit(" % remote")), none)) \
        .when(F.size(_matched(cfg.get("hybrid"), text, words)) > 0, _condition(F.lit(P.PARTIAL), F.lit("hybrid"), none)) \
        .when(F.size(_matched(cfg.get("remote"), text, words)) > 0, _condition(F.lit(P.OK), F.lit("remote"), none)) \
        .otherwise(_condition(F.lit(P.UNKNOWN), none, F.lit("Kein Arbeitsort angegeben")))


def start_condition(text: Column, today: dt.date, available_from: dt.date | None,
                    low_text: Column | None = None) -> Column:
    return let(P.start_date(text, today, low_text), lambda v: _start_result(v, available_from))


def _start_result(found: Column, available_from: dt.date | None) -> Column:
    none = F.lit(None).cast("string")
    missing = _condition(F.lit(P.UNKNOWN), none, F.lit("Kein Starttermin angegeben"))
    if available_from is None:
        return F.when(found["start"].isNull(), missing).otherwise(_condition(
            F.lit(P.NOT_CHECKED), found["shown"], F.lit("Verfügbarkeit des Bewerbers nicht konfiguriert")))
    day = available_from.strftime("%d.%m.%Y")
    return F.when(found["start"].isNull(), missing) \
        .when(found["start"] < F.lit(available_from), _condition(
            F.lit(P.CONFLICT), found["shown"], F.lit(f"Start vor der konfigurierten Verfügbarkeit ab {day}"))) \
        .otherwise(_condition(F.lit(P.OK), found["shown"], F.lit(f"Verfügbar ab {day}")))


def _term_lists(rules: dict) -> tuple[list, list]:
    """The terms searched in the whole text, and those of the work-place condition."""
    common, work = rules.get("common") or {}, (rules.get("conditions") or {}).get("work_mode") or {}
    lists = [(cfg or {}).get(c) for cfg in (rules.get("groups") or {}).values() for c in CATEGORIES]
    lists += [(common.get("role") or {}).get("terms")]
    lists += [rule.get(k) for rule in common.get("competency_bonuses") or [] for k in ("requires", "skills")]
    return ([t for entries in lists for t in T.compile_terms(entries)],
            [t for k in ("onsite_only", "hybrid", "remote") for t in T.compile_terms(work.get(k))])


def _texts(df: DataFrame, rules: dict) -> DataFrame:
    body = full_text(*[F.col(c) for c in TEXT_FIELDS[1:] if c in df.columns], sep="\n")
    tags = tag_text(*[F.col(c) for c in TAG_FIELDS if c in df.columns])
    df = df.withColumns({"_body": body, "_title": F.coalesce("title", F.lit("")), "_tags": tags})
    # Line ends part the fields, so the search form of the text is that of its parts.
    df = df.withColumns({f"{c}_low": T.search_form(F.col(c)) for c in ("_body", "_title", "_tags")})
    df = df.withColumns({f"_text{low}": full_text(*[F.col(c + low) for c in ("_title", "_body", "_tags")], sep="\n")
                         for low in ("", "_low")})
    terms, work_terms = _term_lists(rules)
    if "details" in df.columns:
        kept = F.filter(F.map_entries("details"), lambda e: e["value"].isNotNull() & (e["value"] != ""))
        details = F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " ; ")
        df = df.withColumn("_cond", F.concat_ws("\n", blank_to_null(F.col("_text")), blank_to_null(details)))
        df = df.withColumn("_cond_low", T.search_form(F.col("_cond")))
        df = df.withColumns({"_text_words": T.term_words(terms, F.col("_text_low"), P.MUST_WORDS),
                             "_cond_words": T.term_words(work_terms, F.col("_cond_low"))})
    else:
        df = df.withColumns({"_cond": F.col("_text"), "_cond_low": F.col("_text_low"),
                             "_text_words": T.term_words(terms + work_terms, F.col("_text_low"), P.MUST_WORDS)})
        df = df.withColumn("_cond_words", F.col("_text_words"))
    return df.withColumn("_must_low", P.must_sections(F.col("_body_low"), folded=True, words=F.col("_text_words")))


def _groups(df: DataFrame, rules: dict) -> DataFrame:
    """J13 + A10: points and reasons of every group, in one projection per step."""
    weights, caps = rules.get("weights") or {}, rules.get("caps") or {}
    groups = rules.get("groups") or {}
    df = df.withColumns({f"_m_{i}_{c}": _matched((cfg or {}).get(c), "_text", "_text_words")
                         for i, cfg in enumerate(groups.values()) for c in CATEGORIES})
    structs = []
    for i, gid in enumerate(groups):
        found = {c: F.col(f"_m_{i}_{c}") for c in CATEGORIES}
        points = {c: capped_points(F.size(found[c]), int(weights.get(c, 0)), caps.get(c)) for c in CATEGORIES}
        positive = sum((F.greatest(p, F.lit(0)) for p in points.values()), F.lit(0))
        negative = sum((F.least(p, F.lit(0)) for p in points.values()), F.lit(0))
        reasons = F.array_compact(F.array(*[F.when(F.size(found[c]) > 0, F.concat(
            F.lit(f"{label} [{gid}]: "), F.array_join(found[c], ", "), F.lit(" ("),
            _signed(points[c]), F.lit(")"))) for c, label in CATEGORIES.items()]))
        structs.append(F.struct(
            positive.alias("positive"), (-negative).alias("penalty"), F.lit(-i).alias("rank"),
            F.lit(gid).alias("group_id"), (positive + negative).alias("score"), reasons.alias("reasons")))
    none = F.array().cast("array<struct<positive:int,penalty:int,rank:int,group_id:string,score:int,reasons:array<string>>>")
    df = df.withColumn("_parts", F.array(*structs) if structs else none).drop(
        *[f"_m_{i}_{c}" for i in range(len(groups)) for c in CATEGORIES])
    # Most positive points, then the larger penalty, then configuration order.
    return df.withColumn("_best", F.array_max("_parts")) \
        .withColumn("_best", F.when(F.size("_best.reasons") > 0, F.col("_best")))


def score(df: DataFrame, rules: dict, today: dt.date, available_from: dt.date | None = None) -> DataFrame:
    """Adds the ``suitability`` struct.  Row-local: no join, no shuffle, no Python."""
    keep = df.columns
    common, conditions = rules.get("common") or {}, rules.get("conditions") or {}
    thresholds = rules.get("thresholds") or {}
    df = _groups(_texts(df, rules), rules)
    reasons, technical = [F.coalesce(F.col("_best.reasons"), F.expr("cast(array() as array<string>)"))], \
        F.coalesce(F.col("_best.score"), F.lit(0))
    none = F.lit(None).cast("string")

    def one(flag: Column, text: Column) -> Column:
        return F.array_compact(F.array(F.when(flag, text)))

    role = common.get("role") or {}
    df = df.withColumn("_role", _matched(role.get("terms"), "_text", "_text_words"))
    role_points = int(role.get("points", 0))
    technical = technical + F.when(F.size("_role") > 0, role_points).otherwise(0)
    reasons.append(one(F.size("_role") > 0, F.concat(
        F.lit("Senior-/Beratungsrolle: "), F.array_join(F.slice("_role", 1, 4), ", "),
        F.lit(f" ({role_points:+d})"))))

    for i, rule in enumerate(common.get("competency_bonuses") or []):  # A22
        df = df.withColumns({f"_need{i}": _matched(rule.get("requires"), "_text", "_text_words"),
                             f"_skill{i}": _matched(rule.get("skills"), "_text", "_text_words")})
        has = (F.size(f"_need{i}") > 0) & (F.size(f"_skill{i}") > 0)
        points = F.least(F.lit(int(rule.get("max_points", 10))),
                         F.size(f"_skill{i}") * int(rule.get("points_per_skill", 5)))
        technical = technical + F.when(has, points).otherwise(0)
        reasons.append(one(has, F.concat(
            F.lit(f"Kompetenzbonus {rule.get('label', '')}: "), F.array_join(f"_skill{i}", ", "),
            F.lit(" ("), _signed(points), F.lit(")"))))

    # Unsupported must-haves: the first rule found in title and requirements rejects and
    # stops; a rule found before it in the requirements only costs points.
    penalty, rejected, reject_reason = int(rules.get("must_have_penalty", 0)), F.lit(False), none
    for i, rule in enumerate(common.get("unsupported_must_haves") or []):
        terms = rule.get("terms") or []
        label = rule.get("label") or ", ".join(terms)
        df = df.withColumns({f"_um{i}": _matched(terms, "_must"), f"_ut{i}": _matched(terms, "_title")})
        in_must = F.size(f"_um{i}") > 0
        rejects = ~rejected & in_must & (F.size(f"_ut{i}") > 0)
        costs = ~rejected & in_must & (F.size(f"_ut{i}") == 0)
        found = F.array_join(f"_um{i}", ", ")
        reject_reason = F.coalesce(reject_reason, F.when(rejects, F.concat(
            F.lit(f"Nicht belegte Muss-Anforderung im Titel und in den Anforderungen: {label} ("),
            found, F.lit(")"))))
        technical = technical + F.when(costs, penalty).otherwise(0)
        reasons.append(one(costs, F.concat(
            F.lit(f"Nicht belegte Anforderung im Muss-Abschnitt: {label} ("), found,
            F.lit(f") ({penalty:+d})"))))
        rejected = rejected | rejects
    df = df.withColumns({"_technical": F.greatest(F.lit(0), F.least(F.lit(100), technical)),
                         "_reject": reject_reason, "_reasons": F.concat(*reasons)})

    cap, cap_reason = F.lit(None).cast("struct<cap:int,reason:string>"), None
    for i, rule in enumerate(common.get("specialist_roles") or []):
        df = df.withColumns({f"_sr{i}": _matched(rule.get("required_experience_terms"), "_must"),
                             f"_st{i}": _matched(rule.get("title_terms"), "_title")})
        required, in_title = F.col(f"_sr{i}"), F.col(f"_st{i}")
        limit = int(rule.get("score_cap", 40))
        where = F.when(F.size(in_title) > 0, F.concat(
            F.lit("Titel: "), F.array_join(in_title, ", "), F.lit("; "))).otherwise("")
        text = F.concat(
            F.lit(f"{rule.get('label') or 'Spezialistenrolle'}: zwingend geforderte Spezialerfahrung nicht belegt ("),
            where, F.lit("Anforderungen: "), F.array_join(F.slice(required, 1, 5), ", "), F.lit(")"),
            F.when(F.col("_technical") > limit, f" — fachliche Eignung auf {limit} begrenzt").otherwise(""))
        applies = (F.size(required) > 0) & ((F.size(in_title) > 0) | (F.size(required) >= 2))
        cap = F.coalesce(cap, F.when(applies, F.struct(F.lit(limit).alias("cap"), text.alias("reason"))))
    df = df.withColumn("_cap", cap)
    technical = F.least(F.col("_technical"), F.coalesce(F.col("_cap.cap"), F.lit(100)))
    technical = F.when(F.col("_reject").isNotNull(), F.least(
        technical, F.lit(int(rules.get("reject_score_cap", 10))))).otherwise(technical)
    df = df.withColumns({
        "_technical": technical,
        "_reasons": F.concat("_reasons", F.array_compact(F.array("_cap.reason", "_reject"))),
        "_work": work_mode_condition(conditions.get("work_mode") or {}, "_cond", "_cond_words"),
        "_load": P.workload(F.col("_cond"), low_text=F.col("_cond_low"), **_workload_bounds(conditions.get("workload") or {})),
        "_start": start_condition(F.col("_cond"), today, available_from, F.col("_cond_low")),
    })
    decision = F.when(F.col("_reject").isNotNull(), REJECT) \
        .when(F.col("_technical") >= int(thresholds.get("high", 50)), HIGH) \
        .when(F.col("_technical") >= int(thresholds.get("medium", 25)), MEDIUM).otherwise(LOW)
    adjust = conditions.get("score_adjustments") or {}
    total = F.col("_technical") \
        + F.when(F.col("_work.status") == P.NOT_OK, int(adjust.get("onsite_only", 0))).otherwise(0) \
        + F.when(F.col("_load.status") == P.NOT_OK, int(adjust.get("workload_outside", 0))).otherwise(0)
    df = df.withColumn("_decision", decision).withColumn(
        "_rec", recommend(F.col("_decision"), F.col("_work"), F.col("_load"), F.col("_start"), F.col("_reject")))
    scores = F.map_from_entries(F.transform("_parts", lambda p: F.struct(p["group_id"], p["score"])))
    result = F.struct(
        F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int").alias("score"),
        F.struct(F.col("_technical").cast("int").alias("score"), F.col("_decision").alias("decision"),
                 F.col("_best.group_id").alias("best_group"), scores.alias("group_scores"),
                 F.col("_reasons").alias("reasons")).alias("technical"),
        F.struct(F.col("_work").alias("work_mode"), F.col("_load").alias("workload"),
                 F.col("_start").alias("start")).alias("conditions"),
        F.col("_rec.recommendation").alias("recommendation"),
        F.col("_rec.reasons").alias("recommendation_reasons"),
        F.col("_reject").alias("reject_reason"))
    return with_fixed(df, "suitability", result).select(*keep, "suitability")


def _workload_bounds(cfg: dict) -> dict:
    return {"low": float(cfg.get("preferred_hours_min", 20)), "high": float(cfg.get("preferred_hours_max", 40)),
            "full_time": float(cfg.get("full_time_hours", 40))}


def recommend(decision: Column, work: Column, load: Column, start: Column, reject: Column) -> Column:
    """struct(recommendation, reasons)."""
    named = [(CONDITION_NAMES[k], c) for k, c in (("work_mode", work), ("workload", load), ("start", start))]
    violated = F.array_compact(F.array(*[F.when(
        c["status"].isin(P.NOT_OK, P.CONFLICT), F.concat(
            F.lit(f"{name}: "), c["status"], F.lit(" ("),
            F.coalesce(c["note"], c["value"], c["status"]), F.lit(")"))) for name, c in named]))
    unknown = F.array_compact(F.array(*[F.when(c["status"] == P.UNKNOWN, F.lit(n)) for n, c in named]))
    tail = F.array_compact(F.array(
        F.when(F.size(unknown) > 0, F.concat(F.lit("Offen (unbekannt): "), F.array_join(unknown, ", "))),
        F.when(start["status"] == P.NOT_CHECKED, "Starttermin nicht gegen eine Verfügbarkeit geprüft")))

    def out(recommendation: str, head: Column | str, rest: bool = True) -> Column:
        head = F.lit(head) if isinstance(head, str) else head
        why = F.concat(F.array(head), violated, tail) if rest else F.array(head)
        return F.struct(F.lit(recommendation).alias("recommendation"), why.alias("reasons"))

    onsite = work["status"] == P.NOT_OK
    return F.when(decision == REJECT, out(SKIP, F.coalesce(reject, F.lit("Fachlich abgelehnt")), False)) \
        .when(decision == LOW, out(SKIP, "Fachliche Eignung niedrig", False)) \
        .when((decision == MEDIUM) & onsite, out(SKIP, "Fachliche Eignung nur mittel und vollständig vor Ort")) \
        .when(decision == MEDIUM, out(REVIEW, "Fachliche Eignung mittel")) \
        .when(F.size(violated) > 0, out(REVIEW, "Fachliche Eignung hoch, aber Rahmenbedingung verletzt")) \
        .otherwise(out(APPLY, "Fachliche Eignung hoch, keine Rahmenbedingung verletzt"))
