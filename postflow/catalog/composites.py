"""Composite scoring jobs and the extension points over the tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import pii, postings as P, responses as R, text as T
from ..operators import counters, evaluation, pages as PG, similarity, suitability
from ..operators.extractors import Registry
from ..plans import scoring
from . import literals as V
from .base import NL, POSTING_CTE, TODAY, hit, postings, query, s, table, text, view
from .joins import VECTORS, profiles
from .projections import (ANSWER, BODY_CTE, PII_SQL, PII_VIEW, STOP_SQL, TOKEN_RE, bodies, fold_sql, must_sql, re,
                          start_sql, workload_sql)
from .streams import ROUTE_SQL, outcome


C1_SQL = f"""WITH {VECTORS}, r AS (SELECT dv.doc_id, pv.profile_id, dv.term, row_number() OVER (PARTITION BY dv.doc_id, pv.profile_id ORDER BY x * w DESC, pos) AS rn FROM dv JOIN pv ON pv.term = dv.term),
tm AS (SELECT doc_id, profile_id, string_agg(term, ' ' ORDER BY rn) AS top_matches FROM r WHERE rn <= 10 GROUP BY doc_id, profile_id),
b AS (SELECT * FROM (SELECT scores.*, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, CAST(profile_id AS BIGINT)) AS rn FROM scores) WHERE rn = 1 AND score > 0)
SELECT d.doc_id, b.profile_id AS best_profile, coalesce(b.score, 0.0) AS best_score, top_matches FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN tm ON tm.doc_id = b.doc_id AND tm.profile_id = b.profile_id"""


@query("c1_similarity_score", C1_SQL)
def c1(spark, d):
    scored = similarity.best_profiles(table(spark, d, "documents"), profiles(spark, d), "doc_id")
    return scored.withColumn("top_matches", F.when(F.col("best_profile").isNotNull(), F.array_join("top_matches", " ")))


@query("c1_profile_search", C1_SQL)
def c1_search(spark, d):
    """The same by the inverted index, which scores only the pairs that can win."""
    index = similarity.build_index(profiles(spark, d))
    scored = similarity.search_profiles(table(spark, d, "documents"), index, "doc_id")
    return scored.withColumn("top_matches", F.when(F.col("best_profile").isNotNull(), F.array_join("top_matches", " ")))


RULES = {
    "weights": {"high": 15, "medium": 8, "transferable": 4, "low_priority": -15},
    "caps": {"high": 45, "medium": 24, "transferable": 8, "low_priority": -45},
    "thresholds": {"high": 50, "medium": 25}, "reject_score_cap": 10, "must_have_penalty": -25,
    "groups": {"anglo": {"high": ["anat", "thha*", {"term": "onre", "with": ["ing the", "that of"]}], "medium": ["ing the", "that of"], "low_priority": ["ndble"]},
               "romance": {"high": ["que", "des"], "medium": ["para", "le la"], "transferable": ["der"], "low_priority": ["aux"]}},
    "common": {"role": {"points": 10, "terms": ["and", "et", "und"]},
               "competency_bonuses": [{"label": "Bonus", "requires": ["that"], "skills": ["anat", "thha*"], "points_per_skill": 5, "max_points": 8}],
               "unsupported_must_haves": [{"label": "Zwei", "terms": ["to", "la"]}, {"label": "Drei", "terms": ["of"]}],
               "specialist_roles": [{"label": "Spezialist", "score_cap": 40, "title_terms": ["the"], "required_experience_terms": ["th*", "in", "on"]}]},
    "conditions": {"work_mode": {"onsite_only": ["vor ort"], "hybrid": ["hybrid"], "remote": ["remote"]},
                   "workload": {"preferred_hours_min": 20, "preferred_hours_max": 40, "full_time_hours": 40},
                   "score_adjustments": {"onsite_only": -20, "workload_outside": -10}},
}
TEXT = f"title || {NL} || description || {NL} || schlagworte"
BODY_TEXT = "description"


def _n(terms: list, col: str) -> str:
    tests = []
    for t in terms:
        if isinstance(t, dict):
            tests.append(f"({hit(t['term'], col)} AND ({' OR '.join(hit(c, col) for c in t['with'])}))")
        else:
            tests.append(hit(t, col))
    return "(" + " + ".join(f"CASE WHEN {t} THEN 1 ELSE 0 END" for t in tests) + ")" if tests else "0"


def _pts(group: str, category: str) -> str:
    terms, w, cap = RULES["groups"][group].get(category, []), RULES["weights"][category], RULES["caps"][category]
    return f"{'greatest' if cap < 0 else 'least'}({_n(terms, 't')} * ({w}), {cap})"


_POS = {g: f"({_pts(g, 'high')} + {_pts(g, 'medium')} + {_pts(g, 'transferable')})" for g in RULES["groups"]}
_NEG = {g: _pts(g, "low_priority") for g in RULES["groups"]}
_COMMON = RULES["common"]
SUIT_SQL = f"""WITH {POSTING_CTE}, base AS (SELECT doc_id, title, {TEXT} AS t, {TEXT} AS c, {must_sql(BODY_TEXT)} AS must FROM p),
pt AS (SELECT *, {_POS['anglo']} AS pa, {_NEG['anglo']} AS na, {_POS['romance']} AS pr, {_NEG['romance']} AS nr FROM base),
bg AS (SELECT *, CASE WHEN pa > pr OR (pa = pr AND -na >= -nr) THEN CASE WHEN pa <> 0 OR na <> 0 THEN 'anglo' END ELSE CASE WHEN pr <> 0 OR nr <> 0 THEN 'romance' END END AS best_group FROM pt),
um AS (SELECT *, {_n(_COMMON['unsupported_must_haves'][0]['terms'], 'must')} > 0 AS m1, {_n(_COMMON['unsupported_must_haves'][0]['terms'], 'title')} > 0 AS t1,
 {_n(_COMMON['unsupported_must_haves'][1]['terms'], 'must')} > 0 AS m2, {_n(_COMMON['unsupported_must_haves'][1]['terms'], 'title')} > 0 AS t2,
 {_n(_COMMON['specialist_roles'][0]['required_experience_terms'], 'must')} AS sr, {_n(_COMMON['specialist_roles'][0]['title_terms'], 'title')} AS st FROM bg),
tc AS (SELECT *, (m1 AND t1) OR (m2 AND t2) AS rejected,
 greatest(0, least(100, CASE best_group WHEN 'anglo' THEN pa + na WHEN 'romance' THEN pr + nr ELSE 0 END + CASE WHEN {_n(_COMMON['role']['terms'], 't')} > 0 THEN 10 ELSE 0 END
  + CASE WHEN {_n(['that'], 't')} > 0 THEN least(8, 5 * {_n(['anat', 'thha*'], 't')}) ELSE 0 END + CASE WHEN m1 AND NOT t1 THEN -25 ELSE 0 END + CASE WHEN NOT (m1 AND t1) AND m2 AND NOT t2 THEN -25 ELSE 0 END)) AS raw FROM um),
cp AS (SELECT *, CASE WHEN sr > 0 AND (st > 0 OR sr >= 2) THEN least(raw, 40) ELSE raw END AS capped FROM tc),
fin AS (SELECT *, CASE WHEN rejected THEN least(capped, 10) ELSE capped END AS technical FROM cp),
dc AS (SELECT *, CASE WHEN rejected THEN 'abgelehnt' WHEN technical >= 50 THEN 'hoch' WHEN technical >= 25 THEN 'mittel' ELSE 'niedrig' END AS decision FROM fin),
wk AS ({workload_sql('c', 'base')}), sd AS ({start_sql('c', 'base', TODAY)}),
wm AS (SELECT doc_id, TRY_CAST(nullif(regexp_extract(c, {re(V.REMOTE_SHARE)}, 1), '') AS INT) AS share, {hit('vor ort', 'c')} AS onsite, {hit('hybrid', 'c')} AS hybrid, {hit('remote', 'c')} AS remote FROM base),
wmd AS (SELECT doc_id, CASE WHEN onsite THEN 'nicht erfüllt' WHEN share >= 100 THEN 'erfüllt' WHEN share <= 0 THEN 'nicht erfüllt' WHEN share IS NOT NULL THEN 'teilweise' WHEN hybrid THEN 'teilweise' WHEN remote THEN 'erfüllt' ELSE 'unbekannt' END AS work_status FROM wm),
al AS (SELECT dc.*, work_status, wk.status AS load_status, CASE WHEN sd.start IS NULL THEN 'unbekannt' ELSE 'nicht geprüft' END AS start_status,
 greatest(0, least(100, technical + CASE WHEN work_status = 'nicht erfüllt' THEN -20 ELSE 0 END + CASE WHEN wk.status = 'nicht erfüllt' THEN -10 ELSE 0 END)) AS score
 FROM dc JOIN wk ON wk.doc_id = dc.doc_id JOIN wmd ON wmd.doc_id = dc.doc_id LEFT JOIN sd ON sd.doc_id = dc.doc_id)"""


def _scored(spark, d):
    return suitability.score(postings(spark, d), RULES, TODAY)


@query("c2_suitability", f"""{SUIT_SQL} SELECT doc_id, CAST(score AS INT) AS score, CAST(technical AS INT) AS technical, decision, best_group, work_status, load_status, start_status, CAST(pa + na AS INT) AS anglo, CAST(pr + nr AS INT) AS romance FROM al""")
def c2(spark, d):
    v = "suitability."
    return _scored(spark, d).select(
        "doc_id", F.col(v + "score").alias("score"), F.col(v + "technical.score").alias("technical"), F.col(v + "technical.decision").alias("decision"),
        F.col(v + "technical.best_group").alias("best_group"), F.col(v + "conditions.work_mode.status").alias("work_status"),
        F.col(v + "conditions.workload.status").alias("load_status"), F.col(v + "conditions.start.status").alias("start_status"),
        F.col(v + "technical.group_scores")["anglo"].alias("anglo"), F.col(v + "technical.group_scores")["romance"].alias("romance"))


@query("c3_recommendation", f"""{SUIT_SQL} SELECT doc_id, CASE WHEN decision IN ('abgelehnt', 'niedrig') THEN 'Nicht bewerben' WHEN decision = 'mittel' AND work_status = 'nicht erfüllt' THEN 'Nicht bewerben' WHEN decision = 'mittel' THEN 'Prüfen'
 WHEN work_status = 'nicht erfüllt' OR load_status = 'nicht erfüllt' THEN 'Prüfen' ELSE 'Bewerben' END AS recommendation,
 CASE WHEN decision IN ('abgelehnt', 'niedrig') THEN 1 ELSE 1 + CAST(work_status = 'nicht erfüllt' AS INT) + CAST(load_status = 'nicht erfüllt' AS INT) + CAST(work_status = 'unbekannt' OR load_status = 'unbekannt' OR start_status = 'unbekannt' AS INT) + CAST(start_status = 'nicht geprüft' AS INT) END AS n_reasons FROM al""")
def c3(spark, d):
    return _scored(spark, d).select("doc_id", F.col("suitability.recommendation").alias("recommendation"),
                                    F.size("suitability.recommendation_reasons").alias("n_reasons"))


DIGESTS = {"alpha": "- x", "beta": "- y"}
PROMPT = "Bewerte{note}\n{profiles}\n{text}\nIDs {profile_ids}"
LIMITS = evaluation.Limits(max_input_tokens=1800, max_calls_per_run=None, daily_budget=1e9, monthly_budget=1e9)


@query("c4_evaluation_requests", f"""{PII_SQL}, sc AS (SELECT doc_id, trim(x, ' ' || chr(10) || chr(9)) AS x FROM t6),
tr AS (SELECT doc_id, x, length(x) > 4000 AS cut, CASE WHEN length(x) > 4000 THEN rtrim(substr(x, 1, 1950), ' ' || {NL}) || {' || chr(10) || '.join(text(p) for p in V.TRUNCATION_MARK.split(chr(10)))} || ltrim(right(x, 1950), ' ' || {NL}) ELSE x END AS y FROM sc),
g AS (SELECT *, trim(regexp_replace(regexp_replace(x, '\\[(?:EMAIL|PHONE|IBAN|NAME|SCRUBBED)\\]', '', 'g'), '\\s+', ' ', 'g')) AS u FROM tr),
sf AS (SELECT *, length(u) >= 150 AND NOT regexp_matches(u, {text(V.PHONE)}) AND NOT regexp_matches(u, {text(V.EMAIL)}) AND NOT regexp_matches(u, {text('(?i)' + V.IBAN_LEFT)}) AS safe,
 greatest(1, (length(y) + {len(PROMPT.replace('{note}', '').replace('{profiles}', '').replace('{text}', '').replace('{profile_ids}', '')) + len('[' + ', '.join(f'"{p}"' for p in DIGESTS) + ']') + len(chr(10) * 2) + sum(len(f'<profile id="{p}">') + 1 + len(v) + 1 + len('</profile>') for p, v in DIGESTS.items())} + CASE WHEN cut THEN {len(V.TRUNCATION_NOTE)} ELSE 0 END) // 4) AS tk FROM g),
rq AS (SELECT doc_id, CAST(tk * 0.25e-6 + 1024 * 1.25e-6 AS DECIMAL(18,6)) AS cost FROM sf WHERE safe)
SELECT CAST(sf.doc_id AS VARCHAR) AS project_id, tk AS est_input_tokens, cut AS input_truncated, CASE WHEN NOT safe THEN 'unsafe_content' WHEN rq.cost <= 1e9 THEN 'send' END AS action FROM sf LEFT JOIN rq ON rq.doc_id = sf.doc_id""")
def c4(spark, d):
    rows = view(spark, d, "documents", {**PII_VIEW, "project_id": s("doc_id"), "state": "'scraped'"})
    cache = spark.createDataFrame([], "cache_key string, line long, project_id string, cache_hit boolean, best_score int")
    log = spark.createDataFrame([], "timestamp string, cost_usd decimal(18,6)")
    asked = scoring.decisions(rows, cache, log, TODAY, DIGESTS, PROMPT, "0" * 16, "model-a", "v1", LIMITS)
    return asked.select("project_id", "est_input_tokens", "input_truncated", "action")


@query("c5_evaluation_ingest", f"""SELECT doc_id AS project_id, CASE WHEN doc_id % 9 = 8 THEN 'ok' WHEN doc_id % 10 = 0 THEN 'pending_retry' ELSE 'failed' END AS evaluation_status,
 CASE WHEN doc_id % 9 = 8 AND doc_id % 10 <> 0 THEN CASE WHEN (doc_id * 7) % 101 > doc_id % 101 THEN 'beta' ELSE 'alpha' END ELSE '' END AS best_profile,
 CAST(CASE WHEN doc_id % 9 = 8 AND doc_id % 10 <> 0 THEN greatest(doc_id % 101, (doc_id * 7) % 101) ELSE 0 END AS INT) AS best_score FROM documents""".replace(
    "CASE WHEN doc_id % 9 = 8 THEN 'ok' WHEN doc_id % 10 = 0 THEN 'pending_retry'", "CASE WHEN doc_id % 10 = 0 THEN 'pending_retry' WHEN doc_id % 9 = 8 THEN 'ok'"))
def c5(spark, d):
    answers = view(spark, d, "documents", ANSWER).select(
        F.col("doc_id").alias("project_id"), F.when(F.col("doc_id") % 10 != 0, F.col("raw")).alias("raw"), F.lit("timeout").alias("error"),
        F.lit(1000).alias("input_tokens"), F.lit(200).alias("output_tokens"))
    return evaluation.ingest(answers, ["alpha", "beta"]).select("project_id", "evaluation_status", "best_profile", "best_score")


_C6_VECTORS = VECTORS.replace("FROM documents)", "FROM (SELECT doc_id, body AS text FROM b WHERE NOT regexp_matches(body, '- [*][*]Score:[*][*]\\s*\\d+/100')))")


@query("c6_score_backfill", f"""WITH {BODY_CTE}, {_C6_VECTORS}, best AS (SELECT doc_id, max(score) AS score FROM scores GROUP BY doc_id)
SELECT b.doc_id, CASE WHEN regexp_matches(body, '- [*][*]Score:[*][*]\\s*\\d+/100') THEN 'skipped_existing' WHEN coalesce(score, 0) >= 0.05 THEN 'scored' ELSE 'skipped_low' END AS outcome,
 CASE WHEN NOT regexp_matches(body, '- [*][*]Score:[*][*]\\s*\\d+/100') THEN CAST(round_even(coalesce(score, 0) * 100, 0) AS INT) END AS score FROM b LEFT JOIN best ON best.doc_id = b.doc_id""")
def c6(spark, d):
    return scoring.backfill(bodies(spark, d), profiles(spark, d), "doc_id", min_score=0.05).select("doc_id", "outcome", "score")


@query("c7_routing_job", f"""{ROUTE_SQL}, o AS (SELECT en.feed, en.entry_ord, unnest(list_filter([CASE WHEN en.ga THEN 'anglo' END, CASE WHEN en.gr THEN 'romance' END], lambda g: g IS NOT NULL)) AS group_id, uc.o = (en.feed, en.entry_ord) AS first, uc.* EXCLUDE (o, ga, gr) FROM en JOIN uc ON uc.url_key = en.url_key),
oc AS (SELECT group_id, CASE WHEN group_id = 'anglo' AND va IS NOT NULL THEN CASE WHEN va = 'filtered' THEN 'filtered' ELSE 'known' END WHEN route = 'existing' THEN 'known' WHEN route = 'prefiltered' THEN 'filtered' WHEN route = 'deferred' THEN 'deferred' WHEN route = 'error' THEN 'errors'
 WHEN NOT CASE group_id WHEN 'anglo' THEN ok_a ELSE ok_r END THEN 'filtered' WHEN NOT first THEN 'known' WHEN NOT known AND (group_id = 'anglo' OR NOT ok_a) THEN 'created' ELSE 'merged' END AS outcome FROM o)
SELECT group_id, count(*) AS entries_found, count(*) FILTER (outcome = 'created') AS projects_saved, count(*) FILTER (outcome IN ('merged', 'known')) AS urls_skipped_dedupe, count(*) FILTER (outcome = 'filtered') AS projects_filtered,
 count(*) FILTER (outcome = 'errors') AS errors, count(*) FILTER (outcome = 'deferred') AS deferred FROM oc GROUP BY GROUPING SETS ((group_id), ())""")
def c7(spark, d):
    rows = outcome(spark, d).outcomes
    counts = counters.group_counters(rows.withColumn("unsuitable", F.lit(False)))
    return counts.where("level <> 'group_provider'").drop("level", "provider", "projects_unsuitable")


EXTRA_RULES = PG.COMMON_RULES + [
    PG.ExtractRule("com", "title", 1, "tag", "title", cleanup=r"[%*#]+"), PG.ExtractRule("com", "reference_id", 1, "url", r"/(\d+)"),
    PG.ExtractRule("com", "company", 1, "const", "Example GmbH")]


@query("x1_extractor_extension", """SELECT page_id, CASE WHEN contains(url, '.example.com') THEN 'Example GmbH' END AS company, nullif(CASE WHEN contains(url, '.example.com') THEN regexp_extract(url, '/(\\d+)', 1) ELSE regexp_extract(url, '([0-9]+)(?:\\.html)?/?(?:[?#].*)?$', 1) END, '') AS reference_id FROM pages""")
def x1(spark, d):
    """A provider of its own rules beside the fallback for all others."""
    provider = F.regexp_extract("url", r"\.example\.([a-z]+)", 1)
    return PG.extract_fields(table(spark, d, "pages"), EXTRA_RULES, provider).select("page_id", "company", "reference_id")


def com_pages(batch: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"reference_id": batch["url"].str.extract(r"/([0-9]+)")[0], "company": "Example GmbH",
                         "paragraphs": batch["html"].str.count("<p>")})


@query("x1_registered_extractor", """SELECT page_id, CASE WHEN contains(url, '.example.com') THEN 'Example GmbH' END AS company,
 CASE WHEN contains(url, '.example.com') THEN CAST(len(regexp_extract_all(html, '<p>')) AS VARCHAR) END AS paragraphs,
 nullif(CASE WHEN contains(url, '.example.com') THEN regexp_extract(url, '/([0-9]+)', 1) ELSE regexp_extract(url, '([0-9]+)(?:\\.html)?/?(?:[?#].*)?$', 1) END, '') AS reference_id FROM pages""")
def x1_registered(spark, d):
    """A provider with an extractor of its own beside the default rules for all others."""
    registry = Registry(["reference_id", "company", "paragraphs"]).register("com", com_pages)
    return registry.extract(table(spark, d, "pages"), F.regexp_extract("url", r"\.example\.([a-z]+)", 1)) \
        .select("page_id", "company", "paragraphs", "reference_id")


@query("x2_text_to_tokens", f"""SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({fold_sql('lower(text)')}, {TOKEN_RE})) AS term FROM documents) WHERE length(term) >= 2 AND term NOT IN {STOP_SQL} GROUP BY doc_id, term""")
def x2(spark, d):
    """One row to many: a document to its terms with their counts."""
    return similarity.with_terms(table(spark, d, "documents"), ["doc_id"]).where("term is not null").select("doc_id", "term", F.col("n").cast("bigint").alias("n"))
