"""Predicates over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mail, terms
from ..operators import corpus as C, evaluation, lifecycle, matching, retention
from ..sources import config
from ..sources.config import Choice, Filters, RateBounds
from . import literals as V
from .base import (CORPUS_CTE, FEED_CTE, GROUP_CONFIG, NOW, POSTING_CTE, PREFILTER_TERMS, STATE_EVENT_CTE, corpus, feed_entries, groups,
                   hit, matched_sql, postings, query, state_events, table, text, view)
from .projections import BODY_CTE, bodies, contract_sql, languages_sql, mode_sql, rate_sql
from .scans import FILES, FILES_CTE, MESSAGE, MESSAGE_CTE
from ..functions import postings as P

ANGLO = GROUP_CONFIG["search_groups"]["anglo"]["filters"]
FULL = "title || ' ' || description"
TOPIC = FULL + " || ' ; ' || schlagworte"

FACTS = f"""facts AS (SELECT doc_id, published_date, {FULL} AS t, {matched_sql(ANGLO['include_terms'], TOPIC)} AS m,
 CASE WHEN regexp_matches({FULL}, '(?i)ndble') THEN 'ndble' WHEN regexp_matches({FULL}, '(?i)the[aei]rou') THEN 'the[aei]rou' WHEN contains(lower({FULL}), '(unclosed') THEN '(unclosed' END AS ex,
 {contract_sql(FULL)} AS ct, {mode_sql(FULL)} AS wm, {rate_sql(FULL, V.HOURLY_LABELLED, V.HOURLY_UNIT)} AS h, {rate_sql(FULL, V.DAILY_LABELLED, V.DAILY_UNIT)} AS dy,
 {languages_sql(FULL)} AS lg FROM p)"""
RATE_OK = "(h IS NULL OR (h >= 80 AND h <= 130)) AND (dy IS NULL OR (dy >= 600 AND dy <= 1300))"
AGE_OK = "(published_date IS NULL OR TIMESTAMP '2024-01-31' - CAST(published_date AS TIMESTAMP) <= INTERVAL 14 DAY)"
LANG_OK = "(len(lg) = 0 OR list_has_any(lg, ['de', 'en']))"
CHECKS = {"include_terms": "len(m) >= 2", "exclude_terms": "ex IS NULL", "contract_type": "coalesce(ct = 'freelance', true)",
          "work_mode": "coalesce(wm IN ('remote', 'hybrid'), true)", "rate": RATE_OK, "language": LANG_OK, "max_age_days": AGE_OK}


@query("f1_filter_chain", f"""WITH {POSTING_CTE}, {FACTS} SELECT doc_id, {' AND '.join(f'({c})' for c in CHECKS.values())} AS passed,
 array_to_string(list_filter([{', '.join(f"CASE WHEN NOT ({c}) THEN '{k}' END" for k, c in CHECKS.items())}], lambda x: x IS NOT NULL), ',') AS failed,
 array_to_string(list_filter([CASE WHEN ct IS NULL THEN 'contract_type' END, CASE WHEN wm IS NULL THEN 'work_mode' END, CASE WHEN h IS NULL AND dy IS NULL THEN 'rate' END,
  CASE WHEN len(lg) = 0 THEN 'language' END, CASE WHEN published_date IS NULL THEN 'max_age_days' END], lambda x: x IS NOT NULL), ',') AS unknown FROM facts""")
def f1(spark, d):
    anglo = [g for g in groups() if g.group_id == "anglo"]
    return matching.apply_filters(postings(spark, d), anglo, NOW).select(
        "doc_id", "passed", F.array_join("failed_criteria", ",").alias("failed"), F.array_join("unknown_criteria", ",").alias("unknown"))


def one_check(spark, d, build):
    df = matching.with_texts(postings(spark, d))
    return df.select("doc_id", build(df).alias("c")).select("doc_id", "c.passed", "c.reason", "c.value_found", "c.was_unknown")


@query("f2_include_terms", f"""WITH {POSTING_CTE}, {FACTS} SELECT doc_id, len(m) >= 2 AS passed, array_to_string(m, ', ') AS value_found, false AS was_unknown,
 CASE WHEN len(m) >= 2 THEN 'Fachlicher Treffer: ' || array_to_string(m, ', ') WHEN len(m) = 1 THEN 'Nur 1 von 2 nötigen Fachbegriffen gefunden: ' || m[1] ELSE 'Kein Fachbegriff der Suchgruppe gefunden' END AS reason FROM facts""")
def f2(spark, d):
    return one_check(spark, d, lambda df: matching.check_include(
        terms.compile_terms(ANGLO["include_terms"]), 2, F.col("topic_low")))


@query("f3_exclude_terms", f"""WITH {POSTING_CTE}, {FACTS} SELECT doc_id, ex IS NULL AS passed, ex AS value_found, false AS was_unknown,
 CASE WHEN ex IS NULL THEN 'Kein Ausschlussbegriff gefunden' ELSE 'Ausschlussbegriff gefunden: ''' || ex || '''' END AS reason FROM facts""")
def f3(spark, d):
    return one_check(spark, d, lambda df: matching.check_exclude(Filters.of(ANGLO).exclude, F.col("full_text")))


@query("f4_work_mode", f"""WITH {POSTING_CTE}, {FACTS} SELECT doc_id, coalesce(wm IN ('remote', 'hybrid'), false) AS passed, wm AS value_found, wm IS NULL AS was_unknown,
 CASE WHEN wm IS NULL THEN 'Arbeitsmodell nicht bestimmbar — abgelehnt (reject_if_unknown=true)' WHEN wm IN ('remote', 'hybrid') THEN 'Arbeitsmodell ''' || wm || ''' ist erlaubt'
  ELSE 'Arbeitsmodell ''' || wm || ''' ist nicht erlaubt (erlaubt: [''remote'', ''hybrid''])' END AS reason FROM facts""")
def f4(spark, d):
    return one_check(spark, d, lambda df: matching.check_work_mode(df, Choice(("remote", "hybrid"), True), F.col("full_text")))


@query("f5_contract_type", f"""WITH {POSTING_CTE}, {FACTS} SELECT doc_id, coalesce(ct = 'freelance', true) AS passed, ct AS value_found, ct IS NULL AS was_unknown,
 CASE WHEN ct IS NULL THEN 'Vertragstyp nicht bestimmbar — akzeptiert (unbekannt → pass)' WHEN ct = 'freelance' THEN 'Vertragstyp ''freelance'' ist erlaubt'
  ELSE 'Vertragstyp ''' || ct || ''' ist nicht erlaubt (erlaubt: [''freelance''])' END AS reason FROM facts""")
def f5(spark, d):
    return one_check(spark, d, lambda df: matching.check_contract_type(df, Choice(("freelance",)), F.col("full_text")))


@query("f6_rate_bounds", f"""WITH {POSTING_CTE}, {FACTS} SELECT doc_id, h IS NULL AND dy IS NULL AS was_unknown, {RATE_OK} AS passed,
 CASE WHEN h IS NULL AND dy IS NULL THEN 'Stunden-/Tagessatz nicht angegeben — akzeptiert (unbekannt → pass)'
  WHEN NOT ({RATE_OK}) THEN concat_ws('; ', CASE WHEN h < 80 THEN 'Stundensatz ' || h || '€ < Minimum 80.0€' END, CASE WHEN h > 130 THEN 'Stundensatz ' || h || '€ > Maximum 130.0€' END,
   CASE WHEN dy < 600 THEN 'Tagessatz ' || dy || '€ < Minimum 600.0€' END, CASE WHEN dy > 1300 THEN 'Tagessatz ' || dy || '€ > Maximum 1300.0€' END)
  ELSE 'Satz akzeptiert (Std: ' || coalesce(CAST(h AS VARCHAR), 'None') || '€, Tag: ' || coalesce(CAST(dy AS VARCHAR), 'None') || '€)' END AS reason FROM facts""")
def f6(spark, d):
    return one_check(spark, d, lambda df: matching.check_rate(df, RateBounds(80.0, 130.0, 600.0, 1300.0), F.col("full_text"))).drop("value_found")


@query("f7_language", f"""WITH {POSTING_CTE}, {FACTS} SELECT doc_id, {LANG_OK} AS passed, len(lg) = 0 AS was_unknown, CASE WHEN len(lg) > 0 THEN array_to_string(lg, ', ') END AS value_found FROM facts""")
def f7(spark, d):
    return one_check(spark, d, lambda df: matching.check_language(df, Choice(("de", "en")), F.col("full_text"))).drop("reason")


@query("f8_max_age", f"""WITH {POSTING_CTE} SELECT doc_id, {AGE_OK} AS passed, published_date IS NULL AS was_unknown,
 CAST(date_diff('day', CAST(published_date AS DATE), DATE '2024-01-31') AS VARCHAR) AS value_found FROM p""")
def f8(spark, d):
    return one_check(spark, d, lambda df: matching.check_age(df, 14, NOW)).drop("reason")


_ANY = " OR ".join(hit(t, "t") for g in GROUP_CONFIG["search_groups"].values() for t in g["filters"]["include_terms"])
_EXCL = " ".join(f"WHEN {hit(t, 'title')} THEN {text(t)}" for t in PREFILTER_TERMS)


@query("f9_title_prefilter", f"WITH {FEED_CTE}, x AS (SELECT *, title || ' ; ' || coalesce(summary, '') AS t FROM f) SELECT page_id, CASE WHEN {_ANY} THEN NULL {_EXCL} END AS excluded_by FROM x")
def f9(spark, d):
    return feed_entries(spark, d).select("page_id", matching.title_prefilter(
        F.col("title"), F.col("summary"), terms.compile_terms(PREFILTER_TERMS), groups()).alias("excluded_by"))


FILTER = C.CorpusFilter(
    search="e", statuses=["scraped", "evaluated", "accepted", "open", "sent"], companies=[], providers=["GULP", "freelancermap"],
    channels=["rss", "manual"], date_from="2024-01-02", date_to="2024-01-29", pre_eval_score_min=2, pre_eval_score_max=98,
    llm_score_min=2, llm_score_max=99, search_groups=["en", "fr", "src3"], profile_ids=[], priority_labels=["high_priority", "review", "low_priority", "not_evaluated"],
    evaluation_statuses=["ok", "not_evaluated", "failed"])
FILTER_SQL = f"""WITH {CORPUS_CTE} SELECT * FROM c WHERE (contains(lower(coalesce(title, '')), 'e') OR contains(lower(coalesce(company, '')), 'e')) AND status IN ('scraped','evaluated','accepted','open','sent')
 AND lower(coalesce(nullif(provider_name, ''), 'freelancermap')) IN ('gulp','freelancermap') AND collection_channel IN ('rss','manual') AND CAST(substr(retrieval_date, 1, 10) AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-29'
 AND pre_eval_score BETWEEN 2 AND 98 AND llm_score BETWEEN 2 AND 99 AND list_has_any(string_split(search_groups, ','), ['en','fr','src3'])
 AND coalesce(nullif(llm_priority, ''), 'not_evaluated') IN ('high_priority','review','low_priority','not_evaluated') AND coalesce(evaluation_status, 'not_evaluated') IN ('ok','not_evaluated','failed')"""


@query("f10_corpus_query", f"SELECT id, title, status, retrieval_date FROM ({FILTER_SQL})")
def f10(spark, d):
    return C.corpus_query(corpus(spark, d), FILTER).select("id", "title", "status", "retrieval_date")


@query("f10_order_volume", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'P') AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-06-30' AND o_custkey >= 100""")
def f10_orders(spark, d):
    """The same predicates on the order table: filters and columns reach the scan."""
    rows = table(spark, d, "orders").select(
        "o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("pre_eval_score"),
        F.col("o_orderdate").alias("retrieval_date"))
    return C.corpus_query(rows, C.CorpusFilter(statuses=["O", "P"], date_from="1996-01-01", date_to="1997-06-30", pre_eval_score_min=100)) \
        .select("o_orderkey", "o_totalprice")


@query("f11_state_query", f"WITH {CORPUS_CTE} SELECT id, title FROM c WHERE status = 'scraped' AND company = 'Globex'")
def f11(spark, d):
    return C.by_state(corpus(spark, d).withColumnRenamed("status", "state"), "scraped", "Globex").select("id", "title")


TAGS = {"forbidden_tags": ["thha", "ndble"], "required_tags": ["e"], "weighted_tags": {"that": 3, "onre": 5, "que": 2, "der": 7}}
_POINTS = " + ".join(f"CASE WHEN contains(l, '{t}') THEN {w} ELSE 0 END" for t, w in TAGS["weighted_tags"].items())


def word_sql(w: str) -> str:
    return f"regexp_matches(l, '(?:^|[^\\pL\\pN_]){w}(?:[^\\pL\\pN_]|$)')"


F12_SQL = f"""SELECT doc_id, CASE WHEN {word_sql('thha')} THEN -1 WHEN {word_sql('ndble')} THEN -1 WHEN NOT contains(l, 'e') THEN 0 ELSE CAST(floor(({_POINTS}) / 17.0 * 100) AS INT) END AS score,
 CASE WHEN {word_sql('thha')} THEN 'Rejected: Contains forbidden tag ''thha''.' WHEN {word_sql('ndble')} THEN 'Rejected: Contains forbidden tag ''ndble''.' WHEN NOT contains(l, 'e') THEN 'Rejected: Missing required tag ''e''.' END AS rejection
 FROM (SELECT doc_id, lower(text) AS l FROM documents)"""


@query("f12_keyword_score", F12_SQL)
def f12(spark, d):
    score, why = matching.keyword_score(F.col("text"), TAGS)
    return table(spark, d, "documents").select("doc_id", score.alias("score"), F.when(why.startswith("Rejected"), why).alias("rejection"))


@query("f13_acceptance", f"""WITH {CORPUS_CTE} SELECT id, CASE WHEN pre_eval_score >= 50 AND fit_score >= 60 THEN 'accepted' ELSE 'rejected' END AS decision,
 CASE WHEN pre_eval_score >= 50 THEN 'accepted' ELSE 'rejected' END AS pre_only, CASE WHEN fit_score >= 60 THEN 'accepted' ELSE 'rejected' END AS forced FROM c""")
def f13(spark, d):
    pre, fit = F.col("pre_eval_score"), F.col("fit_score")
    return corpus(spark, d).select("id", matching.acceptance(pre, fit, 50, 60).alias("decision"),
                                   matching.acceptance(pre, fit, 50, 60, pre_only=True).alias("pre_only"),
                                   matching.acceptance(pre, fit, 50, 60, force=True).alias("forced"))


@query("f14_mail_match", f"WITH {MESSAGE_CTE} SELECT message_id FROM m WHERE (contains(sender, 'user@') OR contains(sender, 'bot@')) AND (regexp_matches(subject, '(?i)that') OR regexp_matches(subject, '(?i)^des?\\s'))")
def f14(spark, d):
    return view(spark, d, "conversations", MESSAGE).where(mail.mail_match(
        F.col("sender"), F.col("subject"), ["user@", "bot@"], ["that", r"^des?\s"])).select("message_id")


@query("f15_group_activation", f"""WITH {FEED_CTE} SELECT 'romance' AS group_id, feed, count(*) AS entries FROM f WHERE feed IN ('https://feeds.example.com/org.xml', 'https://feeds.example.com/net.xml') GROUP BY feed""")
def f15(spark, d):
    """Entries of the feeds of the requested active groups."""
    subs = config.subscriptions(spark, config.active_groups(groups(), ["romance"]))
    return feed_entries(spark, d).join(F.broadcast(subs), ["provider", "feed"]).groupBy("group_id", "feed").agg(F.count("*").alias("entries"))


_RETENTION = " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.RETENTION.items())
CATEGORY_SQL = """CASE WHEN regexp_matches(path, '[.]log$') THEN 'logs' WHEN regexp_matches(path, '^base/projects/.*[.]md$') THEN CASE o_orderstatus WHEN 'O' THEN 'scraped' WHEN 'F' THEN 'archived'
 WHEN 'P' THEN CASE WHEN length < 300 THEN 'rejected_low_pre_eval' WHEN length < 900 THEN 'rejected_low_llm' ELSE 'rejected_other' END END WHEN regexp_matches(path, '(^|/)temp/') THEN 'temp_files' WHEN contains(path, 'backup') THEN 'backups' ELSE 'other' END"""
PURGE_CTE = f"""{FILES_CTE}, pc AS (SELECT fl.o_orderkey, path, {CATEGORY_SQL} AS category, date_diff('second', CASE WHEN regexp_matches(path, '\\d{{8}}_\\d{{6}}') THEN strptime(regexp_extract(path, '\\d{{8}}_\\d{{6}}'), '%Y%m%d_%H%M%S')
 ELSE CAST(mtime AS TIMESTAMP) END, TIMESTAMP '1998-06-01 00:00:00') / 86400.0 AS age FROM fl JOIN orders o ON o.o_orderkey = fl.o_orderkey),
 cand AS (SELECT * FROM pc WHERE age > CASE category {_RETENTION} END)"""


def purge_candidates(spark, d):
    import datetime as dt
    columns = {**FILES, "state": "CASE o_orderstatus WHEN 'O' THEN 'scraped' WHEN 'F' THEN 'archived' ELSE 'rejected' END",
               "pre": "CASE WHEN o_custkey < 300 THEN 5 ELSE 50 END", "fit": "CASE WHEN o_custkey < 900 THEN 20 ELSE 90 END"}
    files = view(spark, d, "orders", columns).withColumn("mtime", F.col("mtime").cast("timestamp")).withColumn(
        "category", retention.file_category(F.col("path"), retention.posting_category(F.col("state"), F.col("pre"), F.col("fit"))))
    return retention.purge_candidates(files, dt.datetime(1998, 6, 1))


@query("f16_retention", f"WITH {PURGE_CTE} SELECT o_orderkey, category, CAST(floor(age) AS BIGINT) AS age_days FROM cand")
def f16(spark, d):
    return purge_candidates(spark, d).select("o_orderkey", "category", F.floor("age_days").alias("age_days"))


ARROWS_SQL = "(" + ", ".join(f"'{a}'" for a in lifecycle.ARROWS if a != lifecycle.OTHER) + ")"


@query("f17_transition_validity", f"""WITH {STATE_EVENT_CTE}, pr AS (SELECT event_id, lag(to_state) OVER (PARTITION BY project_id ORDER BY ts, event_id) AS from_state, to_state FROM e)
SELECT event_id, from_state, to_state FROM pr WHERE from_state || '>' || to_state IN {ARROWS_SQL}""")
def f17(spark, d):
    from ..operators.ordered import previous
    pairs = previous(state_events(spark, d), ["project_id"], ["ts", "event_id"], "to_state", "from_state")
    return lifecycle.valid_pairs(pairs).select("event_id", "from_state", "to_state")


@query("f18_minimum_score", f"WITH {BODY_CTE} SELECT doc_id FROM b WHERE NOT regexp_matches(body, '- [*][*]Score:[*][*]\\s*\\d+/100') AND doc_id * 31 % 101 >= 40")
def f18(spark, d):
    """Eligible: no score yet, and the fit score reaches the minimum."""
    from ..functions.markdown import PRE_SCORE
    return evaluation.eligible(bodies(spark, d), F.col("doc_id") * 31 % 101, 40, F.col("body").rlike(PRE_SCORE)).select("doc_id")
