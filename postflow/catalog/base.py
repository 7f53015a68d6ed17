"""Registry and the views the registered queries share.

A view is a map of column name to an expression that Spark SQL and DuckDB both read, so
query and SQL counterpart start from the same rows of the given tables.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import LOCAL_SPREAD
from ..sources.config import SearchGroup, load_groups

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NOW = dt.datetime(2024, 1, 31)
TODAY = NOW.date()


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # Only a local session asks for this: its test files are one row group each.
    spread = spark.conf.get(LOCAL_SPREAD, None)
    return df.repartition(int(spread)) if spread and name in TEXT_TABLES else df


TEXT_TABLES = {"documents", "pages"}


def view(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def cte(name: str, source: str, columns: dict[str, str]) -> str:
    return f"{name} AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {source})"


def s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def pick(expr: str, n: int, values: list[str | None]) -> str:
    """CASE expr % n WHEN 0 THEN … END over SQL expressions; None is NULL."""
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values) if v is not None)
    return f"CASE {expr} % {n} {whens} ELSE NULL END"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


NL = "chr(10)"

# Postings: a document with the facts a posting states.  Every text is the whole document.
_RATE = pick("doc_id", 7, [
    f"' Stundensatz: ' || {s('60 + doc_id % 80')} || ' EUR'", f"' Tagessatz ca. ' || {s('500 + doc_id % 900')}",
    "' 95,50 EUR/Std'", "' 1.200 EUR / Tag'", f"' hourly rate: ' || {s('50 + doc_id % 50')} || ',5'", "''", "''"])
_MODE = pick("doc_id", 6, ["' 100% remote'", "' hybrid'", "' vor ort'", "' präsenz'", "''",
                           f"' ' || {s('(doc_id % 11) * 10')} || ' % Remote'"])
_CONTRACT = pick("doc_id", 5, ["' freiberuflich'", "' keine ANÜ'", "' Festanstellung'", "' Zeitarbeit'", "''"])
_LANGUAGE = pick("doc_id", 4, ["' Deutschkenntnisse'", "' English language'", "' niederländisch'", "''"])
_START = pick("doc_id", 6, [
    f"'Start: asap'", f"'Starttermin: 0' || {s('1 + doc_id % 9')} || '.1' || {s('doc_id % 3')} || '.2024'",
    f"'Zeitraum: 15.0' || {s('1 + doc_id % 9')} || '.2024 – 31.12.2024'", "'Beginn: Mitte März'",
    "'Start: Ende April 2024, spätestens 01.06.2024, kurzfristig'", "''"])
_LOAD = pick("doc_id", 8, [
    f"'Auslastung: ' || {s('20 + doc_id % 80')} || ' %'", f"{s('10 + doc_id % 40')} || ' Stunden pro Woche'",
    "'20-30 Std. / Woche'", f"{s('1 + doc_id % 5')} || ' Tage pro Woche'", "'2 bis 3 Tage je Woche'",
    "'Vollzeit'", "'Teilzeit'", "''"])
_MUST = pick("doc_id", 3, [
    f"'**Profil**' || {NL} || '- ' || substr(text, 1, 60) || {NL} || 'Nice-to-have: ' || substr(text, 61, 40)",
    f"'Anforderungen:' || {NL} || '- ' || substr(text, 1, 40) || {NL} || 'MUSS-Kriterien:' || {NL} || '- ' || substr(text, 41, 40)",
    "''"])
POSTING = {
    "doc_id": "doc_id",
    "title": f"split_part(text, {NL}, 1)",
    "description": f"text || {NL} || {_MUST} || {NL} || {_START} || {NL} || {_LOAD} || {NL} || "
                   f"{_MODE} || {_CONTRACT} || {_LANGUAGE} || {_RATE}",
    "schlagworte": "lang || ' ' || source",
    "published_date": f"CASE WHEN doc_id % 9 = 0 THEN NULL ELSE '2024-01-' || lpad({s('1 + doc_id % 30')}, 2, '0') END",
}
POSTING_CTE = cte("p", "documents", POSTING)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "documents", POSTING)


# Dashboard rows over the same documents.
CORPUS = {
    "id": "doc_id",
    "title": f"split_part(text, {NL}, 1)",
    "company": pick("doc_id", 5, ["'Acme ' || source", "'Globex'", "'Initech'", "source", None]),
    "status": pick("doc_id", 9, ["'scraped'", "'evaluated'", "'rejected'", "'accepted'", "'applied'",
                                 "'sent'", "'open'", "'archived'", "'unheard'"]),
    "provider_name": pick("doc_id", 4, ["'Gulp'", "'freelancermap'", "''", None]),
    "collection_channel": pick("doc_id", 3, ["'rss'", "'email'", "'manual'"]),
    "retrieval_date": f"CASE WHEN doc_id % 10 = 0 THEN NULL ELSE '2024-01-' || lpad({s('1 + (doc_id * 7) % 30')}, 2, '0') "
                      f"|| CASE WHEN doc_id % 2 = 0 THEN 'T10:00:00' ELSE '' END END",
    "pre_eval_score": "CASE WHEN doc_id % 6 = 0 THEN NULL ELSE CAST((doc_id * 13) % 101 AS INT) END",
    "llm_score": "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST((doc_id * 29) % 101 AS INT) END",
    "fit_score": "CASE WHEN doc_id % 3 = 0 THEN 0 ELSE CAST((doc_id * 31) % 101 AS INT) END",
    "search_groups": "lang || ',' || source",
    "best_profile": pick("doc_id", 4, ["'alpha'", "'beta'", "'gamma'", None]),
    "llm_priority": pick("doc_id", 5, ["'high_priority'", "'review'", "'low_priority'", None, "''"]),
    "evaluation_status": pick("doc_id", 6, ["'ok'", "'pending_retry'", "'failed'", "'unsafe_content'", None, "'ok'"]),
}
CORPUS_CTE = cte("c", "documents", CORPUS)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "documents", CORPUS).withColumn("search_groups", F.split("search_groups", ","))


# State changes: a user is a posting, an event type is a target state.
STATE_EVENT = {
    "project_id": "user_id",
    "ts": "ts",
    "event_id": "event_id",
    "to_state": "CASE event_type WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'evaluated' ELSE 'archived' END "
                "WHEN 'signup' THEN 'accepted' WHEN 'click' THEN 'applied' WHEN 'purchase' THEN 'sent' "
                "ELSE CASE WHEN event_id % 3 = 0 THEN 'scraped' ELSE 'rejected' END END",
    "force": "event_id % 17 = 0",
    "ui_context": "event_id % 23 = 0",
}
STATE_EVENT_CTE = cte("e", "events", STATE_EVENT)


def state_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "events", STATE_EVENT)


# Feed entries: pages sighted in two feeds each, so URLs repeat across feeds.
FEED_ENTRY = {
    "feed": "'https://feeds.example.com/' || substr(regexp_extract(url, '[.]example[.]([a-z]+)', 1), 1, 3) || '.xml'",
    "entry_ord": "page_id",
    "link": "url",
    "title": "regexp_extract(html, '<title>([^<]*)</title>', 1)",
    "summary": "regexp_extract(html, '<article><h1>([^<]*)</h1>', 1)",
    "published": "CASE WHEN page_id % 8 = 0 THEN NULL ELSE CAST('2024-01-' || lpad(CAST(1 + page_id % 30 AS STRING), 2, '0') "
                 "|| ' 00:00:00' AS TIMESTAMP) END",
    "page_id": "page_id",
}
FEED_CTE = cte("f", "pages", FEED_ENTRY)


def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "pages", FEED_ENTRY).withColumn("provider", F.lit("freelancermap"))


# Rule lists made of words that do occur in the texts.
GROUP_CONFIG = {"search_groups": {
    "anglo": {"priority": 1, "display_name": "Anglo", "providers": {"freelancermap": {"channels": {"rss": {
        "feed_urls": ["https://feeds.example.com/com.xml", "https://feeds.example.com/net.xml"],
        "limit": None, "max_age_days": 0}}}},
        "filters": {"include_terms": ["anat", "thha*", "That of", "onre", "an-at*", "ing the"],
                    "include_min_matches": 2,
                    "exclude_terms": ["ndble", "the[aei]rou", "(unclosed"],
                    "contract_type": {"allowed": ["freelance"]},
                    "work_mode": {"allowed": ["remote", "hybrid"]},
                    "rate": {"min_hourly": 80, "max_hourly": 130, "min_daily": 600, "max_daily": 1300},
                    "language": {"allowed": ["de", "en"]}, "max_age_days": 14}},
    "romance": {"priority": 2, "display_name": "Romance", "providers": {"freelancermap": {"channels": {"rss": {
        "feed_urls": ["https://feeds.example.com/org.xml", "https://feeds.example.com/net.xml"],
        "limit": None, "max_age_days": 0}}}},
        "filters": {"include_terms": ["que", "des", "para", "der", "le la", "sch*"],
                    "work_mode": {"allowed": ["onsite"], "reject_if_unknown": True}}},
}}
PREFILTER_TERMS = ["spam*", "pills", "anat*", "der"]


def groups() -> list[SearchGroup]:
    return load_groups(GROUP_CONFIG, PREFILTER_TERMS)


WORD_RE2 = "0-9A-Za-zÄÖÜäöüß"


def term_re2(term: str) -> str:
    """The term rule for the original text, in a dialect without look-around."""
    parts = [p for p in re.split(r"[\s\-]+", term.rstrip("*").strip()) if p]
    body = r"[\s\-]*".join(re.escape(p) for p in parts)
    tail = "" if term.endswith("*") else f"(?:[^{WORD_RE2}]|$)"
    return f"(?i)(?:^|[^{WORD_RE2}]){body}{tail}"


def hit(term: str, column: str) -> str:
    return f"regexp_matches({column}, {text(term_re2(term))})"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(values) + "]"


def matched_sql(terms: list[str], column: str) -> str:
    whens = [f"CASE WHEN {hit(t, column)} THEN {text(t)} END" for t in terms]
    return f"list_filter({sql_list(whens)}, lambda x: x IS NOT NULL)"
