"""Incremental and stateful operators over the tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import counters, evaluation, ledger, lifecycle
from ..plans import routing, scoring
from ..session import shared_dir
from ..sources import config, feeds
from ..streaming import ingest as SI, lifecycle as SL
from .base import (FEED_CTE, GROUP_CONFIG, NOW, PREFILTER_TERMS, STATE_EVENT, STATE_EVENT_CTE, cte, feed_entries, hit, pick, query, s, state_events,
                   table, text, view)
from .filters import ARROWS_SQL
from .joins import LEDGER_SQL, ledger_tables
from .projections import canon_sql, id_sql

NET = "'https://feeds.example.com/net.xml'"
ROUTE_CONFIG = {"search_groups": {
    g: {**{k: v for k, v in c.items() if k != "filters"}, "filters": {"include_terms": c["filters"]["include_terms"], "include_min_matches": 3}}
    for g, c in GROUP_CONFIG["search_groups"].items()}}


def setup(**changes) -> routing.Setup:
    return routing.Setup(**{"groups": config.load_groups(ROUTE_CONFIG, PREFILTER_TERMS), "now": NOW, "prefilter": PREFILTER_TERMS, **changes})


FINGERPRINTS = {g.group_id: g.fingerprint for g in config.load_groups(ROUTE_CONFIG, PREFILTER_TERMS)}


def entries(spark, d):
    """Every page is sighted in its own feed and once more in a second one."""
    first = feed_entries(spark, d).withColumn("entry_ord", 2 * F.col("entry_ord"))
    again = first.withColumn("feed", F.expr(NET)).withColumn("entry_ord", F.col("entry_ord") + 1) \
        .withColumn("link", F.concat("link", F.lit("#again")))
    return first.unionByName(again).drop("page_id")


# What earlier runs left: decisions for links seen over https, ids for .net pages without query.
PRIOR = {"page_id": "page_id", "url": "url", "title": "regexp_extract(html, '<title>([^<]*)</title>', 1)", "html": "html",
         "decision": pick("page_id", 4, ["'captured'", "'existing'", "'filtered'", "'filtered'"]),
         "terms": f"CASE WHEN page_id % 5 = 0 THEN 'old' ELSE '{FINGERPRINTS['anglo']}' END",
         "status": pick("page_id", 9, ["'error'"] + ["NULL"] * 8)}
DECIDED, PROCESSED, STORED, LANDED = ("url LIKE 'https%'", "url LIKE '%.net/%' AND url NOT LIKE '%utm_source%'", "url NOT LIKE '%.html%'", "url NOT LIKE '%#top'")


def prior(spark, d) -> tuple[routing.State, object]:
    v = view(spark, d, "pages", PRIOR).withColumn("url_key", urls.identity_url(F.col("url")))
    last = v.groupBy("url_key").agg(F.max_by(F.struct(*[c for c in v.columns if c != "url_key"]), "page_id").alias("v")).select("url_key", "v.*")
    rank = F.coalesce("status", F.when(F.col("decision").isin("captured", "existing"), F.col("decision")).otherwise("filtered"))
    seen_at = F.lit(dt.datetime(2024, 1, 20))
    decided = last.where(DECIDED)
    rows = decided.select(
        "url_key", "url", "title", F.lit("").alias("summary"), F.lit("freelancermap").alias("provider"), F.lit("x").alias("feed"),
        seen_at.alias("first_seen"), F.when(F.col("page_id") % 7 == 0, F.lit(dt.datetime(2023, 1, 1))).otherwise(seen_at).alias("last_seen"),
        rank.alias("status"), F.lit("page").alias("basis"), F.lit(0).alias("errors"), F.lit(None).cast("string").alias("last_error"))
    decisions = decided.select("url_key", F.lit("anglo").alias("group_id"), "decision", "terms")
    known = last.where(PROCESSED).withColumn("project_id", urls.project_id(F.col("url"), F.lit("")))
    postings = known.where(STORED).select(
        "project_id", "title", F.concat("html", F.lit("\n## Vorbewertung\nque des para der")).alias("description"), F.lit("2024-01-01").alias("created_at"),
        F.lit("scraped").alias("state"), F.array(F.lit("romance")).alias("search_groups"),
        F.array(F.struct(F.lit("freelancermap").alias("provider"), F.col("url").alias("url"), F.lit("2024-01-01").alias("discovered_at"), F.lit("rss").alias("channel"))).alias("sources"))
    pages = last.where(LANDED).select("url_key", F.col("title").alias("page_title"), F.col("html").alias("description"), F.lit(None).cast("string").alias("schlagworte"))
    return routing.State(rows, decisions, known.select("project_id"), postings), pages


def outcome(spark, d, **changes) -> routing.Outcome:
    state, pages = prior(spark, d)
    replay = changes.pop("replay", False)
    return routing.run(entries(spark, d), state, pages, setup(**changes), replay)


def _count(group: str, column: str) -> str:
    return " + ".join(f"CASE WHEN {hit(t, column)} THEN 1 ELSE 0 END" for t in ROUTE_CONFIG["search_groups"][group]["filters"]["include_terms"])


def _any(group: str, column: str) -> str:
    return "(" + " OR ".join(hit(t, column) for t in ROUTE_CONFIG["search_groups"][group]["filters"]["include_terms"]) + ")"


ROUTE_SQL = f"""WITH {FEED_CTE}, {cte('pr', 'pages', PRIOR)},
ent AS (SELECT feed, 2 * entry_ord AS entry_ord, link, title, summary FROM f UNION ALL SELECT {NET}, 2 * entry_ord + 1, link || '#again', title, summary FROM f),
en AS (SELECT *, {canon_sql('link')} AS url_key, feed NOT LIKE '%org.xml' AS ga, feed NOT LIKE '%com.xml' AS gr FROM ent),
lst AS (SELECT * FROM (SELECT *, {canon_sql('url')} AS url_key, row_number() OVER (PARTITION BY {canon_sql('url')} ORDER BY page_id DESC) AS rn FROM pr) WHERE rn = 1),
u AS (SELECT url_key, bool_or(ga) AS ga, bool_or(gr) AS gr, min((feed, entry_ord)) AS o, arg_min(title, (feed, entry_ord)) AS title, arg_min(summary, (feed, entry_ord)) AS summary FROM en GROUP BY url_key),
j AS (SELECT u.*, l.url, l.html, l.title AS ptitle, coalesce({DECIDED}, false) AS had, CASE WHEN {DECIDED} AND status IS NULL THEN CASE WHEN decision IN ('captured', 'existing') THEN decision WHEN terms = '{FINGERPRINTS['anglo']}' THEN decision END END AS va,
 {PROCESSED} AS known, {STORED} AS stored, {LANDED} AS landed FROM u JOIN lst l ON l.url_key = u.url_key),
q AS (SELECT *, ga AND va IS NULL AS pa, gr AS prm, ga AND coalesce(va IN ('captured', 'existing'), false) AS cap FROM j),
x AS (SELECT *, NOT known AND (pa OR prm) AND NOT (pa AND {_any('anglo', "(title || ' ; ' || coalesce(summary, ''))")}) AND NOT (prm AND {_any('romance', "(title || ' ; ' || coalesce(summary, ''))")})
  AND ({' OR '.join(hit(t, 'title') for t in PREFILTER_TERMS)}) AS excl FROM q),
nd AS (SELECT *, (pa OR prm) AND NOT known AND NOT excl AS needs FROM x),
tk AS (SELECT *, false AS deferred FROM nd),
rt AS (SELECT *, CASE WHEN NOT (pa OR prm) THEN 'decided' WHEN known AND NOT had THEN 'existing' WHEN excl THEN 'prefiltered' WHEN deferred THEN 'deferred' WHEN needs AND NOT landed THEN 'error' WHEN NOT needs AND NOT stored THEN 'error' ELSE 'check' END AS route,
  ptitle || ' ' || html AS t FROM tk),
ck AS (SELECT *, route = 'check' AND pa AND ({_count('anglo', 't')}) >= 3 AS ok_a, route = 'check' AND prm AND ({_count('romance', 't')}) >= 3 AS ok_r FROM rt),
uc AS (SELECT *, CASE route WHEN 'existing' THEN 'known' WHEN 'deferred' THEN 'deferred' WHEN 'error' THEN 'errors' WHEN 'check' THEN CASE WHEN (ok_a OR ok_r) AND NOT known THEN 'new' WHEN ok_a OR ok_r OR cap THEN 'known' ELSE 'filtered' END
  ELSE CASE WHEN cap THEN 'known' ELSE 'filtered' END END AS cls FROM ck)"""


@query("t1_incremental_pass", f"""{ROUTE_SQL} SELECT en.feed, en.entry_ord, CASE WHEN cls = 'new' AND uc.o <> (en.feed, en.entry_ord) THEN 'known' ELSE cls END AS entry_class FROM en JOIN uc ON uc.url_key = en.url_key""")
def t1(spark, d):
    return outcome(spark, d).classes.select("feed", "entry_ord", "entry_class")


@query("t1_available_now_stream", f"SELECT count(*) AS entries, count(DISTINCT {canon_sql('url')}) AS urls FROM pages")
def t1_stream(spark, d):
    """Landed entries in two file sets through the stream; the ledger then knows every URL."""
    base = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    landing = feed_entries(spark, d).select("provider", "feed", "entry_ord", "link", "title", "summary", "published")
    landing.where("link like 'https%'").write.parquet(f"{base}/landing/a")
    landing.where("link not like 'https%'").write.parquet(f"{base}/landing/b")
    _, pages = prior(spark, d)
    store = SI.SnapshotStore(spark, f"{base}/state")
    SI.ingest(spark, f"{base}/landing/*", store, lambda: pages, setup(max_page_reads=None), f"{base}/checkpoint").awaitTermination()
    return store.table("classes").agg(F.count("*").alias("entries"), F.countDistinct("url_key").alias("urls"))


@query("t2_seen_dedupe", f"SELECT DISTINCT {canon_sql('url')} AS url_key FROM pages WHERE {canon_sql('url')} NOT IN (SELECT {canon_sql('url')} FROM pages WHERE {PROCESSED})")
def t2(spark, d):
    """In-batch duplicates go, and so do URLs of earlier runs: a key stays processed whatever its URL's last sighting was."""
    processed = view(spark, d, "pages", {"url": "url"}).where(PROCESSED).select(urls.project_id(F.col("url"), F.lit("")).alias("project_id")).distinct()
    keyed = entries(spark, d).select(urls.identity_url(F.col("link")).alias("url_key"), urls.project_id(F.col("link"), F.col("title")).alias("project_id"))
    return keyed.dropDuplicates(["url_key"]).join(processed, "project_id", "left_anti").select("url_key")


@query("t2_dedupe_stream", f"SELECT DISTINCT {canon_sql('url')} AS url_key FROM pages")
def t2_stream(spark, d):
    base = f"{shared_dir(spark)}/dedupe-{uuid.uuid4().hex}"
    landed = entries(spark, d)
    landed.write.parquet(f"{base}/landing")
    stream = SI.dedupe_stream(spark.readStream.schema(landed.schema).parquet(f"{base}/landing"), NOW).select("url_key")
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp") \
        .trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("t3_state_expiry", f"""WITH {cte('pr', 'pages', PRIOR)}, lst AS (SELECT * FROM (SELECT *, {canon_sql('url')} AS url_key, row_number() OVER (PARTITION BY {canon_sql('url')} ORDER BY page_id DESC) AS rn FROM pr) WHERE rn = 1)
SELECT url_key FROM lst WHERE {DECIDED} AND page_id % 7 <> 0""")
def t3(spark, d):
    state, _ = prior(spark, d)
    return ledger.expire(state.ledger, NOW).select("url_key")


@query("t4_upsert_dispatch", f"""{ROUTE_SQL}, cp AS (SELECT url_key, known, 'anglo' AS group_id, 0 AS g, ok_r FROM uc WHERE ok_a UNION ALL SELECT url_key, known, 'romance', 1, ok_a FROM uc WHERE ok_r)
SELECT 'url-' || substr(sha256(url_key), 1, 12) AS project_id, group_id, CASE WHEN known AND group_id = 'romance' THEN 'skipped' WHEN known THEN 'merged' WHEN g = 1 AND ok_r THEN 'merged' ELSE 'created' END AS action FROM cp""")
def t4(spark, d):
    return outcome(spark, d).actions.select("project_id", "group_id", "action")


@query("t5_error_retry", f"""{ROUTE_SQL} SELECT uc.url_key, CASE WHEN had THEN NULL ELSE 'error' END AS new_error FROM uc WHERE route = 'error'""")
def t5(spark, d):
    """Failed reads count an error; earlier decisions stay, rows without any become errors."""
    result = outcome(spark, d)
    failed = result.state.ledger.where("errors = 1")
    had = result.routed.select("url_key", "had_decisions")
    return failed.join(had, "url_key").select("url_key", F.when(~F.col("had_decisions"), F.col("status")).alias("new_error"))


@query("t6_rule_replay", f"""WITH {cte('pr', 'pages', PRIOR)}, {FEED_CTE}, lst AS (SELECT * FROM (SELECT *, {canon_sql('url')} AS url_key, row_number() OVER (PARTITION BY {canon_sql('url')} ORDER BY page_id DESC) AS rn FROM pr) WHERE rn = 1)
SELECT url_key, 'NEUBEWERTUNG' AS label FROM lst WHERE {DECIDED} AND status IS NULL AND decision = 'filtered' AND terms = 'old' AND url_key NOT IN (SELECT {canon_sql('link')} FROM f WHERE feed LIKE '%org.xml')""")
def t6(spark, d):
    """Only the .org feed is read; filtered URLs of the others are re-opened when rules changed."""
    state, pages = prior(spark, d)
    seen = feed_entries(spark, d).where("feed like '%org.xml'").drop("page_id")
    result = routing.run(seen, state, pages, setup(max_page_reads=None), replay=True)
    return result.classes.where("label = 'NEUBEWERTUNG'").select("url_key", "label")


@query("t7_late_entries", f"WITH {FEED_CTE} SELECT page_id FROM f WHERE published IS NULL OR published >= TIMESTAMP '2024-01-21 00:00:00'")
def t7(spark, d):
    return feeds.recent(feed_entries(spark, d), NOW, 10).select("page_id")


LATE = "published > (SELECT max(published) FROM f WHERE page_id % 3 = 0) - INTERVAL 7 DAY"


LANDING_ROWS = 20_000


@query("t7_late_stream", f"WITH {FEED_CTE} SELECT page_id FROM f WHERE page_id % 3 < 2 OR published IS NULL OR {LATE}")
def t7_stream(spark, d):
    """Three landings; Spark filters a batch by the watermark that the batch before has worked with, so
    rows of the third are late by the dates of the first.  Undated ones stay."""
    base = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    landed = feed_entries(spark, d)
    # A batch is one landing, so each has the same number of files; with that many rows for one, none stays empty.
    files = 1 + landed.count() // LANDING_ROWS
    for part in range(3):
        landed.where(F.col("page_id") % 3 == part).repartition(files).write.mode("append").parquet(f"{base}/landing/part={part}")
    entries = spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/landing/*")
    SI.drop_late(entries, ["page_id"]).writeStream.format("parquet").option("path", f"{base}/out") \
        .option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("page_id")


FOLD_SQL = f"""WITH RECURSIVE {STATE_EVENT_CTE}, n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts, event_id) AS rn FROM e),
w AS (SELECT project_id, event_id, rn, CAST(NULL AS VARCHAR) AS from_state, to_state, true AS accepted, to_state AS state FROM n WHERE rn = 1
 UNION ALL SELECT n.project_id, n.event_id, n.rn, w.state, n.to_state, n.force OR n.ui_context OR w.state || '>' || n.to_state IN {ARROWS_SQL},
  CASE WHEN n.force OR n.ui_context OR w.state || '>' || n.to_state IN {ARROWS_SQL} THEN n.to_state ELSE w.state END FROM w JOIN n ON n.project_id = w.project_id AND n.rn = w.rn + 1)"""


@query("t8_state_fold", f"{FOLD_SQL} SELECT event_id, from_state, to_state, accepted, state FROM w")
def t8(spark, d):
    return lifecycle.fold_states(state_events(spark, d), "project_id", ["ts", "event_id"]).select("event_id", "from_state", "to_state", "accepted", "state")


@query("t8_state_stream", f"{FOLD_SQL} SELECT event_id, from_state, to_state, accepted, state FROM w")
def t8_stream(spark, d):
    base = f"{shared_dir(spark)}/states-{uuid.uuid4().hex}"
    columns = [f"{e} AS {c}" for c, e in STATE_EVENT.items()]
    raw = table(spark, d, "events").schema
    events = spark.readStream.schema(raw).option("pathGlobFilter", "events.parquet").parquet(d).selectExpr(*columns)
    log = SL.state_log(f"{base}/log", events)
    SL.fold_stream(events, log, f"{base}/out", f"{base}/cp").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", "from_state", "to_state", "accepted", "state")


@query("t8_history_notes", f"""{FOLD_SQL} SELECT w.event_id, CASE WHEN n.force THEN 'Manual override: ' || coalesce(from_state, 'none') || ' → ' || w.to_state WHEN n.ui_context THEN 'UI state change: ' || coalesce(from_state, 'none') || ' → ' || w.to_state END AS note FROM w JOIN n ON n.event_id = w.event_id WHERE accepted""")
def t8_notes(spark, d):
    folded = lifecycle.fold_states(state_events(spark, d), "project_id", ["ts", "event_id"]).where("accepted")
    entry = lifecycle.history_entry(F.col("from_state"), F.col("to_state"), F.lit(None).cast("string"), F.col("force"), F.col("ui_context"))
    return folded.select("event_id", entry["note"].alias("note"))


@query("t9_auto_reject", """SELECT doc_id AS project_id, 'rejected' AS to_state, 'Eignungsbewertung: ' || source AS note FROM documents WHERE doc_id % 5 = 0 AND lang = 'en'""")
def t9(spark, d):
    action = F.when(F.col("doc_id") % 5 == 0, "created").otherwise("merged")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("project_id"), action.alias("action"), F.when(F.col("lang") == "en", F.col("source")).alias("reject_reason"))
    return lifecycle.auto_rejections(rows).drop("force")


@query("t10_evaluation_pass", """SELECT doc_id AS project_id, 'evaluated' AS to_state, 'LLM-Bewertung: best_profile=' || CASE WHEN (doc_id * 7) % 101 > doc_id % 101 THEN 'beta' ELSE 'alpha' END || ' score=' || greatest(doc_id % 101, (doc_id * 7) % 101) AS note FROM documents WHERE doc_id % 9 = 8""")
def t10(spark, d):
    """Landed answers to state events: only valid ones change the state."""
    from .projections import ANSWER
    answers = view(spark, d, "documents", ANSWER).select(
        F.col("doc_id").alias("project_id"), "raw", F.lit(None).cast("string").alias("error"), F.lit(1000).alias("input_tokens"), F.lit(200).alias("output_tokens"))
    return scoring.state_events(evaluation.ingest(answers, ["alpha", "beta"]), NOW).select("project_id", "to_state", "note")
