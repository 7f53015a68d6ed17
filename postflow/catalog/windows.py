"""Window and top-n operators over the tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import markdown as M, urls
from ..operators import admission, counters, evaluation, ledger, lifecycle, pages as PG, similarity
from ..plans import routing
from ..sources import feeds
from .base import FEED_CTE, NOW, STATE_EVENT_CTE, cte, feed_entries, pick, query, s, state_events, table, view
from .filters import ARROWS_SQL
from .joins import VECTORS, profiles
from .projections import BODY_CTE, P38_PAGE, SECTION_ROWS, bodies, canon_sql, id_sql
from .scans import MESSAGE, MESSAGE_CTE, RUNS_SQL, runs


@query("w1_latest_evaluation", f"""WITH {BODY_CTE}, {SECTION_ROWS} SELECT doc_id, strftime(ts, '%Y-%m-%d') AS day, pre, llm FROM (
 SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, i) AS rn FROM sections WHERE ts IS NOT NULL) WHERE rn = 1""")
def w1(spark, d):
    facts = bodies(spark, d).select("doc_id", F.explode(M.evaluation_sections(F.col("body"))).alias("v")).select("doc_id", "v.*")
    return evaluation.latest_by(facts, ["doc_id"], ["ts", "pos"]).select("doc_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "pre", "llm")


@query("w2_last_changes", f"""WITH {STATE_EVENT_CTE} SELECT project_id, event_id, to_state, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, event_id DESC) AS INT) AS rank FROM e) WHERE rank <= 3""")
def w2(spark, d):
    return lifecycle.last_changes(state_events(spark, d), "project_id", ["ts", "event_id"]).select("project_id", "event_id", "to_state", "rank")


@query("w3_undo_state", f"""WITH {STATE_EVENT_CTE}, r AS (SELECT project_id, to_state AS current_state, lag(to_state) OVER w AS previous_state, row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, event_id DESC) AS rn,
 row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY project_id ORDER BY ts, event_id)) SELECT project_id, current_state, previous_state, 'Rückgängig: ' || current_state || ' → ' || previous_state AS note FROM r WHERE rn = 1 AND n > 1""")
def w3(spark, d):
    return lifecycle.undo(state_events(spark, d), "project_id", ["ts", "event_id"])


@query("w4_latest_runs", f"SELECT schedule_id, run_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY schedule_id ORDER BY started_at DESC, run_id DESC) AS INT) AS rank FROM ({RUNS_SQL})) WHERE rank <= 10")
def w4(spark, d):
    return counters.latest_runs(runs(spark, d)).select("schedule_id", "run_id", "rank")


@query("w5_top_shared_terms", f"""WITH {VECTORS}, r AS (SELECT dv.doc_id, pv.profile_id, dv.term, row_number() OVER (PARTITION BY dv.doc_id, pv.profile_id ORDER BY x * w DESC, pos) AS rn FROM dv JOIN pv ON pv.term = dv.term)
SELECT doc_id, profile_id, string_agg(term, ' ' ORDER BY rn) AS top_matches FROM r WHERE rn <= 10 GROUP BY doc_id, profile_id""")
def w5(spark, d):
    parts = similarity.similarities(table(spark, d, "documents"), profiles(spark, d), "doc_id")
    return parts.where("profile_id is not null").select("doc_id", "profile_id", F.array_join("top_matches", " ").alias("top_matches"))


@query("w6_recent_messages", f"WITH {MESSAGE_CTE} SELECT mailbox, message_id FROM (SELECT *, row_number() OVER (PARTITION BY mailbox ORDER BY ts DESC, message_id DESC) AS rn FROM m) WHERE rn <= 20")
def w6(spark, d):
    return feeds.latest_messages(view(spark, d, "conversations", MESSAGE), NOW, 10_000, 20).select("mailbox", "message_id")


@query("w7_first_entries", f"WITH {FEED_CTE} SELECT feed, link FROM (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY entry_ord) AS rn FROM f) WHERE rn <= 25")
def w7(spark, d):
    return feeds.first_entries(feed_entries(spark, d), 25).select("feed", "link")


@query("w8_next_token", "SELECT page_id, 'spät' || (page_id % 5) AS start, 'Mainz' || page_id AS ort FROM pages")
def w8(spark, d):
    stream = PG.text_stream(F.col("html"))
    found = view(spark, d, "pages", P38_PAGE).select("page_id", PG.label_values(stream, ["Start", "Ort"]).alias("v"))
    return found.select("page_id", F.col("v")["Start"].alias("start"), F.col("v")["Ort"].alias("ort"))


@query("w9_work_cap", f"""WITH {FEED_CTE}, u AS (SELECT {canon_sql('link')} AS url_key, min((feed, entry_ord)) AS o FROM f GROUP BY 1)
SELECT url_key, row_number() OVER (ORDER BY o, url_key) > 60 AS deferred FROM u""")
def w9(spark, d):
    rows = feed_entries(spark, d).withColumn("url_key", urls.identity_url(F.col("link"))).groupBy("url_key").agg(
        F.min(F.struct("feed", "entry_ord")).alias("o")).select("url_key", "o.*", F.lit(True).alias("needs_page"))
    return routing.take_pages(rows, 60).select("url_key", "deferred")


@query("w10_budget_admission", """SELECT event_id, CAST(running AS DOUBLE) AS running_usd, running <= 2000 AS admitted FROM (
 SELECT event_id, sum(CAST(value AS DECIMAL(18,6))) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM events)""")
def w10(spark, d):
    log = table(spark, d, "events").select("event_id", "ts", "value", F.to_date("ts").alias("day"))
    return evaluation.admit_log(log, ["day"], ["ts", "event_id"], F.col("value").cast("decimal(18,6)"), 2000) \
        .select("event_id", F.col("running_usd").cast("double").alias("running_usd"), "admitted")


@query("w10_greedy_admission", """WITH RECURSIVE n AS (SELECT event_id, CAST(ts AS DATE) AS day, CAST(value AS DECIMAL(18,6)) AS cost, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT event_id, day, rn, cost <= 500 AS admitted, CAST(CASE WHEN cost <= 500 THEN 500 - cost ELSE 500 END AS DECIMAL(18,6)) AS rest FROM n WHERE rn = 1
 UNION ALL SELECT n.event_id, n.day, n.rn, n.cost <= w.rest, CAST(CASE WHEN n.cost <= w.rest THEN w.rest - n.cost ELSE w.rest END AS DECIMAL(18,6)) FROM w JOIN n ON n.day = w.day AND n.rn = w.rn + 1)
SELECT event_id, admitted FROM w""")
def w10_greedy(spark, d):
    """Each day's calls against its own budget; later ones that still fit are admitted."""
    log = table(spark, d, "events").select("event_id", "ts", "value", F.to_date("ts").alias("day"))
    budgets = log.select("day").distinct().withColumn("budget", F.lit(500))
    return admission.greedy(log, budgets, ["day"], ["ts", "event_id"], F.col("value")).select("event_id", "admitted")


@query("w10_run_admission", """WITH c AS (SELECT event_id, CAST(value AS DECIMAL(18,6)) AS cost FROM events WHERE value <= 20), t AS (SELECT * FROM c ORDER BY event_id LIMIT 50),
 r AS (SELECT event_id, sum(cost) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS running FROM t)
SELECT CASE WHEN e.value > 20 THEN 'cost per call' WHEN r.event_id IS NULL OR running > 100 THEN 'run, day or month limit' ELSE 'admitted' END AS outcome, count(*) AS n FROM events e LEFT JOIN r ON r.event_id = e.event_id GROUP BY 1""")
def w10_run(spark, d):
    """One run over all events as candidates: per-call, per-run and budget limits."""
    asked = table(spark, d, "events").select("event_id", F.col("value").cast("decimal(18,6)").alias("est_cost"))
    empty = spark.createDataFrame([], "timestamp string, cost_usd decimal(18,6)")
    limits = evaluation.Limits(max_cost_per_call=20.0, daily_budget=100.0, monthly_budget=1000.0, max_calls_per_run=50)
    return evaluation.admit(asked, empty, dt.date(2024, 1, 29), ["event_id"], limits) \
        .groupBy(F.coalesce("budget_reason", F.lit("admitted")).alias("outcome")).agg(F.count("*").alias("n"))


@query("w11_ledger_touch", f"""WITH {FEED_CTE}, o AS (SELECT *, {canon_sql('link')} AS url_key FROM f)
SELECT url_key, arg_min(link, (feed, entry_ord)) AS url, arg_max(title, (feed, entry_ord)) AS title, arg_max(length(substr(coalesce(summary, ''), 1, 600)), (feed, entry_ord)) AS n FROM o GROUP BY url_key""")
def w11(spark, d):
    entries = feed_entries(spark, d).withColumn("url_key", urls.identity_url(F.col("link")))
    return ledger.sightings(entries, NOW).select("url_key", "url", "title", F.length("summary").cast("bigint").alias("n"))


@query("w12_state_timeline", f"""WITH {STATE_EVENT_CTE}, pr AS (SELECT event_id, project_id, to_state, lag(to_state) OVER (PARTITION BY project_id ORDER BY ts, event_id) AS from_state FROM e)
SELECT event_id, from_state, to_state, from_state IS NULL OR from_state || '>' || to_state IN {ARROWS_SQL} AS valid FROM pr""")
def w12(spark, d):
    return lifecycle.check_timeline(state_events(spark, d), "project_id", ["ts", "event_id"]).select("event_id", "from_state", "to_state", "valid")


SIGHTING = {"project_id": s("user_id"), "url": "'u' || " + s("event_id % 40"), "provider": "event_type", "discovered_at": "CAST(ts AS STRING)", "channel": pick("event_id", 2, ["'rss'", "'email'"]), "event_id": "event_id"}


@query("w13_keep_first_sources", f"""WITH {cte('g', 'events', SIGHTING)} SELECT project_id, url, provider, channel FROM (SELECT *, row_number() OVER (PARTITION BY project_id, url ORDER BY discovered_at, provider, channel) AS rn FROM g) WHERE rn = 1""")
def w13(spark, d):
    return ledger.first_sources(view(spark, d, "events", SIGHTING)).select("project_id", "url", "provider", "channel")
