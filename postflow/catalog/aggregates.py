"""Aggregations (A1-A23) and sorts (O1-O8) over the tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import responses as R, terms, urls
from ..operators import (corpus as C, counters, evaluation, ledger, lifecycle, matching, migration, pages as PG, retention, similarity,
                         suitability)
from ..sources import frontmatter as FM, inventory
from . import literals as V
from .base import (CORPUS_CTE, FEED_CTE, GROUP_CONFIG, NL, NOW, POSTING_CTE, STATE_EVENT_CTE, corpus, cte, feed_entries, groups, hit, matched_sql,
                   postings, query, s, state_events, table, text, view)
from .filters import F12_SQL, FILTER, FILTER_SQL, PURGE_CTE, TAGS, purge_candidates
from .joins import COST_CTE, DECISION_CTE, LEDGER_SQL, TOPIC, VECTORS, _route_sql, cost_log, ledger_tables, profiles
from .projections import canon_sql, id_sql
from .scans import RUNS_SQL, documents, runs

STATES_SQL = "[" + ", ".join(text(x) for x in lifecycle.STATES) + "]"


@query("a1_state_summary", f"WITH {CORPUS_CTE}, dom AS (SELECT unnest({STATES_SQL}) AS state) SELECT state, count(id) AS n FROM dom LEFT JOIN c ON c.status = dom.state GROUP BY state")
def a1(spark, d):
    return lifecycle.state_summary(corpus(spark, d).select(F.col("status").alias("state")))


@query("a2_state_report", f"""WITH {CORPUS_CTE}, n AS (SELECT status AS state, count(*) AS n FROM c WHERE list_contains({STATES_SQL}, status) GROUP BY status)
SELECT state, n, round(n * 100.0 / sum(n) OVER (), 6) AS share FROM n""")
def a2(spark, d):
    return lifecycle.state_report(corpus(spark, d).select(F.col("status").alias("state"))).withColumn("share", F.round(F.col("share").cast("double"), 6))


@query("a2_order_shares", "SELECT o_orderstatus, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY o_orderstatus")
def a2_orders(spark, d):
    from pyspark.sql import Window
    counts = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6).cast("double"))  # one row per status


@query("a3_dashboard_counters", f"""WITH {CORPUS_CTE} SELECT count(*) AS total_projects, count(*) FILTER (evaluation_status = 'ok') AS llm_evaluated, count(*) FILTER (evaluation_status = 'pending_retry') AS llm_pending,
 count(*) FILTER (evaluation_status IN ('failed', 'unsafe_content')) AS llm_failed, count(*) FILTER (llm_priority = 'high_priority') AS llm_high_priority FROM c""")
def a3(spark, d):
    return C.dashboard_counters(corpus(spark, d))


@query("a3_status_counts", f"WITH {CORPUS_CTE} SELECT status, count(*) AS n FROM c GROUP BY status")
def a3_status(spark, d):
    return C.by_status(corpus(spark, d))


@query("a4_cost_statistics", f"""WITH {COST_CTE} SELECT CAST(sum(cost_usd) FILTER (starts_with(timestamp, '2024-01-29')) AS DOUBLE) AS cost_today_usd, CAST(sum(cost_usd) FILTER (starts_with(timestamp, '2024-01')) AS DOUBLE) AS cost_month_usd,
 count(*) AS calls_total, count(*) FILTER (starts_with(timestamp, '2024-01-29')) AS calls_today, count(*) FILTER (cache_hit) AS cache_hits, max(timestamp) AS last_updated FROM k WHERE type = 'actual'""")
def a4(spark, d):
    df = evaluation.cost_statistics(cost_log(spark, d), dt.date(2024, 1, 29))
    return df.withColumns({c: F.col(c).cast("double") for c in ("cost_today_usd", "cost_month_usd")})


@query("a5_budget_consumption", f"""WITH {COST_CTE} SELECT CAST(sum(cost_usd) FILTER (starts_with(timestamp, '2024-01-29')) AS DOUBLE) AS daily_usd, CAST(sum(cost_usd) FILTER (starts_with(timestamp, '2024-01')) AS DOUBLE) AS monthly_usd FROM k""")
def a5(spark, d):
    df = evaluation.spent(cost_log(spark, d), dt.date(2024, 1, 29))
    return df.select(*[F.col(c).cast("double").alias(c) for c in df.columns])


_OUTCOMES = f"""o AS (SELECT page_id, feed, unnest(CASE WHEN feed LIKE '%net.xml' THEN ['anglo', 'romance'] WHEN feed LIKE '%com.xml' THEN ['anglo'] ELSE ['romance'] END) AS group_id,
 CASE WHEN page_id % 2 = 0 THEN 'gulp' ELSE 'freelancermap' END AS provider, CASE page_id % 5 WHEN 0 THEN 'created' WHEN 1 THEN 'merged' WHEN 2 THEN 'filtered' WHEN 3 THEN 'errors' ELSE 'deferred' END AS outcome FROM f)"""


_CLASSES = ["new", "known", "filtered", "deferred", "errors"]


@query("a6_feed_counters", f"""WITH {FEED_CTE}, c AS (SELECT feed, CASE page_id % 5 {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CLASSES))} END AS k FROM f)
SELECT feed AS label, count(*) AS entries, {', '.join(f"count(*) FILTER (k = '{c}') AS {c}" for c in _CLASSES)} FROM c GROUP BY feed""")
def a6_feeds(spark, d):
    names = F.array(*[F.lit(c) for c in _CLASSES])
    rows = feed_entries(spark, d).select(F.col("feed").alias("label"), F.get(names, (F.col("page_id") % 5).cast("int")).alias("entry_class"))
    return counters.feed_counters(rows)


@query("a6_ingestion_counters", f"""WITH {FEED_CTE}, {_OUTCOMES} SELECT CASE WHEN grouping(group_id) = 1 THEN 'total' WHEN grouping(provider) = 1 THEN 'group' ELSE 'group_provider' END AS level, group_id, provider, count(*) AS entries_found,
 count(*) FILTER (outcome = 'created') AS projects_saved, count(*) FILTER (outcome = 'merged') AS urls_skipped_dedupe, count(*) FILTER (outcome = 'filtered') AS projects_filtered,
 count(*) FILTER (outcome = 'created' AND page_id % 3 = 0) AS projects_unsuitable, count(*) FILTER (outcome = 'errors') AS errors, count(*) FILTER (outcome = 'deferred') AS deferred
 FROM o GROUP BY GROUPING SETS ((group_id, provider), (group_id), ())""")
def a6(spark, d):
    from ..sources import config
    shared = config.shared_feeds(config.subscriptions(spark, groups()))
    rows = feed_entries(spark, d).join(F.broadcast(shared), ["provider", "feed"]).select(
        "page_id", F.explode("groups").alias("group_id"), F.when(F.col("page_id") % 2 == 0, "gulp").otherwise("freelancermap").alias("provider"))
    names = F.array(*[F.lit(v) for v in ("created", "merged", "filtered", "errors", "deferred")])
    rows = rows.withColumn("outcome", F.get(names, (F.col("page_id") % 5).cast("int"))).withColumn(
        "unsuitable", (F.col("outcome") == "created") & (F.col("page_id") % 3 == 0))
    return counters.group_counters(rows)


@query("a7_document_frequency", f"WITH {VECTORS} SELECT term, count(*) AS df, round(ln(((SELECT count(*) FROM prof) + 1) / (count(*) + 1)) + 1, 9) AS idf FROM pt GROUP BY term")
def a7(spark, d):
    return similarity.document_frequency(similarity.with_terms(profiles(spark, d), ["profile_id"])).withColumn("idf", F.round("idf", 9))


@query("a8_term_vectors", f"WITH {VECTORS} SELECT profile_id, pv.term, round(w, 9) AS weight FROM pv")
def a8(spark, d):
    return similarity.profile_vectors(profiles(spark, d)).select("profile_id", "term", F.round("weight", 9).alias("weight"))


@query("a9_cosine_similarity", f"WITH {VECTORS} SELECT * FROM scores")
def a9(spark, d):
    return similarity.scores(table(spark, d, "documents"), profiles(spark, d), "doc_id", top_n=0) \
        .where("profile_id is not null").select("doc_id", "profile_id", "score")


CATS = {"high": (["anat", "thha*", "onre"], 15, 25), "medium": (["ing the", "that of"], 8, 24), "low_priority": (["ndble", "for", "the of"], -15, -20)}


def _points_sql(c: str) -> str:
    t, w, cap = CATS[c]
    return f"{'greatest' if cap < 0 else 'least'}(len({matched_sql(t, 'text')}) * ({w}), {cap})"


@query("a10_capped_points", "SELECT doc_id, " + ", ".join(f"CAST({_points_sql(c)} AS INT) AS {c}" for c in CATS) + " FROM documents")
def a10(spark, d):
    df = table(spark, d, "documents").withColumn("low", terms.search_form(F.col("text")))
    return df.select("doc_id", *[suitability.capped_points(
        F.size(terms.matched(terms.compile_terms(t), F.col("low"))), w, cap).alias(c) for c, (t, w, cap) in CATS.items()])


@query("a11_best_profile", f"""WITH {VECTORS}, r AS (SELECT doc_id, profile_id, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, CAST(profile_id AS BIGINT)) AS rn FROM scores)
SELECT d.doc_id, CASE WHEN score > 0 THEN profile_id END AS best_profile, CASE WHEN score > 0 THEN score ELSE 0.0 END AS best_score FROM documents d LEFT JOIN (SELECT * FROM r WHERE rn = 1) r ON r.doc_id = d.doc_id""")
def a11(spark, d):
    return similarity.best_profiles(table(spark, d, "documents"), profiles(spark, d), "doc_id", top_n=0).drop("top_matches")


@query("a12_id_collisions", f"SELECT {id_sql('url')} AS project_id, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1")
def a12(spark, d):
    rows = table(spark, d, "pages").select(F.col("page_id").alias("path"), urls.project_id(F.col("url"), F.lit("")).alias("project_id"))
    return migration.collisions(rows).select("project_id", "n")


@query("a13_ledger_status", f"""SELECT {canon_sql('url')} AS url_key, CASE max(CASE page_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END) WHEN 3 THEN 'captured' WHEN 2 THEN 'existing' ELSE 'filtered' END AS status FROM pages GROUP BY 1""")
def a13(spark, d):
    names = F.array(*[F.lit(v) for v in ("captured", "existing", "filtered", "filtered")])
    return ledger.status_of(table(spark, d, "pages").select(urls.identity_url(F.col("url")).alias("url_key"), F.get(names, (F.col("page_id") % 4).cast("int")).alias("decision")))


@query("a14_pass_statistics", f"""WITH {CORPUS_CTE}, r AS (SELECT *, id % 7 < 3 AS b FROM c) SELECT count(*) AS projects_found, count(*) FILTER (evaluation_status = 'ok') AS projects_ok, count(*) FILTER (evaluation_status = 'pending_retry' AND NOT b) AS projects_pending_retry,
 count(*) FILTER (evaluation_status = 'pending_retry' AND b) AS projects_skipped_budget, count(*) FILTER (evaluation_status = 'unsafe_content') AS projects_skipped_unsafe, count(*) FILTER (evaluation_status = 'failed') AS projects_failed,
 CAST(sum(CAST(fit_score AS DECIMAL(18,6))) FILTER (evaluation_status = 'ok') AS DOUBLE) AS total_cost_usd FROM r""")
def a14(spark, d):
    rows = corpus(spark, d).withColumn("error_detail", F.when(F.col("id") % 7 < 3, "Budget-Limit: x").otherwise("timeout")).withColumn("cost_usd", F.col("fit_score").cast("decimal(18,6)"))
    return evaluation.pass_statistics(rows).withColumn("total_cost_usd", F.col("total_cost_usd").cast("double"))


@query("a15_version_inventory", "SELECT CASE WHEN doc_id % 11 < 9 AND doc_id % 2 = 0 THEN 'v2' ELSE 'v1' END AS version, count(*) AS n FROM documents GROUP BY 1")
def a15(spark, d):
    return migration.version_inventory(FM.parse(documents(spark, d)))


@query("a16_distinct_values", f"WITH {CORPUS_CTE} SELECT DISTINCT company AS value FROM c WHERE company IS NOT NULL UNION SELECT 'manual'")
def a16(spark, d):
    return C.distinct_values(corpus(spark, d), "company", ["manual"])


@query("a17_processed_count", "SELECT count(*) FILTER (page_id % 2 = 0) AS n FROM (SELECT DISTINCT page_id, url FROM pages)")
def a17(spark, d):
    provider = F.when(F.col("page_id") % 2 == 0, "gulp").otherwise("solcom")
    return ledger.processed_count(table(spark, d, "pages").select(urls.provider_key(provider, F.col("url")).alias("url_key")), "gulp")


@query("a18_purge_statistics", f"""WITH {PURGE_CTE}, g AS (SELECT category, count(*) AS found FROM cand GROUP BY category),
o AS (SELECT *, list_position({'[' + ', '.join(text(k) for k in V.RETENTION) + ']'}, category) AS i FROM g)
SELECT category, found, CAST(greatest(0, least(found, 1000 - coalesce(sum(found) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS deleted FROM o""")
def a18(spark, d):
    return retention.purge_statistics(purge_candidates(spark, d))


@query("a19_provider_totals", """SELECT event_type AS provider, CAST(count(*) AS BIGINT) AS entries, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS saved FROM events GROUP BY ROLLUP (event_type)""")
def a19(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("provider"), F.lit(1).alias("entries"), F.floor("value").alias("saved"))
    return counters.provider_totals(rows, ["entries", "saved"])


@query("a20_weighted_tags", f"SELECT doc_id, score FROM ({F12_SQL}) WHERE rejection IS NULL")
def a20(spark, d):
    score, why = matching.keyword_score(F.col("text"), TAGS)
    return table(spark, d, "documents").select("doc_id", score.alias("score"), why.alias("why")).where("why like 'Score%'").drop("why")


@query("a21_run_statistics", f"""SELECT schedule_id, count(*) AS runs, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status = 'failed') AS failed, CAST(sum(seconds) AS BIGINT) AS total_seconds, max(seconds) AS max_seconds,
 arg_max(status, (started_at, run_id)) AS last_status FROM ({RUNS_SQL}) GROUP BY schedule_id""")
def a21(spark, d):
    return counters.run_statistics(runs(spark, d))


@query("a21_run_output", f"""SELECT schedule_id, run_id, 'one' || CASE WHEN turn % 2 = 0 THEN '' ELSE {NL} || '---' || {NL} || role END AS output, CAST(turn % 3 AS INT) AS exit_code, role <> 'user' AS success FROM ({RUNS_SQL})""")
def a21_output(spark, d):
    return counters.run_output(inventory.explode_steps(runs(spark, d)))


@query("a22_competency_bonus", f"""SELECT doc_id, CASE WHEN {hit('that', 'text')} THEN least(10, len({matched_sql(['anat', 'thha*', 'onre'], 'text')}) * 5) ELSE 0 END AS bonus FROM documents""")
def a22(spark, d):
    df = table(spark, d, "documents").withColumn("low", terms.search_form(F.col("text")))
    return df.select("doc_id", suitability.bonus_points(
        {"requires": ["that"], "skills": ["anat", "thha*", "onre"], "points_per_skill": 5, "max_points": 10}, F.col("low")).alias("bonus"))


@query("a23_budget_share", """SELECT user_id, CAST(CASE WHEN user_id % 5 = 0 THEN 0 ELSE least(100, floor(sum(CAST(value AS DECIMAL(18,2))) / (user_id % 5 * 500) * 100 + 0.5)) END AS INT) AS percent FROM events GROUP BY user_id""")
def a23(spark, d):
    spent = table(spark, d, "events").groupBy("user_id").agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("spent"))
    return spent.select("user_id", R.budget_share(F.col("spent"), F.col("user_id") % 5 * 500).alias("percent"))


# --- Sorts, limits, top-k ---------------------------------------------------------------

@query("o1_newest_first", f"WITH {CORPUS_CTE} SELECT id, retrieval_date FROM c")
def o1(spark, d):
    return C.newest_first(corpus(spark, d)).select("id", "retrieval_date")


@query("o2_page", f"WITH m AS ({FILTER_SQL}) SELECT id FROM m ORDER BY coalesce(retrieval_date, '') DESC, id LIMIT 10 OFFSET 10")
def o2(spark, d):
    return C.page(C.newest_first(C.corpus_query(corpus(spark, d), FILTER)), 2, 10).select("id")


@query("o2_page_info", f"WITH m AS ({FILTER_SQL}) SELECT count(*) AS total, 2 AS page, CAST(10 AS BIGINT) AS page_size, 20 < count(*) AS has_next, true AS has_prev FROM m")
def o2_info(spark, d):
    return C.page_info(C.corpus_query(corpus(spark, d), FILTER), 2, 10)


@query("o3_ui_order", f"WITH {CORPUS_CTE} SELECT id, company FROM c ORDER BY lower(coalesce(company, '')) DESC, id")
def o3(spark, d):
    return C.ui_order(corpus(spark, d), "company", ascending=False).select("id", "company")


@query("o4_recent_activity", f"""WITH {STATE_EVENT_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, event_id DESC) AS rn FROM e)
SELECT project_id, event_id, to_state FROM r WHERE rn <= 3 ORDER BY ts DESC, event_id DESC LIMIT 10""")
def o4(spark, d):
    return C.recent_activity(state_events(spark, d), "project_id", ["ts", "event_id"]).select("project_id", "event_id", "to_state")


@query("o5_group_priority", f"SELECT doc_id, arg_min(group_id, CASE group_id WHEN 'anglo' THEN 1 ELSE 2 END) AS group_id FROM ({_route_sql()}) WHERE n > 0 GROUP BY doc_id")
def o5(spark, d):
    """The first group in priority order that a posting matches."""
    order = {g.group_id: i for i, g in enumerate(groups())}
    rank = F.create_map(*[F.lit(v) for item in order.items() for v in item])[F.col("group_id")]
    return matching.match_terms(postings(spark, d), groups()).where("size(matched) > 0") \
        .groupBy("doc_id").agg(F.min_by("group_id", rank).alias("group_id"))


# Behind the real page: a long footer paragraph, a long navigation, and the wanted text in many short paragraphs and nested containers.
BLOCK_PAGE = {"page_id": "page_id", "html": "html || '<div class=\"Top-Nav\"><p>' || repeat('n ', 900) || '</p></div><div class=\"page\"><div class=\"main\">' || repeat('<p>' || url || '</p>', 9) "
              "|| '</div><div>Schluss ' || CAST(page_id AS STRING) || '</div></div><footer><p>' || repeat('f ', 900) || '</p></footer><div>' || repeat('lang ', 2100) || '</div>'"}


@query("o7_longest_block", "SELECT page_id, sha256(substr(repeat(url || chr(10), 9) || 'Schluss ' || page_id, 1, 2500)) AS block FROM pages")
def o7(spark, d):
    return view(spark, d, "pages", BLOCK_PAGE).select("page_id", F.sha2(PG.longest_block(F.col("html")), 256).alias("block"))


@query("o8_deletion_cap", f"""WITH {PURGE_CTE} SELECT o_orderkey, category FROM cand ORDER BY list_position({'[' + ', '.join(text(k) for k in V.RETENTION) + ']'}, category), path, o_orderkey LIMIT 1000""")
def o8(spark, d):
    return retention.purge_set(purge_candidates(spark, d), tie="o_orderkey").select("o_orderkey", "category")
