"""Joins over the tables (J1-J13) and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import terms, urls
from ..operators import corpus as C, evaluation, ledger, matching, similarity
from ..sources import config, feeds, logs
from .base import (CORPUS_CTE, FEED_CTE, GROUP_CONFIG, POSTING_CTE, corpus, cte, feed_entries, groups, matched_sql, pick, postings, query, s,
                   table, text, view)
from .projections import STOP_SQL, TOKEN_RE, canon_sql, fold_sql, id_sql

TOPIC = "title || ' ' || description || ' ; ' || schlagworte"


@query("j1_unseen_postings", f"SELECT page_id, {id_sql('url')} AS project_id FROM pages WHERE url NOT LIKE '%utm_source%'")
def j1(spark, d):
    """Pages seen through a tagged link are processed already (under another query string)."""
    pages = table(spark, d, "pages").select("page_id", "url")
    done = pages.where("url like '%utm_source%'").select(urls.project_id(F.concat("url", F.lit("?x=1")), F.lit("")).alias("project_id")).distinct()
    found = pages.select("page_id", urls.project_id(F.col("url"), F.lit("")).alias("project_id"))
    return logs.unseen(found, done, "project_id").select("page_id", "project_id")


def _route_sql() -> str:
    parts = [f"SELECT doc_id, '{g}' AS group_id, {matched_sql(c['filters']['include_terms'], TOPIC)} AS m FROM p" for g, c in GROUP_CONFIG["search_groups"].items()]
    return f"WITH {POSTING_CTE} SELECT doc_id, group_id, len(m) AS n, array_to_string(m, ',') AS matched FROM (" + " UNION ALL ".join(parts) + ")"


@query("j2_term_routing", _route_sql())
def j2(spark, d):
    return matching.match_terms(postings(spark, d), groups()).select(
        "doc_id", "group_id", F.size("matched").cast("bigint").alias("n"), F.array_join("matched", ",").alias("matched"))


@query("j2_rule_table", f"WITH x AS ({_route_sql()}) SELECT doc_id, group_id, unnest(string_split(matched, ',')) AS term FROM x WHERE n > 0")
def j2b(spark, d):
    """The same rules as a table, joined on word beginnings."""
    return matching.match_rule_table(postings(spark, d), config.term_rules(spark, groups()), "doc_id").select("doc_id", "group_id", "term")


# Rules with contexts, with signs that are no Latin letter, with one letter and with an open end.
ODD_RULES = [("odd", {"term": "the", "with": ["para", "wh*"]}), ("odd", {"term": "de", "with": ["mails"]}), ("odd", "||"), ("odd", "é"),
             ("odd", "+1"), ("odd", "a"), ("sign", "@*"), ("sign", {"term": "(7*", "with": ["|", "@*"]})]
ODD_TEXT = {"doc_id": "doc_id", "description": "text || CASE doc_id % 4 WHEN 0 THEN ' || para' WHEN 1 THEN ' (7 é' WHEN 2 THEN ' @x +1' ELSE ' (70) |' END"}


def _odd_hit(term: str) -> str:
    """The term rule written out for DuckDB, whose patterns know no look-around."""
    word, body = "0-9a-zA-ZäöüßÄÖÜ", "".join("\\" + c if c in "+|()@." else c for c in term.rstrip("*"))
    return f"regexp_matches(description, '(?i)(?:^|[^{word}]){body}" + ("')" if term.endswith("*") else f"(?:[^{word}]|$)')")


@query("j2_odd_rules", f"WITH {cte('o', 'documents', ODD_TEXT)} " + " UNION ALL ".join(
    f"SELECT doc_id, '{g}' AS group_id, {text(r if isinstance(r, str) else r['term'])} AS term FROM o WHERE {_odd_hit(r if isinstance(r, str) else r['term'])}"
    + ("" if isinstance(r, str) else " AND (" + " OR ".join(_odd_hit(w) for w in r["with"]) + ")") for g, r in ODD_RULES))
def j2_odd(spark, d):
    """Context terms and terms without a Latin letter in the rule table."""
    compiled = [(g, terms.compile_term(r)) for g, r in ODD_RULES]
    rows = [(g, "include", t.term, [c.term for c in t.context], t.pattern, t.needle, i) for i, (g, t) in enumerate(compiled)]
    docs = view(spark, d, "documents", ODD_TEXT).select("doc_id", F.col("description"), F.lit("").alias("title"), F.lit("").alias("schlagworte"))
    return matching.match_rule_table(docs, spark.createDataFrame(rows, config.TERM_RULE), "doc_id").select("doc_id", "group_id", "term")


def terms_cte(name: str, source: str, key: str, col: str) -> str:
    return f"""{name}_w AS (SELECT {key}, list_filter(regexp_extract_all({fold_sql(f'lower({col})')}, {TOKEN_RE}), lambda t: length(t) >= 2 AND t NOT IN {STOP_SQL}) AS w FROM {source}),
{name}_u AS (SELECT {key}, len(w) AS total, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM {name}_w),
{name} AS (SELECT {key}, term, total, count(*) AS n, min(i) AS pos FROM {name}_u GROUP BY {key}, term, total)"""


VECTORS = f"""prof AS (SELECT CAST(item_id AS VARCHAR) AS profile_id, item_id, text FROM benchmark), {terms_cte('pt', 'prof', 'profile_id', 'text')},
idf AS (SELECT term, ln(((SELECT count(*) FROM prof) + 1) / (count(*) + 1)) + 1 AS idf FROM pt GROUP BY term),
pv AS (SELECT profile_id, pt.term, n / total * idf AS w, idf FROM pt JOIN idf ON idf.term = pt.term),
pn AS (SELECT profile_id, sqrt(sum(w * w)) AS norm FROM pv GROUP BY profile_id),
{terms_cte('dt', 'documents', 'doc_id', 'text')},
dv AS (SELECT doc_id, dt.term, n, total, pos, n / total * coalesce(idf, 1.0) AS x FROM dt LEFT JOIN idf ON idf.term = dt.term),
dn AS (SELECT doc_id, sqrt(sum(x * x)) AS own FROM dv GROUP BY doc_id),
pairs AS (SELECT doc_id, profile_id, sum(x * w) AS dot FROM dv JOIN pv ON pv.term = dv.term GROUP BY doc_id, profile_id),
scores AS (SELECT pairs.doc_id, pairs.profile_id, round_even(dot / (own * norm), 4) AS score FROM pairs JOIN dn ON dn.doc_id = pairs.doc_id JOIN pn ON pn.profile_id = pairs.profile_id)"""


def profiles(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("profile_id"), F.col("item_id").alias("profile_ord"), "text")


@query("j3_similarity_join", f"WITH {VECTORS} SELECT doc_id, profile_id, round(dot, 9) AS dot FROM pairs")
def j3(spark, d):
    parts = similarity.similarities(table(spark, d, "documents"), profiles(spark, d), "doc_id", top_n=0)
    return parts.where("profile_id is not null").select("doc_id", "profile_id", F.round("dot", 9).alias("dot"))


# A ledger over all pages: every page has a decision per group, a ninth had errors.
DECISION = {"page_id": "page_id", "url": "url", "status": pick("page_id", 9, ["'error'"] + ["'filtered'"] * 8),
            "decision": pick("page_id", 4, ["'captured'", "'existing'", "'filtered'", "'filtered'"]), "terms": pick("page_id", 3, ["'r1'", "'r2'", "'r1'"])}
DECISION_CTE = cte("l", "pages", DECISION)


def ledger_tables(spark, d):
    base = view(spark, d, "pages", DECISION).withColumn("url_key", urls.identity_url(F.col("url")))
    base = base.groupBy("url_key").agg(F.max_by(F.struct("page_id", "status", "decision", "terms"), "page_id").alias("v")).select("url_key", "v.*")
    rows = base.select("url_key", "status")
    decisions = base.select("url_key", F.lit("a").alias("group_id"), "decision", "terms")
    return rows, decisions


LEDGER_SQL = f"{DECISION_CTE}, lk AS (SELECT * FROM (SELECT {canon_sql('url')} AS url_key, *, row_number() OVER (PARTITION BY {canon_sql('url')} ORDER BY page_id DESC) AS rn FROM l) WHERE rn = 1)"


@query("j4_ledger_lookup", f"""WITH {LEDGER_SQL}, g AS (SELECT page_id, {canon_sql('url')} AS url_key, unnest(['a', 'b']) AS group_id FROM pages)
SELECT g.page_id, g.group_id, CASE WHEN g.group_id = 'b' OR status = 'error' THEN NULL WHEN decision IN ('captured', 'existing') THEN decision WHEN terms = 'r1' THEN decision END AS decision FROM g LEFT JOIN lk ON lk.url_key = g.url_key""")
def j4(spark, d):
    rows, decisions = ledger_tables(spark, d)
    asked = table(spark, d, "pages").select("page_id", urls.identity_url(F.col("url")).alias("url_key"),
                                            F.explode(F.array(F.lit("a"), F.lit("b"))).alias("group_id"), F.lit("r1").alias("terms"))
    return ledger.lookup(asked, rows, decisions).select("page_id", "group_id", "decision")


@query("j5_shared_feeds", f"""WITH {FEED_CTE} SELECT page_id, CASE WHEN feed LIKE '%net.xml' THEN 'anglo,romance' WHEN feed LIKE '%com.xml' THEN 'anglo' ELSE 'romance' END AS groups FROM f""")
def j5(spark, d):
    shared = config.shared_feeds(config.subscriptions(spark, groups()))
    return feed_entries(spark, d).join(F.broadcast(shared), ["provider", "feed"]).select("page_id", F.array_join("groups", ",").alias("groups"))


@query("j6_unlogged_rejections", "SELECT page_id FROM pages WHERE url NOT LIKE 'https%'")
def j6(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.lit("a").alias("search_group_id"), F.col("url").alias("provider_url"))
    return logs.new_rejections(pages, pages.where("provider_url like 'https%'"), F.col("page_id")).select("page_id")


@query("j7_cache_lookup", """SELECT d.doc_id AS project_id, coalesce(c.hit, false) AS cache_hit, c.doc_id AS result FROM documents d LEFT JOIN (SELECT text, source, max(doc_id) AS doc_id, true AS hit FROM documents WHERE lang = 'en' GROUP BY text, source) c ON c.text = d.text AND c.source = d.source""")
def j7(spark, d):
    docs = table(spark, d, "documents").select("lang", F.col("doc_id").alias("project_id"), F.sha2(F.concat("text", F.lit("|"), "source"), 256).alias("cache_key"))
    cache = docs.where("lang = 'en'").drop("lang").withColumn("result", F.col("project_id")).withColumn("line", F.col("project_id")).withColumn("cache_hit", F.lit(False))
    return evaluation.cache_lookup(docs, cache).select("project_id", "cache_hit", "result")


COST = {"type": "CASE WHEN event_id % 3 = 0 THEN 'reserved' ELSE 'actual' END", "reservation_id": f"CASE WHEN event_id % 3 = 0 THEN 'r' || {s('event_id')} ELSE '' END", "timestamp": "substr(CAST(ts AS STRING), 1, 19)",
        "project_id": s("user_id"), "cost_usd": "CAST(value AS DECIMAL(18,6))", "cache_hit": "event_id % 5 = 0", "event_id": "event_id", "ts": "ts"}
COST_CTE = cte("k", "events", COST)


def cost_log(spark, d):
    return view(spark, d, "events", COST)


@query("j8_settlement", f"""WITH {COST_CTE}, a AS (SELECT 'r' || (event_id * 3) AS reservation_id, value FROM events WHERE event_type IN ('click', 'purchase'))
SELECT type, CAST(count(*) AS BIGINT) AS n, CAST(sum(cost_usd) AS DOUBLE) AS usd FROM (SELECT type, cost_usd FROM k WHERE NOT (type = 'reserved' AND reservation_id IN (SELECT reservation_id FROM a)) UNION ALL SELECT 'actual', CAST(value AS DECIMAL(18,6)) FROM a) GROUP BY type""")
def j8(spark, d):
    """Clicks and purchases settle a reservation; those without a partner are appended."""
    actual = table(spark, d, "events").where("event_type in ('click', 'purchase')").select(
        F.lit("actual").alias("type"), F.concat(F.lit("r"), (F.col("event_id") * 3).cast("string")).alias("reservation_id"), F.col("value").cast("decimal(18,6)").alias("cost_usd"))
    settled = evaluation.settle(cost_log(spark, d).select("type", "reservation_id", "cost_usd"), actual)
    return settled.groupBy("type").agg(F.count("*").alias("n"), F.sum("cost_usd").cast("double").alias("usd"))


@query("j9_locate_posting", f"SELECT p.page_id, min(q.page_id) AS first_page FROM pages p JOIN pages q ON {canon_sql('p.url')} = {canon_sql('q.url')} GROUP BY p.page_id")
def j9(spark, d):
    ids = table(spark, d, "pages").select("page_id", urls.project_id(F.col("url"), F.lit("")).alias("project_id"))
    first = ids.groupBy("project_id").agg(F.min("page_id").alias("first_page"))
    return ids.join(first, "project_id").select("page_id", "first_page")


@query("j10_default_rules", """WITH own AS (SELECT lang, CASE WHEN lang = 'en' THEN ['own'] WHEN lang = 'fr' THEN [] END AS terms FROM (SELECT DISTINCT lang FROM documents))
SELECT doc_id, array_to_string(coalesce(own.terms, ['standard', documents.lang]), ',') AS terms FROM documents JOIN own ON own.lang = documents.lang""")
def j10(spark, d):
    """Null takes the default, an empty list stays empty."""
    langs = ["en", "fr", "de", "es"]
    merged = config.overlay_defaults({"en": {"filters": {"include_terms": ["own"]}}, "fr": {"filters": {"include_terms": []}}, "de": {}, "es": {}},
                                     {g: {"include_terms": ["standard", g]} for g in langs})
    dim = spark.createDataFrame([(g, merged[g]["filters"]["include_terms"]) for g in langs], "lang string, terms array<string>")
    return table(spark, d, "documents").join(F.broadcast(dim), "lang").select("doc_id", F.array_join("terms", ",").alias("terms"))


@query("j11_stale_decisions", f"""WITH {LEDGER_SQL} SELECT url_key FROM lk WHERE status = 'filtered' AND terms <> 'r1' AND url_key NOT IN (SELECT {canon_sql('url')} FROM pages WHERE url LIKE '%.html%')""")
def j11(spark, d):
    rows, decisions = ledger_tables(spark, d)
    current = spark.createDataFrame([("a", "r1")], "group_id string, terms string")
    in_feed = table(spark, d, "pages").where("url like '%.html%'").select(urls.identity_url(F.col("url")).alias("url_key")).distinct()
    return ledger.stale(rows, decisions, current, in_feed).select("url_key")


@query("j12_score_lookup", "SELECT d.doc_id, coalesce(l.quality, 0) AS score FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def j12(spark, d):
    scores = table(spark, d, "labels").select("doc_id", F.col("quality").alias("score"))
    return C.with_score(table(spark, d, "documents").select("doc_id"), scores, "doc_id")


CATEGORY_TERMS = {("anglo", "high"): ["anat", "thha*", "onre"], ("anglo", "medium"): ["ing the", "that of"], ("anglo", "low_priority"): ["ndble"],
                  ("romance", "high"): ["que", "des"], ("romance", "medium"): ["para"]}


@query("j13_category_terms", f"WITH {POSTING_CTE} SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, '{g}' AS group_id, '{c}' AS category, len({matched_sql(t, TOPIC)}) AS hits FROM p" for (g, c), t in CATEGORY_TERMS.items()) + ") WHERE hits > 0")
def j13(spark, d):
    """Posting x group x category by the rule-table join."""
    rows = [(f"{g}/{c}", c, t.term, [], t.pattern, t.needle, i) for (g, c), ts in CATEGORY_TERMS.items() for i, t in enumerate(terms.compile_terms(ts))]
    found = matching.match_rule_table(postings(spark, d), spark.createDataFrame(rows, config.TERM_RULE), "doc_id")
    return found.groupBy("doc_id", F.substring_index("group_id", "/", 1).alias("group_id"), F.substring_index("group_id", "/", -1).alias("category")) \
        .agg(F.countDistinct("term").alias("hits"))


# --- Set operations ---------------------------------------------------------------------

@query("u1_channel_union", """SELECT 'rss' AS channel, count(*) AS n FROM pages UNION ALL SELECT 'email', count(*) FROM conversations""")
def u1(spark, d):
    rss = table(spark, d, "pages").agg(F.count("*").alias("n")).select(F.lit("rss").alias("channel"), "n")
    mail_ = table(spark, d, "conversations").agg(F.count("*").alias("n")).select(F.lit("email").alias("channel"), "n")
    return rss.unionByName(mail_)


@query("u2_feed_union", f"""WITH {FEED_CTE} SELECT feed, link, title, summary FROM f WHERE link LIKE 'https%' UNION ALL SELECT feed, link, title, NULL FROM f WHERE link NOT LIKE 'https%'""")
def u2(spark, d):
    entries = feed_entries(spark, d).select("feed", "link", "title", "summary")
    return feeds.union_feeds(entries.where("link like 'https%'"), entries.where("link not like 'https%'").drop("summary"))


@query("u3_distinct_urls", f"SELECT DISTINCT {canon_sql('url')} AS url_key FROM pages")
def u3(spark, d):
    return table(spark, d, "pages").select(urls.identity_url(F.col("url")).alias("url_key")).distinct()


@query("u4_group_intersection", f"WITH {CORPUS_CTE} SELECT id FROM c WHERE list_has_any(string_split(search_groups, ','), ['fr', 'src1', 'src2'])")
def u4(spark, d):
    return corpus(spark, d).where(C.in_groups(F.col("search_groups"), ["fr", "src1", "src2"])).select("id")


@query("u5_key_difference", f"SELECT {canon_sql('url')} AS url_key FROM pages EXCEPT SELECT {canon_sql('url')} FROM pages WHERE url LIKE '%.com/%'")
def u5(spark, d):
    keys = table(spark, d, "pages").select("url", urls.identity_url(F.col("url")).alias("url_key"))
    return logs.unseen(keys.select("url_key").distinct(), keys.where("url like '%.com/%'").select("url_key"), "url_key")


@query("u6_key_union", f"SELECT {canon_sql('url')} AS url_key FROM pages WHERE url LIKE '%.com/%' UNION SELECT {canon_sql('url')} FROM pages WHERE url NOT LIKE '%.org/%'")
def u6(spark, d):
    keys = table(spark, d, "pages").select("url", urls.identity_url(F.col("url")).alias("url_key"))
    return logs.add_keys(keys.where("url like '%.com/%'").select("url_key"), keys.where("url not like '%.org/%'").select("url_key"))
