"""Sources and sinks over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import terms, urls
from ..operators import ledger, migration
from ..session import shared_dir
from ..sources import feeds, frontmatter as FM, inventory, logs, profiles
from . import literals as V
from .base import FEED_CTE, NL, NOW, cte, feed_entries, pick, query, s, table, view
from .projections import TOKEN_RE, fold_sql

# Annotated documents of both schema versions, with the odd broken or missing header.
DOCUMENT = {
    "path": s("doc_id"),
    "content": "CASE WHEN doc_id % 11 = 10 THEN text WHEN doc_id % 11 = 9 THEN '---' || " + NL + " || 'title: open header' || " + NL + " || text ELSE '---' || " + NL
    + " || 'title: ''It''''s: ' || source || ''''" + " || " + NL + " || CASE WHEN doc_id % 2 = 0 THEN 'schema_version: 2' || " + NL + " || 'project_id: url-' || " + s("doc_id")
    + " || " + NL + " ELSE '' END || 'provider: gulp' || " + NL + " || 'provider_url: https://X.example.com/p/' || " + s("doc_id") + " || '/?a=1' || " + NL
    + " || CASE WHEN doc_id % 3 = 0 THEN 'state: rejected' || " + NL + " ELSE '' END || 'created_at: ''2024-01-02T03:04:05''' || " + NL
    + " || 'llm_score: ' || " + s("doc_id % 100") + " || " + NL + " || CASE doc_id % 4 WHEN 0 THEN 'search_groups:' || " + NL + " || '- a' || " + NL + " || '- ' || lang || " + NL
    + " WHEN 1 THEN 'search_groups: ' || lang || " + NL + " WHEN 2 THEN 'search_groups: []' || " + NL + " ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN 'sources:' || " + NL
    + " || '- provider: p1' || " + NL + " || '  url: u1' || " + NL + " || '- provider: p2' || " + NL + " || '  url: u2' || " + NL + " ELSE '' END || 'note: kept' || "
    + NL + " || '---' || " + NL + " || text END",
}


def documents(spark, d):
    return view(spark, d, "documents", DOCUMENT)


@query("s1_front_matter", """SELECT CAST(doc_id AS VARCHAR) AS path,
 CASE WHEN doc_id % 11 >= 9 THEN 0 ELSE 6 + CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 4 < 3 THEN 1 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END END AS n_keys,
 CASE WHEN doc_id % 11 < 9 THEN 'kept' END AS note, sha256(CASE WHEN doc_id % 11 = 9 THEN '---' || chr(10) || 'title: open header' || chr(10) || text ELSE text END) AS body FROM documents""")
def s1(spark, d):
    df = FM.parse(documents(spark, d))
    return df.select("path", F.size("header").alias("n_keys"), FM.scalar(F.col("header")["note"]).alias("note"),
                     F.sha2("body", 256).alias("body"))


RECORD_SQL = """SELECT CAST(doc_id AS VARCHAR) AS path, 'It''s: ' || source AS title, CASE WHEN doc_id % 3 = 0 THEN 'rejected' ELSE 'scraped' END AS state,
 CASE WHEN doc_id % 2 = 0 THEN 'url-' || doc_id ELSE 'url-' || substr(sha256('https://x.example.com/p/' || doc_id), 1, 12) END AS project_id,
 CASE doc_id % 4 WHEN 0 THEN 'a,' || lang WHEN 1 THEN lang ELSE '' END AS search_groups, CAST(doc_id % 100 AS INT) AS llm_score,
 CASE WHEN doc_id % 5 = 0 THEN 'u1,u2' ELSE 'https://X.example.com/p/' || doc_id || '/?a=1' END AS source_urls, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS source_version
 FROM documents WHERE doc_id % 11 < 9"""


@query("s2_typed_records", RECORD_SQL)
def s2(spark, d):
    df = FM.to_records(FM.parse(documents(spark, d)).where("size(header) > 0"))
    return df.select("path", "title", "state", "project_id", F.array_join("search_groups", ",").alias("search_groups"), "llm_score",
                     F.array_join(F.transform("sources", lambda x: x["url"]), ",").alias("source_urls"), "source_version")


@query("s3_schema_upgrade", f"SELECT state, count(*) AS n, CAST(sum(CASE WHEN source_version = 1 THEN 1 ELSE 0 END) AS BIGINT) AS upgraded FROM ({RECORD_SQL}) GROUP BY state")
def s3(spark, d):
    with_header = documents(spark, d).where(FM.has_header(F.col("content")))
    target = f"{shared_dir(spark)}/upgraded-{uuid.uuid4().hex}"
    migration.upgrade(with_header, target, dry_run=False)
    return spark.read.parquet(target).groupBy("state").agg(
        F.count("*").alias("n"), F.count_if(F.col("source_version") == 1).alias("upgraded"))


@query("s4_front_matter_sink", RECORD_SQL.replace("CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS source_version", "2 AS source_version"))
def s4(spark, d):
    """Records written as text and read back: nothing is lost, and the rows are v2."""
    records = FM.to_records(FM.parse(documents(spark, d)).where("size(header) > 0"))
    written = FM.to_front_matter(records).select("path", "content")
    back = FM.to_records(FM.parse(written))
    return back.select("path", "title", "state", "project_id", F.array_join("search_groups", ",").alias("search_groups"), "llm_score",
                       F.array_join(F.transform("sources", lambda x: x["url"]), ",").alias("source_urls"), "source_version")


LINE = {"event_id": "event_id", "line": f"CASE WHEN event_id % 7 = 3 THEN '{{\"type\": \"act' WHEN event_id % 7 = 5 THEN '  ' ELSE '{{\"type\": \"' || event_type || '\", \"k\": ' || {s('user_id')} || '}}' END"}


@query("s5_jsonl_scan", "SELECT event_id, event_type AS type, user_id AS k FROM events WHERE event_id % 7 NOT IN (3, 5)")
def s5(spark, d):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("type", T.StringType()), T.StructField("k", T.LongType())])
    return logs.parse_lines(view(spark, d, "events", LINE), "line", schema)


REJECTION = {"search_group_id": pick("page_id", 2, ["'a'", "'b'"]), "provider_url": "CASE WHEN page_id % 10 = 0 THEN '' ELSE url END", "title": s("page_id")}


@query("s6_rejection_log", """SELECT CASE WHEN page_id % 2 = 0 THEN 'a' ELSE 'b' END AS search_group_id, CASE WHEN page_id % 10 = 0 THEN '' ELSE url END AS provider_url, count(*) AS n
 FROM (SELECT page_id, url FROM pages WHERE page_id % 10 <> 0 AND url NOT LIKE '%utm_source%' UNION ALL SELECT page_id, url FROM pages WHERE page_id % 10 = 0 UNION ALL SELECT page_id, url FROM pages WHERE page_id % 10 = 0) GROUP BY 1, 2""")
def s6(spark, d):
    """Every rejection is reported twice; pages seen through a tagged link are logged already."""
    new = view(spark, d, "pages", REJECTION)
    logged = view(spark, d, "pages", REJECTION).where("provider_url like '%utm_source%'")
    fresh = logs.new_rejections(new.unionByName(new), logged)
    return fresh.groupBy("search_group_id", "provider_url").agg(F.count("*").alias("n"))


KEY_FILE = {"value": "CASE page_id % 3 WHEN 0 THEN '[\"gulp:' || url || '\"]' WHEN 1 THEN '{\"url_keys\": [\"gulp:' || url || '\"], \"project_ids\": [\"url-' || " + s("page_id") + " || '\"]}' ELSE '{\"url_keys\": [' END"}


@query("s7_key_sets", """SELECT 'url' AS kind, 'gulp:' || url AS k FROM pages WHERE page_id % 3 < 2 UNION SELECT 'id', 'url-' || page_id FROM pages WHERE page_id % 3 = 1""")
def s7(spark, d):
    keys, ids = logs.key_sets(view(spark, d, "pages", KEY_FILE))
    return keys.select(F.lit("url").alias("kind"), F.col("url_key").alias("k")).unionByName(
        ids.select(F.lit("id").alias("kind"), F.col("project_id").alias("k")))


LEDGER_FILE = {"value": "CASE WHEN page_id % 9 = 0 THEN '{\"entries\": ' ELSE '{\"version\": 1, \"entries\": {\"' || url || '\": {\"url\": \"' || url || '\", \"title\": \"t\", \"first_seen\": \"2024-01-02T03:04:05\", \"last_seen\": \"2024-01-2' || "
               + s("page_id % 10") + " || 'T00:00:00\", \"status\": \"filtered\", \"errors\": ' || " + s("page_id % 4") + " || ', \"groups\": {\"a\": {\"decision\": \"filtered\", \"terms\": \"x\"}, \"b\": {\"decision\": \"captured\", \"terms\": \"y\"}}}}}' END"}


@query("s8_ledger_scan", """SELECT url AS url_key, '2024-01-2' || (page_id % 10) || ' 00:00:00' AS last_seen, 'filtered' AS status, CAST(page_id % 4 AS INT) AS errors, unnest(['a', 'b']) AS group_id, unnest(['filtered', 'captured']) AS decision
 FROM pages WHERE page_id % 9 <> 0""")
def s8(spark, d):
    entries, decisions = ledger.from_json(view(spark, d, "pages", {"page_id": "page_id"} | LEDGER_FILE))
    return entries.select("page_id", "url_key", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), "status", "errors") \
        .join(decisions.select("page_id", "url_key", "group_id", "decision"), ["page_id", "url_key"]).drop("page_id")


@query("s9_feed_scan", f"""WITH {FEED_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY entry_ord) AS rn FROM f)
SELECT feed, entry_ord, link FROM r WHERE rn <= 60 AND (published IS NULL OR published >= TIMESTAMP '2024-01-24 00:00:00')""")
def s9(spark, d):
    return feeds.scan(feed_entries(spark, d), NOW, 60, 7).select("feed", "entry_ord", "link")


MESSAGE = {"mailbox": pick("conv_id", 3, ["'inbox'", "'alerts'", "'jobs'"]), "message_id": f"{s('conv_id')} || '-' || {s('turn')}",
           "ts": "CAST('2024-01-' || lpad(CAST(1 + (conv_id * 7 + turn) % 30 AS STRING), 2, '0') || ' 12:00:00' AS TIMESTAMP)", "sender": "role || '@mail.example.com'",
           "subject": "text", "text": "text"}
MESSAGE_CTE = cte("m", "conversations", MESSAGE)


@query("s10_message_ingest", f"""WITH {MESSAGE_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY mailbox ORDER BY ts DESC, message_id DESC) AS rn FROM m WHERE CAST(ts AS DATE) >= DATE '2024-01-24')
SELECT mailbox, message_id, sender FROM r WHERE rn <= 50""")
def s10(spark, d):
    return feeds.latest_messages(view(spark, d, "conversations", MESSAGE), NOW).select("mailbox", "message_id", "sender")


@query("s11_page_scan", """SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, count(*) AS pages, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages GROUP BY 1""")
def s11(spark, d):
    return table(spark, d, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(
        F.count("*").alias("pages"), F.sum(F.length("html")).alias("chars"))


PROFILE = {"profile_id": s("item_id"), "profile_ord": "item_id", "text": f"'## Kern' || {NL} || '<!-- x' || {NL} || 'y -->' || text || ' [PLACEHOLDER a]'"}


@query("s12_profile_scan", f"SELECT CAST(item_id AS VARCHAR) AS profile_id, sha256(' Kern' || {NL} || ' ' || text || '  ') AS text FROM benchmark")
def s12(spark, d):
    return view(spark, d, "benchmark", PROFILE).select("profile_id", F.sha2(profiles.clean_profile(F.col("text")), 256).alias("text"))


@query("s13_rule_dimension", f"""WITH t AS (SELECT lang, unnest(list_distinct(regexp_extract_all({fold_sql('lower(text)')}, {TOKEN_RE}))) AS term FROM documents)
SELECT lang AS group_id, term, count(*) AS df, '(?<![{V.WORD}])' || regexp_replace(term, '([^{V.WORD}_])', '\\\\\\1', 'g') || '(?![{V.WORD}])' AS pattern FROM t GROUP BY lang, term""")
def s13(spark, d):
    """A rule table made from the corpus: frequent words per language, compiled in Spark."""
    from ..functions.text import raw_tokens
    words = table(spark, d, "documents").select("lang", F.explode(F.array_distinct(raw_tokens(F.col("text")))).alias("term"))
    return words.groupBy(F.col("lang").alias("group_id"), "term").agg(F.count("*").alias("df"))\
        .withColumn("pattern", terms.term_pattern(F.col("term"), first="start"))


FILES = {"path": "'base/' || " + pick("o_orderkey", 5, ["'projects/p_' || strftime_ymd || '_101500.md'", "'logs/run.log'", "'temp/x.bin'", "'data/a_backup.db'", "'projects/q.md'"]),
         "mtime": "o_orderdate", "length": "o_custkey"}
FILES = {k: v.replace("strftime_ymd", "replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', '')") for k, v in FILES.items()}
FILES["o_orderkey"] = "o_orderkey"
FILES_CTE = cte("fl", "orders", FILES)


@query("s14_file_inventory", f"""WITH {FILES_CTE} SELECT o_orderkey, path, length, CAST(floor(date_diff('second', CASE WHEN regexp_matches(path, '\\d{{8}}_\\d{{6}}') THEN
 strptime(regexp_extract(path, '\\d{{8}}_\\d{{6}}'), '%Y%m%d_%H%M%S') ELSE CAST(mtime AS TIMESTAMP) END, TIMESTAMP '2024-01-31 00:00:00') / 86400.0) AS BIGINT) AS age_days FROM fl""")
def s14(spark, d):
    df = view(spark, d, "orders", FILES)
    return df.select("o_orderkey", "path", "length", F.floor(inventory.age_days(
        F.col("path"), F.col("mtime").cast("timestamp"), NOW)).alias("age_days"))


RUN_FILE = {"value": "'{\"schedules\": [{\"id\": \"s' || " + s("conv_id % 20") + " || '\", \"name\": \"n\", \"execution_history\": [{\"run_id\": \"' || " + s("conv_id") + " || '-' || " + s("turn")
            + " || '\", \"started_at\": \"2024-01-0' || " + s("1 + turn % 9") + " || 'T00:00:' || lpad(" + s("conv_id % 60") + ", 2, '0') || '\", \"completed_at\": \"2024-01-0' || " + s("1 + turn % 9")
            + " || 'T00:05:' || lpad(" + s("length(text) % 60") + ", 2, '0') || '\", \"status\": \"' || CASE WHEN role = 'user' THEN 'failed' ELSE 'success' END || '\", \"step_results\": [{\"success\": true, \"output\": \"one\", \"exit_code\": 0}, {\"success\": '"
            + " || CASE WHEN role = 'user' THEN 'false' ELSE 'true' END || ', \"output\": \"' || CASE WHEN turn % 2 = 0 THEN ' ' ELSE role END || '\", \"exit_code\": ' || " + s("turn % 3") + " || '}]}]}]}'"}
RUNS_SQL = """SELECT 's' || (conv_id % 20) AS schedule_id, conv_id || '-' || turn AS run_id, '2024-01-0' || (1 + turn % 9) || 'T00:00:' || lpad(CAST(conv_id % 60 AS VARCHAR), 2, '0') AS started_at,
 300 + length(text) % 60 - conv_id % 60 AS seconds, CASE WHEN role = 'user' THEN 'failed' ELSE 'success' END AS status, role, turn FROM conversations"""


def runs(spark, d):
    parsed = view(spark, d, "conversations", RUN_FILE).select(F.from_json("value", inventory.RUN_FILE).alias("v")).select("v.*")
    return inventory.explode_runs(parsed)


@query("s15_run_history", f"SELECT schedule_id, run_id, started_at, status, 2 AS steps FROM ({RUNS_SQL})")
def s15(spark, d):
    return runs(spark, d).select("schedule_id", "run_id", "started_at", "status", F.size("step_results").alias("steps"))
