"""Scalar functions over the tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import dates, mail, markdown as M, pii, postings as P, responses as R, terms, text as X, urls
from ..operators import evaluation, pages as PG
from . import literals as V
from .base import (CORPUS_CTE, FEED_CTE, NL, NOW, POSTING_CTE, TODAY, corpus, cte, feed_entries, pick,
                   postings, query, s, table, text, view)

URL_PARTS = "'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)'"


def canon_sql(u: str) -> str:
    return (f"lower(regexp_extract({u}, {URL_PARTS}, 1)) || '://' || lower(regexp_extract({u}, {URL_PARTS}, 2)) "
            f"|| regexp_replace(regexp_extract({u}, {URL_PARTS}, 3), '/+$', '')")


def id_sql(u: str) -> str:
    return f"'url-' || substr(sha256({canon_sql(u)}), 1, 12)"


@query("p1_identity_url", f"SELECT page_id, {canon_sql('url')} AS url_key FROM pages")
def p1(spark, d):
    return table(spark, d, "pages").select("page_id", urls.identity_url(F.col("url")).alias("url_key"))


P2_VIEW = {"page_id": "page_id", "url": "CASE WHEN page_id % 3 = 0 THEN '  ' WHEN page_id % 3 = 1 THEN url ELSE NULL END",
           "title": "CASE WHEN page_id % 9 = 0 THEN NULL ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END",
           "raw": "url"}


@query("p2_stable_id", f"""WITH {cte('v', 'pages', P2_VIEW)}
SELECT page_id, CASE WHEN trim(coalesce(url, '')) <> '' THEN {id_sql('url')}
 WHEN trim(coalesce(title, '')) <> '' THEN 'ttl-' || substr(sha256(substr(regexp_replace(regexp_replace(
   lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48)), 1, 12)
 ELSE 'unk-' || substr(sha256(raw), 1, 12) END AS project_id FROM v""")
def p2(spark, d):
    return view(spark, d, "pages", P2_VIEW).select(
        "page_id", urls.project_id(F.col("url"), F.col("title"), F.col("raw")).alias("project_id"))


P3_VIEW = {"page_id": "page_id", "url": "replace(url, '#top', '') || CASE WHEN instr(url, '?') > 0 THEN '&' ELSE '?' END "
           f"|| 'page=9&gclid=x&q=a%20b+' || {s('page_id')} || '&empty=&page=3&novalue#frag'"}


@query("p3_tracking_free_url", f"""WITH {cte('v', 'pages', P3_VIEW)},
q AS (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: split_part(x, '=', 2) <> ''
  AND split_part(x, '=', 1) NOT IN ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid','msclkid','ref','source')) AS l FROM v),
k AS (SELECT page_id, url, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: split_part(y, '=', 1)), split_part(x, '=', 1)) = i) AS l FROM q)
SELECT page_id, {canon_sql('url')} || CASE WHEN len(l) > 0 THEN '?' || array_to_string(list_transform(l, lambda x: url_decode(replace(x, '+', ' '))), '&') ELSE '' END AS url FROM k""")
def p3(spark, d):
    return view(spark, d, "pages", P3_VIEW).select("page_id", urls.tracking_free_url(F.col("url")).alias("url"))


@query("p4_provider_key", f"SELECT page_id, 'freelancermap:' || {canon_sql('url')} AS provider_key FROM pages")
def p4(spark, d):
    return table(spark, d, "pages").select("page_id", urls.provider_key(
        F.lit("freelancermap"), urls.identity_url(F.col("url"))).alias("provider_key"))


@query("p5_feed_label", """WITH n AS (SELECT page_id, lang, regexp_replace(list_extract(string_split(regexp_replace(
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), '/'), -1), '[.][^.]*$', '') AS name
  FROM (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN 'freelancermap' ELSE 'gulp' END AS lang FROM pages))
SELECT page_id, CASE WHEN lang = 'freelancermap' THEN upper(name) ELSE lang || ':' || upper(name) END AS label FROM n""")
def p5(spark, d):
    provider = F.when(F.col("page_id") % 2 == 0, "freelancermap").otherwise("gulp")
    return table(spark, d, "pages").select("page_id", urls.feed_label(provider, F.col("url")).alias("label"))


@query("p6_rule_fingerprint", """SELECT lang, substr(sha1('{"source":"' || source || '","n":' || n || '}'), 1, 12) AS terms
FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source)""")
def p6(spark, d):
    rules = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return rules.select("lang", urls.fingerprint(F.to_json(F.struct("source", "n"))).alias("terms"))


@query("p7_cache_key", """SELECT doc_id, sha256(text || '|' || source || '|v1|model-a|65|35') AS cache_key FROM documents""")
def p7(spark, d):
    return table(spark, d, "documents").select("doc_id", urls.cache_key(
        F.col("text"), F.col("source"), F.lit("v1"), F.lit("model-a"), F.lit(65), F.lit(35)).alias("cache_key"))


FOLD = "{}"
for _u, _p in V.UMLAUTS.items():
    FOLD = f"replace({FOLD}, '{_u}', '{_p}')"


def fold_sql(col: str) -> str:
    return FOLD.format(col)


@query("p8_umlaut_folding", f"SELECT doc_id, sha256({fold_sql('text')}) AS folded FROM documents")
def p8(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(X.fold_umlauts(F.col("text")), 256).alias("folded"))


TOKEN_RE = r"'[a-z0-9](?:[^\s/\\()\[\]{},;:-]*[a-z0-9])?'"
STOP_SQL = "(" + ", ".join(text(w) for w in X.STOPWORDS) + ")"


def tokens_sql(col: str) -> str:
    return (f"list_filter(regexp_extract_all({fold_sql(f'lower({col})')}, {TOKEN_RE}), "
            f"lambda t: length(t) >= 2 AND t NOT IN {STOP_SQL})")


@query("p9_tokens", f"SELECT doc_id, len(t) AS n, sha256(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def p9(spark, d):
    return table(spark, d, "documents").select("doc_id", X.tokens(F.col("text")).alias("t")).select(
        "doc_id", F.size("t").cast("bigint").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("tokens"))


def number_sql(expr: str) -> str:
    return f"TRY_CAST(replace(replace(nullif({expr}, ''), '.', ''), ',', '.') AS DOUBLE)"


def re(pattern: str) -> str:
    return text("(?i)" + pattern)


def rate_sql(col: str, *patterns: str) -> str:
    return "coalesce(" + ", ".join(number_sql(f"regexp_extract({col}, {re(p)}, 1)") for p in patterns) + ")"


@query("p10_rates", f"""WITH {POSTING_CTE} SELECT doc_id, {rate_sql('description', V.HOURLY_LABELLED, V.HOURLY_UNIT)} AS hourly,
 {rate_sql('description', V.DAILY_LABELLED, V.DAILY_UNIT)} AS daily FROM p""")
def p10(spark, d):
    c = F.col("description")
    return postings(spark, d).select("doc_id", P.hourly_rate(c).alias("hourly"), P.daily_rate(c).alias("daily"))


P11_VIEW = {"o_orderkey": "o_orderkey", "raw": f"CASE o_orderkey % 3 WHEN 0 THEN {s('o_custkey')} || '.' || {s('o_orderkey % 100')} "
            f"WHEN 1 THEN {s('o_custkey')} || ',' || {s('o_orderkey % 100')} ELSE '1.' || {s('o_custkey')} || ',5' END"}


@query("p11_german_number", f"WITH {cte('v', 'orders', P11_VIEW)} SELECT o_orderkey, {number_sql('raw')} AS value FROM v")
def p11(spark, d):
    return view(spark, d, "orders", P11_VIEW).select("o_orderkey", P.german_number(F.col("raw")).alias("value"))


def mode_sql(col: str) -> str:
    exact = " ".join(f"WHEN lower({col}) = {text(k)} THEN '{v}'" for k, v in V.WORK_MODES.items())
    inside = " ".join(f"WHEN contains(lower({col}), {text(k)}) THEN '{v}'" for k, v in V.WORK_MODES.items())
    return f"CASE {exact} {inside} END"


@query("p12_work_mode", f"WITH {POSTING_CTE} SELECT doc_id, {mode_sql('description')} AS work_mode FROM p")
def p12(spark, d):
    return postings(spark, d).select("doc_id", P.work_mode(F.col("description")).alias("work_mode"))


def contract_sql(col: str) -> str:
    low = f"lower({col})"
    exact = " ".join(f"WHEN trim({low}) = {text(k)} THEN '{v}'" for k, v in V.CONTRACT_TYPES.items())

    def inside(k: str, v: str) -> str:
        pos = f"instr({low}, {text(k)})"
        start = f"greatest(1, {pos} - 30)"
        window = f"substr({low}, {start}, {pos} - {start})"
        return f"WHEN {pos} > 0 AND NOT regexp_matches({window}, {re(V.NEGATION)}) THEN '{v}'"
    return f"CASE {exact} {' '.join(inside(k, v) for k, v in V.CONTRACT_TYPES.items())} END"


@query("p13_contract_type", f"WITH {POSTING_CTE} SELECT doc_id, {contract_sql('description')} AS contract_type FROM p")
def p13(spark, d):
    return postings(spark, d).select("doc_id", P.contract_type(F.col("description")).alias("contract_type"))


def lang_re2(pattern: str) -> str:
    """A word boundary that also knows letters beyond ASCII."""
    edge, end = r"(?:^|[^\pL\pN_])", r"(?:[^\pL\pN_]|$)"
    return "(?i)" + edge + pattern[2:].replace(r"\b", end)


def languages_sql(col: str) -> str:
    return "list_filter([" + ", ".join(
        f"CASE WHEN regexp_matches({col}, {text(lang_re2(p))}) THEN '{c}' END" for c, p in V.LANGUAGES.items()) + "], lambda x: x IS NOT NULL)"


@query("p14_languages", f"WITH {POSTING_CTE} SELECT doc_id, array_to_string({languages_sql('description')}, ',') AS languages FROM p")
def p14(spark, d):
    return postings(spark, d).select("doc_id", F.array_join(P.languages(F.col("description")), ",").alias("languages"))


P15_VIEW = {"p_partkey": "p_partkey", "term": "CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || '*' ELSE ' ' || p_brand || '-x.y ' END"}


@query("p15_term_pattern", f"""WITH {cte('v', 'part', P15_VIEW)},
w AS (SELECT p_partkey, trim(term) AS t, list_filter(regexp_split_to_array(lower(trim(regexp_replace(trim(term), '[*]+$', ''))), '[\\s-]+'), lambda x: x <> '') AS parts FROM v)
SELECT p_partkey, '(?<![{V.WORD}])' || array_to_string(list_transform(parts, lambda x: regexp_replace(x, '([^{V.WORD}_])', '\\\\\\1', 'g')), {text(V.GAP)})
 || CASE WHEN suffix(t, '*') THEN '' ELSE '(?![{V.WORD}])' END AS pattern FROM w""")
def p15(spark, d):
    return view(spark, d, "part", P15_VIEW).select("p_partkey", terms.term_pattern(F.col("term"), first="start").alias("pattern"))


@query("p16_tag_text", "SELECT doc_id, concat_ws(' ; ', lang, nullif(CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END, '')) AS tags FROM documents")
def p16(spark, d):
    tags = F.array(F.col("lang"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(""))
    return table(spark, d, "documents").select("doc_id", X.tag_text(X.tag_list(tags)).alias("tags"))


@query("p17_full_text", f"WITH {POSTING_CTE} SELECT doc_id, sha256(title || ' ' || description) AS spaced, sha256(title || {NL} || description) AS lined FROM p")
def p17(spark, d):
    df = postings(spark, d)
    parts = [F.col("title"), F.lit(""), F.lit(None).cast("string"), F.col("description")]
    return df.select("doc_id", F.sha2(X.full_text(*parts), 256).alias("spaced"),
                     F.sha2(X.full_text(*parts, sep="\n"), 256).alias("lined"))


P18_TERMS = ["anat", "thha*", {"term": "onre", "with": ["ing the", "that of"]}, {"term": "des", "with": ["que"]}, "le la"]


def _p18_sql() -> str:
    from .base import hit
    whens = []
    for t in P18_TERMS:
        name = t if isinstance(t, str) else t["term"]
        test = hit(name, "text")
        if not isinstance(t, str):
            test += " AND (" + " OR ".join(hit(c, "text") for c in t["with"]) + ")"
        whens.append(f"CASE WHEN {test} THEN {text(name)} END")
    return f"SELECT doc_id, array_to_string(list_filter([{', '.join(whens)}], lambda x: x IS NOT NULL), ',') AS matched FROM documents"


@query("p18_contextual_terms", _p18_sql())
def p18(spark, d):
    df = table(spark, d, "documents").withColumn("low", terms.search_form(F.col("text")))
    return df.select("doc_id", F.array_join(terms.matched(
        terms.compile_terms(P18_TERMS), F.col("low")), ",").alias("matched"))


def must_sql(col: str) -> str:
    """Windows rebuilt from the pieces between headings."""
    pat = re(V.MUST_START)
    pieces, heads = f"regexp_split_to_array({col}, {pat})", f"regexp_extract_all({col}, {pat})"
    rest = (f"substr(array_to_string(list_transform(range(i, len({pieces}) + 1), lambda j: CASE WHEN j = i THEN ({pieces})[j] "
            f"ELSE ({heads})[j - 1] || ({pieces})[j] END), ''), 1, {V.MUST_CHARS})")
    return (f"array_to_string(list_transform(range(2, len({pieces}) + 1), lambda i: "
            f"(regexp_split_to_array({rest}, {re(V.MUST_END)}))[1]), {NL})")


@query("p19_must_sections", f"WITH {POSTING_CTE} SELECT doc_id, length(m) AS n, sha256(m) AS sections FROM (SELECT doc_id, {must_sql('description')} AS m FROM p)")
def p19(spark, d):
    df = postings(spark, d).select("doc_id", P.must_sections(F.col("description")).alias("m"))
    return df.select("doc_id", F.length("m").cast("bigint").alias("n"), F.sha2("m", 256).alias("sections"))


def general_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(printf('%.4f', {x}), '0+$', ''), '[.]$', '')"


def workload_sql(col: str, source: str) -> str:
    def g(p: str, i: int) -> str:
        return f"nullif(regexp_extract({col}, {re(p)}, {i}), '')"
    return f"""SELECT doc_id, CASE WHEN lo IS NULL THEN 'unbekannt' WHEN hi >= 20 AND lo <= 40 THEN 'erfüllt' ELSE 'nicht erfüllt' END AS status,
 CASE WHEN lo IS NULL AND part THEN 'Teilzeit' WHEN lo IS NULL THEN NULL WHEN label IS NOT NULL THEN label || ' (' || shown || ')' ELSE shown END AS value,
 CASE WHEN lo IS NULL AND part THEN 'Teilzeit ohne Stundenangabe' WHEN lo IS NULL THEN 'Keine Auslastung angegeben'
      WHEN NOT (hi >= 20 AND lo <= 40) THEN 'Außerhalb von 20–40 h/Woche' END AS note
FROM (SELECT *, CASE WHEN lo = hi THEN {general_sql('lo')} ELSE {general_sql('lo')} || '–' || {general_sql('hi')} END || ' h/Woche' AS shown FROM (
 SELECT doc_id, part, CASE WHEN r1 IS NOT NULL THEN CAST(r1 AS DOUBLE) WHEN h IS NOT NULL THEN CAST(h AS DOUBLE) WHEN d1 IS NOT NULL THEN CAST(d1 AS DOUBLE) * 8
   WHEN pc IS NOT NULL THEN CAST(pc AS DOUBLE) * 40 / 100 WHEN ft THEN 40 END AS lo,
  CASE WHEN r1 IS NOT NULL THEN CAST(r2 AS DOUBLE) WHEN h IS NOT NULL THEN CAST(h AS DOUBLE) WHEN d1 IS NOT NULL THEN CAST(coalesce(d2, d1) AS DOUBLE) * 8
   WHEN pc IS NOT NULL THEN CAST(pc AS DOUBLE) * 40 / 100 WHEN ft THEN 40 END AS hi,
  CASE WHEN r1 IS NOT NULL OR h IS NOT NULL THEN NULL WHEN d1 IS NOT NULL THEN d0 WHEN pc IS NOT NULL THEN pc || ' %' WHEN ft THEN 'Vollzeit' END AS label
 FROM (SELECT doc_id, {g(V.HOURS_RANGE, 1)} AS r1, {g(V.HOURS_RANGE, 2)} AS r2, {g(V.HOURS, 1)} AS h, {g(V.DAYS, 1)} AS d1, {g(V.DAYS, 2)} AS d2,
   {g(V.DAYS, 0)} AS d0, {g(V.PERCENT, 1)} AS pc, regexp_matches({col}, {re(V.FULL_TIME)}) AS ft, regexp_matches({col}, {re(V.PART_TIME)}) AS part FROM {source})))"""


@query("p20_workload", f"WITH {POSTING_CTE} {workload_sql('description', 'p')}")
def p20(spark, d):
    w = P.workload(F.col("description"))
    return postings(spark, d).select("doc_id", w.alias("w")).select("doc_id", "w.*")


def start_sql(col: str, source: str, today: dt.date) -> str:
    month = " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.MONTHS.items())
    md = re(V.MONTH_DATE)
    first = today.replace(day=1)
    return f"""SELECT doc_id, strftime(start, '%Y-%m-%d') AS start, CASE WHEN n = 0 THEN 'sofort' WHEN period THEN shown
  WHEN immediate THEN 'sofort bis spätestens ' || shown WHEN n > 1 THEN 'spätestens ' || shown ELSE shown END AS shown
FROM (SELECT *, strftime(start, '%d.%m.%Y') AS shown FROM (
 SELECT doc_id, period, immediate, len(dates) AS n, CASE WHEN len(dates) = 0 THEN DATE '{today}' WHEN period THEN dates[1] ELSE list_max(dates) END AS start,
   row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn
 FROM (SELECT doc_id, i, lower(label) IN ('zeitraum','projektzeitraum','laufzeit') AS period, regexp_matches(seg, {re(V.IMMEDIATE)}) AS immediate,
   list_filter(list_concat(
     list_transform(regexp_extract_all(seg, {re(V.DAY_DATE)}), lambda x: CAST(try_strptime(x, '%d.%m.%Y') AS DATE)),
     list_transform(regexp_extract_all(seg, {md}), lambda x: CASE WHEN y(x) IS NOT NULL THEN make_date(y(x), mo(x), da(x))
       WHEN make_date({today.year}, mo(x), da(x)) < DATE '{first}' THEN make_date({today.year + 1}, mo(x), da(x)) ELSE make_date({today.year}, mo(x), da(x)) END)
   ), lambda x: x IS NOT NULL) AS dates
  FROM (SELECT doc_id, unnest(regexp_extract_all({col}, {re(V.START_LABEL)}, 1)) AS label, unnest(regexp_extract_all({col}, {re(V.START_LABEL)}, 2)) AS seg,
        generate_subscripts(regexp_extract_all({col}, {re(V.START_LABEL)}, 1), 1) AS i FROM {source}))
 WHERE len(dates) > 0 OR immediate) WHERE rn = 1)""" \
        .replace("y(x)", f"TRY_CAST(nullif(regexp_extract(x, {md}, 3), '') AS INT)") \
        .replace("mo(x)", f"CASE lower(regexp_extract(x, {md}, 2)) {month} END") \
        .replace("da(x)", f"CASE lower(regexp_extract(x, {md}, 1)) WHEN 'mitte' THEN 15 WHEN 'ende' THEN 28 ELSE 1 END")


@query("p21_start_date", f"WITH {POSTING_CTE} SELECT p.doc_id, x.start, x.shown FROM p LEFT JOIN ({start_sql('description', 'p', TODAY)}) x ON x.doc_id = p.doc_id")
def p21(spark, d):
    df = postings(spark, d).select("doc_id", P.start_date(F.col("description"), TODAY).alias("v"))
    return df.select("doc_id", F.date_format("v.start", "yyyy-MM-dd").alias("start"), "v.shown")


@query("p22_remote_share", f"WITH {POSTING_CTE} SELECT doc_id, TRY_CAST(nullif(regexp_extract(description, {re(V.REMOTE_SHARE)}, 1), '') AS INT) AS share FROM p")
def p22(spark, d):
    return postings(spark, d).select("doc_id", P.remote_share(F.col("description")).alias("share"))


# Bodies as the evaluation writes them: none, one or two sections, or a plain score.
def _section(day: str, pre: str, fit: str) -> str:
    return (f"'{V.EVALUATION_MARK}' || {NL} || {NL} || '**Evaluation Timestamp:** ' || {day} || {NL} || {NL} || '### Pre-Evaluation Phase' || {NL} || "
            f"'- **Score:** ' || {s(pre)} || '/100' || {NL} || {NL} || '### LLM Analysis Phase' || {NL} || '- **Fit Score:** ' || {s(fit)} || '/100' || {NL}")


_DAY = f"'2024-01-' || lpad({s('1 + doc_id % 28')}, 2, '0') || 'T08:00:00.5'"
BODY = {
    "doc_id": "doc_id", "source": "source",
    "file_name": "'project_' || " + pick("doc_id", 4, [
        f"'202401' || lpad({s('1 + doc_id % 28')}, 2, '0') || '_101530.md'", f"'20240132_1015_2024-02-0' || {s('1 + doc_id % 9')} || '.md'",
        f"'202403' || lpad({s('1 + doc_id % 40')}, 2, '0') || '.md'", "'x.md'"]),
    "body": f"'# ' || split_part(text, {NL}, 1) || {NL} || '**URL:** [https://x.example.com/' || {s('doc_id')} || '](https://x.example.com/' || {s('doc_id')} || ')' || {NL} || "
            f"'- **Von:** Firma ' || source || {NL} || '- **Eingestellt:** ' || {s('1 + doc_id % 28')} || '.01.2024' || {NL} || "
            f"'Position: Rolle ' || lang || {NL} || 'Ref: R' || {s('doc_id')} || {NL} || text || {NL} || " + pick("doc_id", 6, [
                _section(_DAY, "doc_id % 101", "doc_id * 7 % 101"),
                _section(_DAY, "doc_id % 101", "doc_id * 7 % 101") + " || " + _section("'2024-01-15T00:00:00'", "doc_id * 3 % 101", "doc_id * 11 % 101"),
                _section("'not a date'", "5", "6") + " || " + _section("'2023-12-31'", "doc_id * 3 % 101", "1"),
                f"'## Vorbewertung' || {NL} || '- **Score:** ' || {s('doc_id % 100')} || '/100' || {NL} || '- **Score-Art:** Eignung (regelbasiert)'",
                f"'- **Score:** ' || {s('doc_id % 100')} || '/100' || {NL} || '**LLM Score:** ' || {s('doc_id % 99')} || '%'",
                f"'**Pre-Evaluation Score:** ' || {s('doc_id % 98')} || '%'"]),
}
BODY_CTE = cte("b", "documents", BODY)


def bodies(spark, d):
    return view(spark, d, "documents", BODY)


SECTION_ROWS = f"""sections AS (SELECT doc_id, i, try_cast(replace(regexp_extract(piece, 'Timestamp:[*][*]\\s*([^\\n]+)', 1), 'T', ' ') AS TIMESTAMP) AS ts,
  TRY_CAST(nullif(regexp_extract(piece, '- [*][*]Score:[*][*]\\s*(\\d+)/100', 1), '') AS INT) AS pre,
  TRY_CAST(nullif(regexp_extract(piece, '- [*][*]Fit Score:[*][*]\\s*(\\d+)/100', 1), '') AS INT) AS llm
 FROM (SELECT doc_id, unnest(string_split(body, '{V.EVALUATION_MARK}')[2:]) AS piece, generate_subscripts(string_split(body, '{V.EVALUATION_MARK}')[2:], 1) AS i FROM b))"""

LATEST_SQL = f"""WITH {BODY_CTE}, {SECTION_ROWS},
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, i) AS rn FROM sections WHERE ts IS NOT NULL) WHERE rn = 1),
latest AS (SELECT b.doc_id, body, CASE WHEN contains(body, '{V.EVALUATION_MARK}') THEN n.pre ELSE TRY_CAST(nullif(regexp_extract(body, '- [*][*]Score:[*][*]\\s*(\\d+)/100', 1), '') AS INT) END AS pre,
 CASE WHEN contains(body, '{V.EVALUATION_MARK}') THEN n.llm ELSE TRY_CAST(nullif(regexp_extract(body, '- [*][*]Fit Score:[*][*]\\s*(\\d+)/100', 1), '') AS INT) END AS llm
 FROM b LEFT JOIN newest n ON n.doc_id = b.doc_id)"""


@query("p23_latest_scores", f"{LATEST_SQL} SELECT doc_id, pre, llm FROM latest")
def p23(spark, d):
    return bodies(spark, d).select("doc_id", M.latest_scores(F.col("body")).alias("v")).select("doc_id", "v.*")


@query("p24_score_kind", f"""{LATEST_SQL} SELECT doc_id, CASE WHEN pre IS NULL THEN NULL WHEN contains(body, '{V.EVALUATION_MARK}') THEN 'keyword'
 WHEN regexp_matches(body, '(?m)^- [*][*]Score-Art:[*][*]\\s*Eignung') THEN 'eignung' ELSE 'tfidf' END AS kind FROM latest""")
def p24(spark, d):
    df = bodies(spark, d).select("doc_id", "body", M.latest_scores(F.col("body"))["pre"].alias("pre"))
    return df.select("doc_id", M.score_kind(F.col("body"), F.col("pre")).alias("kind"))


STAMP_SQL = """strftime(coalesce(try_strptime(nullif(regexp_extract(file_name, '\\d{8}_\\d{6}'), ''), '%Y%m%d_%H%M%S'),
 try_strptime(nullif(regexp_extract(file_name, '\\d{8}_\\d{4}'), ''), '%Y%m%d_%H%M'),
 try_strptime(nullif(regexp_extract(file_name, '\\d{4}-\\d{2}-\\d{2}'), ''), '%Y-%m-%d'),
 try_strptime(nullif(regexp_extract(file_name, '\\d{8}'), ''), '%Y%m%d')), '%Y-%m-%d %H:%M:%S')"""


@query("p25_file_timestamp", f"WITH {BODY_CTE} SELECT doc_id, {STAMP_SQL} AS ts FROM b")
def p25(spark, d):
    return bodies(spark, d).select("doc_id", F.date_format(
        dates.file_timestamp(F.col("file_name")), "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("p26_header_fallback", f"""WITH {BODY_CTE} SELECT doc_id,
 CASE WHEN doc_id % 5 = 0 THEN 'Kept' ELSE trim(regexp_extract(body, '^#\\s*([^\\n]*)', 1)) END AS title,
 'Firma ' || source AS company, 'https://x.example.com/' || doc_id AS url, (1 + doc_id % 28) || '.01.2024' AS posted,
 CASE WHEN doc_id % 4 = 0 THEN '2024-01-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') || 'T10:15:30' END AS retrieved FROM b""")
def p26(spark, d):
    none, body = F.lit(None).cast("string"), F.col("body")
    return bodies(spark, d).select(
        "doc_id", M.title_from(F.when(F.col("doc_id") % 5 == 0, "Kept"), body, F.col("file_name")).alias("title"),
        M.company_from(none, body).alias("company"), M.url_from(none, body).alias("url"),
        M.posted_date(body).alias("posted"), M.retrieval_date(none, F.col("file_name")).alias("retrieved"))


@query("p27_markdown", f"""SELECT doc_id, sha256('---' || {NL} || 'provider_id: "gulp"' || {NL} || 'company: ' || CASE WHEN doc_id % 2 = 0 THEN '"' || source || '"' ELSE 'None' END || {NL} || '---' || {NL} || {NL} ||
 '# ' || doc_id || {NL} || '**URL:** [u' || doc_id || '](u' || doc_id || ')' || {NL} || '## Details' || {NL} || '- **Start Datum:** ' || lang || {NL} || {NL} || '## Schlagworte' || {NL} ||
 CASE WHEN doc_id % 3 = 0 THEN 'N/A' ELSE lang || ', ' || source END || {NL} || {NL} || '## Beschreibung' || {NL} || trim(text, ' ' || {NL})) AS content FROM documents""")
def p27(spark, d):
    df = table(spark, d, "documents")
    key = F.col("doc_id").cast("string")
    tags = F.when(F.col("doc_id") % 3 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array("lang", "source"))
    details = F.create_map(F.lit("start_datum"), F.col("lang"), F.lit("leer"), F.lit(""))
    head = M.front_matter({"provider_id": F.lit("gulp"), "company": F.when(F.col("doc_id") % 2 == 0, F.col("source"))})
    body = M.render(key, F.concat(F.lit("u"), key), details, tags, F.col("text"))
    return df.select("doc_id", F.sha2(F.concat_ws("\n", head, body), 256).alias("content"))


@query("p28_score_readers", f"""WITH {BODY_CTE} SELECT doc_id,
 CAST(coalesce(nullif(regexp_extract(body, '[*][*]LLM Score:[*][*]\\s*(\\d+)%', 1), ''), nullif(regexp_extract(body, '[*][*]Pre-Evaluation Score:[*][*]\\s*(\\d+)%', 1), ''), '0') AS INT) AS percent,
 CAST(coalesce(nullif(regexp_extract(body, '(?s)### Pre-Evaluation Phase.*?[*][*]Score:[*][*]\\s*(\\d+)/100', 1), ''), '0') AS INT) AS pre,
 CAST(coalesce(nullif(regexp_extract(body, '(?s)### LLM Analysis Phase.*?[*][*]Fit Score:[*][*]\\s*(\\d+)/100', 1), ''), '0') AS INT) AS fit FROM b""")
def p28(spark, d):
    pre, fit = M.section_scores(F.col("body"))
    return bodies(spark, d).select("doc_id", M.percent_score(F.col("body")).alias("percent"), pre.alias("pre"), fit.alias("fit"))


RANGE_VIEW = {"o_orderkey": "o_orderkey", "day": "CAST(o_orderdate AS DATE)", "label": pick("o_orderkey", 7, [
    "'today'", "'last_7_days'", "'current_week'", "'previous_week'", "'current_month'", "'previous_month'", "'2024-01-05'"])}
UI_VIEW = {"o_orderkey": "o_orderkey", "day": "CAST(o_orderdate AS DATE)", "label": pick("o_orderkey", 9, [
    "'today'", "'last_2_days'", "'last_3_days'", "'last_10_days'", "'this_week'", "'last_week'", "'this_month'", "'last_month'", "'else'"])}


@query("p30_server_ranges", f"""WITH {cte('v', 'orders', RANGE_VIEW)}, w AS (SELECT *, CAST(date_trunc('week', day) AS DATE) AS mon, CAST(date_trunc('month', day) AS DATE) AS fom FROM v)
SELECT o_orderkey, strftime(CASE label WHEN 'today' THEN day WHEN 'last_7_days' THEN day - 7 WHEN 'current_week' THEN mon WHEN 'previous_week' THEN mon - 7
 WHEN 'current_month' THEN fom WHEN 'previous_month' THEN CAST(fom - INTERVAL 1 MONTH AS DATE) ELSE DATE '2024-01-05' END, '%Y-%m-%d') AS date_from,
 strftime(CASE label WHEN 'previous_week' THEN mon - 1 WHEN 'previous_month' THEN fom - 1 END, '%Y-%m-%d') AS date_to FROM w""")
def p30(spark, d):
    df = view(spark, d, "orders", RANGE_VIEW).select("o_orderkey", dates.server_range(F.col("label"), F.col("day")).alias("r"))
    return df.select("o_orderkey", F.date_format("r.date_from", "yyyy-MM-dd").alias("date_from"),
                     F.date_format("r.date_to", "yyyy-MM-dd").alias("date_to"))


@query("p31_ui_ranges", f"""WITH {cte('v', 'orders', UI_VIEW)}, w AS (SELECT *, day - CAST(dayofweek(day) AS INT) AS sun, CAST(date_trunc('month', day) AS DATE) AS fom FROM v)
SELECT o_orderkey, strftime(CASE label WHEN 'today' THEN day WHEN 'last_2_days' THEN day - 1 WHEN 'last_3_days' THEN day - 2 WHEN 'last_10_days' THEN day - 9
 WHEN 'this_week' THEN sun WHEN 'last_week' THEN sun - 7 WHEN 'this_month' THEN fom WHEN 'last_month' THEN CAST(fom - INTERVAL 1 MONTH AS DATE) END, '%Y-%m-%d') AS date_from,
 strftime(CASE label WHEN 'last_week' THEN sun - 1 WHEN 'last_month' THEN fom - 1 WHEN 'else' THEN NULL ELSE day END, '%Y-%m-%d') AS date_to FROM w""")
def p31(spark, d):
    df = view(spark, d, "orders", UI_VIEW).select("o_orderkey", dates.ui_range(F.col("label"), F.col("day")).alias("r"))
    return df.select("o_orderkey", F.date_format("r.date_from", "yyyy-MM-dd").alias("date_from"),
                     F.date_format("r.date_to", "yyyy-MM-dd").alias("date_to"))


@query("p32_cost_estimate", """SELECT doc_id, greatest(1, length(text) // 4) AS tokens,
 CAST(round(greatest(1, length(text) // 4) * 0.25 + 1024 * 1.25, 2) AS DOUBLE) AS micro_usd,
 CAST(round(floor(length(text) * 0.8) * 2 + floor(length(text) * 0.2) * 6, 2) AS DOUBLE) AS alt_micro_usd,
 len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words FROM documents""")
def p32(spark, d):
    t = X.estimate_tokens(F.col("text"))
    n = F.length("text")
    return table(spark, d, "documents").select(
        "doc_id", t.alias("tokens"), F.round(X.estimate_cost(t, F.lit(1024)) * 1e6, 2).alias("micro_usd"),
        F.round(X.cost_per_1k(n) * 1e6, 2).alias("alt_micro_usd"),
        F.round(X.words_to_tokens(F.col("text")) / 1.3).cast("bigint").alias("words"))


@query("p33_middle_truncation", f"""SELECT doc_id, length(text) > 400 AS truncated, sha256(CASE WHEN length(text) <= 400 THEN text ELSE
 rtrim(substr(text, 1, 150), ' ' || {NL}) || {NL} || {NL} || '{V.TRUNCATION_MARK.strip()}' || {NL} || {NL} || ltrim(right(text, 150), ' ' || {NL}) END) AS text FROM documents""")
def p33(spark, d):
    short, cut = X.truncate_middle(F.col("text"), 400)
    return table(spark, d, "documents").select("doc_id", cut.alias("truncated"), F.sha2(short, 256).alias("text"))


TEMPLATE = "Regeln{note}\n{profiles}\n<project_text>\n{text}\n</project_text>\nIDs {profile_ids}"


@query("p34_prompt", f"""SELECT doc_id, sha256('Regeln' || CASE WHEN length(text) > 9000 THEN {' || chr(10) || '.join(text(p) for p in V.TRUNCATION_NOTE.split(chr(10)))} ELSE '' END || {NL} ||
 '<profile id="alpha">' || {NL} || '- x' || {NL} || '</profile>' || {NL} || {NL} || '<profile id="beta">' || {NL} || '- y' || {NL} || '</profile>' || {NL} || '<project_text>' || {NL} || text || {NL} || '</project_text>'
 || {NL} || 'IDs ["alpha", "beta"]') AS prompt FROM documents""")
def p34(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.sha2(R.prompt(
        TEMPLATE, c, {"alpha": "- x", "beta": "- y"}, F.length(c) > 9000), 256).alias("prompt"))


@query("p34_profile_digest", f"""WITH w AS (SELECT item_id, list_filter(list_transform(string_split('# Kopf' || {NL} || '* ' || text, {NL}), lambda v: trim(v)), lambda v: v <> '' AND NOT starts_with(v, '#')) AS l FROM benchmark),
k AS (SELECT item_id, list_filter(list_transform(l, lambda v: trim(regexp_replace(v, '^[-*•]\\s*', ''))), lambda v: v <> '' AND length(v) < 120) AS l FROM w),
j AS (SELECT item_id, array_to_string(list_transform(l, lambda v: '- ' || v), {NL}) AS g FROM k)
SELECT item_id, sha256(CASE WHEN length(g) > 800 THEN substr(g, 1, 800) || {NL} || '[...gekürzt]' ELSE g END) AS digest FROM j""")
def p34b(spark, d):
    raw = F.concat(F.lit("# Kopf\n* "), F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.sha2(R.profile_digest(raw), 256).alias("digest"))


# Answers with every fault the validation knows, one kind per remainder.
_ITEM = "'{\"profile_id\": \"' || {p} || '\", \"score\": ' || {v} || ', \"matched\": [\"a' || source || '\", \"\", \"b\"], \"missing\": \"none\", \"rationale\": \"' || source || '\"}'"


def _item(p: str, v: str) -> str:
    return _ITEM.replace("{p}", p).replace("{v}", v)


ANSWER = {
    "doc_id": "doc_id",
    "raw": "CASE doc_id % 9 WHEN 0 THEN 'no json here' WHEN 1 THEN '{\"evaluations\": [' "
           "WHEN 2 THEN '{\"other\": 1}' ELSE '```json {\"evaluations\": [' || "
           + _item("'alpha'", s("doc_id % 101")) + " || ', ' || "
           + _item("CASE doc_id % 9 WHEN 3 THEN 'gamma' WHEN 4 THEN 'alpha' ELSE 'beta' END",
                   "CASE doc_id % 9 WHEN 5 THEN '101' WHEN 6 THEN '\"high\"' ELSE " + s("(doc_id * 7) % 101") + " END")
           + " || CASE WHEN doc_id % 9 = 7 THEN ', ' || " + _item("'beta'", "'1'") + " ELSE '' END || ']} ```' END",
    "source": "source",
}
ANSWER_CTE = cte("a", "documents", ANSWER)


@query("p35_response_validation", f"""WITH {ANSWER_CTE} SELECT doc_id,
 CASE doc_id % 9 WHEN 0 THEN 'no JSON object in the answer' WHEN 1 THEN 'no JSON object in the answer' WHEN 2 THEN 'key ''evaluations'' is missing or no list'
 WHEN 3 THEN 'unknown profile_id: gamma' WHEN 4 THEN 'duplicate profile_id: alpha' WHEN 5 THEN 'score outside [0,100] for beta' WHEN 6 THEN 'score is no number for beta'
 WHEN 7 THEN 'expected 2 entries, got 3' END AS error,
 CASE WHEN doc_id % 9 = 8 THEN CAST(json_extract_string(regexp_extract(raw, '(?s)\\{{.*\\}}', 0), '$.evaluations[1].score') AS INT) END AS second_score,
 CASE WHEN doc_id % 9 = 8 THEN 'a' || source || ',b' END AS matched, CASE WHEN doc_id % 9 = 8 THEN 0 END AS n_missing FROM a""")
def p35(spark, d):
    df = view(spark, d, "documents", ANSWER).select(
        "doc_id", R.validate_response(F.col("raw"), ["alpha", "beta"]).alias("v"))
    second = F.get("v.evaluations", F.lit(1))
    return df.select("doc_id", "v.error", second["score"].alias("second_score"),
                     F.array_join(second["matched"], ",").alias("matched"),
                     F.when(second.isNotNull(), F.size(second["missing"])).alias("n_missing"))


# Faults of single fields: quoted, boolean and broken scores, an entry that is no object, faults in both entries.
_FAULTS = [
    ('{"profile_id": "alpha", "score": "55"}, {"profile_id": "beta", "score": 5}', "'score is no number for alpha'", "NULL"),
    ('{"profile_id": "alpha", "score": true}, {"profile_id": "beta", "score": false}', "NULL", "1"),
    ('{"profile_id": "alpha", "score": 101}, {"profile_id": "gamma", "score": 5}', "'score outside [0,100] for alpha'", "NULL"),
    ('{"profile_id": "delta", "score": "x"}, {"profile_id": "gamma", "score": 5}', "'unknown profile_id: delta'", "NULL"),
    ('{"profile_id": "alpha", "score": 99.9}, {"profile_id": "beta", "score": 100}', "NULL", "99"),
    ('{"profile_id": "alpha", "score": 1}, 7', "'no object as entry 1'", "NULL"),
    ('{"profile_id": "beta", "score": null}, {"profile_id": "beta", "score": -1}', "'score is no number for beta'", "NULL"),
    ('{"profile_id": "beta", "score": -0.5}, {"profile_id": "alpha", "score": -1}', "'score outside [0,100] for alpha'", "NULL"),
]
FAULTY = {"doc_id": "doc_id", "raw": pick("doc_id", len(_FAULTS), [text(f'{{"evaluations": [{f}]}}') for f, _, _ in _FAULTS])}


@query("p35_entry_faults", f"""SELECT doc_id, {pick("doc_id", len(_FAULTS), [e for _, e, _ in _FAULTS])} AS error,
 CAST({pick("doc_id", len(_FAULTS), [v for _, _, v in _FAULTS])} AS INT) AS first_score FROM documents""")
def p35_faults(spark, d):
    v = view(spark, d, "documents", FAULTY).select("doc_id", R.validate_response(F.col("raw"), ["alpha", "beta"]).alias("v"))
    return v.select("doc_id", "v.error", F.get("v.evaluations", F.lit(0))["score"].alias("first_score"))


@query("p36_priority_label", f"WITH {CORPUS_CTE} SELECT id, CASE WHEN fit_score >= 65 THEN 'high_priority' WHEN fit_score >= 35 THEN 'review' ELSE 'low_priority' END AS label FROM c")
def p36(spark, d):
    return corpus(spark, d).select("id", R.priority_label(F.col("fit_score")).alias("label"))


@query("p37_page_sections", """WITH v AS (SELECT page_id, regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', '', 'g') AS h FROM pages),
x AS (SELECT page_id, unnest(regexp_split_to_array(h, '(?i)<h[1-4]\\b[^>]*>')[2:]) AS piece, generate_subscripts(regexp_split_to_array(h, '(?i)<h[1-4]\\b[^>]*>')[2:], 1) - 1 AS section_ord FROM v)
SELECT page_id, CAST(section_ord AS INT) AS section_ord, replace(trim(regexp_replace(regexp_split_to_array(piece, '(?i)</h[1-4]\\s*>')[1], '\\s*<[^>]*>\\s*', '', 'g')), '&amp;', '&') AS heading FROM x""")
def p37(spark, d):
    return PG.section_rows(table(spark, d, "pages").select("page_id", "html")).select("page_id", "section_ord", "heading")


P38_PAGE = {"page_id": "page_id", "html": "html || '<div><span>Start</span><span>' || substr(url, 9, 6) || '</span><b>Ansprechpartner:</b><i>Frau</i><i>Muster</i>"
            "<dt>Ort</dt><dd>:</dd><dd>Mainz' || CAST(page_id AS STRING) || '</dd><p>Start:</p><p>spät' || CAST(page_id % 5 AS STRING) || '</p></div>'"}


@query("p38_label_values", """SELECT page_id, unnest(['Start', 'Ansprechpartner', 'Ort']) AS label, unnest(['spät' || (page_id % 5), 'Frau Muster', 'Mainz' || page_id]) AS value FROM pages""")
def p38(spark, d):
    return PG.label_rows(view(spark, d, "pages", P38_PAGE))


P39_PAGE = {"page_id": "page_id", "html": "html || '<span class=\"tag x\"> ' || substr(url, 1, 5) || ' </span><span class=\"keyword\">42</span><span class=\"keyword\">k' "
            "|| CAST(page_id % 7 AS STRING) || '</span><span class=\"note\">no</span><meta name=\"keywords\" content=\"k' || CAST(page_id % 7 AS STRING) || ', m' || CAST(page_id AS STRING) || ',\">'"}


@query("p39_keywords", """SELECT page_id, substr(url, 1, 5) || '|k' || (page_id % 7) || '|m' || page_id AS keywords FROM pages""")
def p39(spark, d):
    return view(spark, d, "pages", P39_PAGE).select("page_id", F.array_join(PG.keywords(F.col("html")), "|").alias("keywords"))


@query("p40_field_rules", """SELECT page_id, nullif(replace(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1', 1), '\\s*<[^>]*>\\s*', '', 'g')), '&amp;', '&'), '') AS title,
 CASE WHEN page_id % 2 = 0 THEN 'Acme ' || page_id END AS company, nullif(regexp_extract(url, '([0-9]+)(?:\\.html)?/?(?:[?#].*)?$', 1), '') AS reference_id,
 CASE WHEN page_id % 3 = 0 THEN 'Ort-' || page_id END AS location, CAST(NULL AS VARCHAR) AS published FROM pages""")
def p40(spark, d):
    extra = {"page_id": "page_id", "url": "url", "html": "html || CASE WHEN page_id % 2 = 0 THEN '<script type=\"application/ld+json\">{\"name\": \"Acme ' || CAST(page_id AS STRING) || '\"}</script>' ELSE '' END "
             "|| CASE WHEN page_id % 3 = 0 THEN '<p>Standort: Ort-' || CAST(page_id AS STRING) || '</p>' ELSE '' END"}
    return PG.extract_fields(view(spark, d, "pages", extra), PG.COMMON_RULES).drop("url", "html")


# Pages of the known sites: which of the places holds a field goes by the remainder of the id.
_ID = s("page_id")
_LONG = "trim(repeat('lang ' || " + _ID + " || ' ', 30))"
SOLCOM = {"page_id": "page_id", "url": f"'https://www.solcom.de/projektangebote/daten-analyst-' || {_ID} || '?x=1'", "html": f"""
 '<html><head>' || CASE page_id % 4 WHEN 0 THEN '<meta property="og:title" content="Projekt: Meta ' || {_ID} || '">' WHEN 2 THEN '<title>Titel ' || {_ID} || ' – Freiberufler Projekt SOLCOM</title>' ELSE '<title>x</title>' END
 || '</head><body>' || CASE page_id % 4 WHEN 1 THEN '<h2>Weitere Projekte von uns</h2><h2>Kurz</h2><h2>Analyst Nummer ' || {_ID} || '</h2>' ELSE '' END
 || CASE page_id % 3 WHEN 0 THEN '<div class="project-header"><div>Projekt-Nr.: <b>P' || {_ID} || '</b></div></div>' ELSE '' END
 || '<div class="projekt-body"><div class="projekt-desc x"><p>Eins</p><div>Zwei <b>drei</b></div></div><div>nein</div></div><span class="tags">q' || {_ID} || '</span><div class="skillbox">r</div>'"""}


@query("p40_site_solcom", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Meta ' || page_id WHEN 1 THEN 'Analyst Nummer ' || page_id WHEN 2 THEN 'Titel ' || page_id ELSE 'Daten Analyst' END AS title, 'Solcom GmbH' AS company,
 CASE page_id % 3 WHEN 0 THEN 'P' || page_id ELSE CAST(page_id AS VARCHAR) END AS reference_id, 'Eins' || chr(10) || 'Zwei' || chr(10) || 'drei' AS description, 'q' || page_id AS keywords FROM pages""")
def p40_solcom(spark, d):
    return PG.parse_pages(view(spark, d, "pages", SOLCOM)).select("page_id", "title", "company", "reference_id", "description", F.array_join("schlagworte", "|").alias("keywords"))


FREELANCE = {"page_id": "page_id", "url": f"'https://www.freelance.de/projekte/projekt-' || {_ID} || '-x'", "html": f"""
 '<html><head><title>Seite ' || {_ID} || ' - freelance.de</title><meta name="keywords" content="m' || {_ID} || ', k1">' || CASE page_id % 3 WHEN 0 THEN '<meta property="og:title" content="Rolle ' || {_ID} || ' - Freelance.de">' ELSE '' END
 || '</head><body>' || CASE page_id % 3 WHEN 1 THEN '<h1>Seite</h1><h1 class="a project-title">Kopf ' || {_ID} || '</h1>' ELSE '' END || CASE page_id % 2 WHEN 0 THEN '<p class="kunde">Kunde ' || {_ID} || '</p>' ELSE '<p>Firma: Haus ' || {_ID} || '</p>' END
 || '<i class="standort"> Ort ' || {_ID} || '</i><div class="job-description">kurz</div><div class="x my-description-y"><div>' || {_LONG} || '</div><p>Ende</p></div>'
 || '<div class="tags"><span>k1</span><a href="#">k2</a><li>7</li></div>'"""}


@query("p40_site_freelance", f"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Rolle ' || page_id WHEN 1 THEN 'Kopf ' || page_id ELSE 'Seite ' || page_id END AS title, CASE page_id % 2 WHEN 0 THEN 'Kunde ' ELSE 'Haus ' END || page_id AS company,
 'Ort ' || page_id AS location, CAST(page_id AS VARCHAR) AS reference_id, sha256(trim(repeat('lang ' || page_id || ' ', 30)) || chr(10) || 'Ende') AS description, 'k1|k2|m' || page_id AS keywords FROM pages""")
def p40_freelance(spark, d):
    return PG.parse_pages(view(spark, d, "pages", FREELANCE)).select(
        "page_id", "title", "company", "location", "reference_id", F.sha2("description", 256).alias("description"), F.array_join("schlagworte", "|").alias("keywords"))


GULP = {"page_id": "page_id", "url": f"'https://www.gulp.de/gulp2/g/projekte/' || {_ID}", "html": f"""
 '<html><body>' || CASE page_id % 2 WHEN 0 THEN '<h1 data-testid="projectTitle"> Titel ' || {_ID} || '</h1>' ELSE '<h1 class="gp-title">Kopf ' || {_ID} || '</h1>' END
 || '<b data-testid="contactPersonFullName">Frau ' || {_ID} || '</b><li data-testid="infoListItem">Beginn 06.10.2025</li><li data-testid="infoListItem">Einsatzort  5513' || {s("page_id % 10")} || ' Mainz</li>'
 || '<div class="gp-project-description">' || {_LONG} || '</div><span class="tag">kurz</span><span class="tag">Kubernetes ' || {_ID} || '</span>'"""}


@query("p40_site_gulp", """SELECT page_id, CASE page_id % 2 WHEN 0 THEN 'Titel ' ELSE 'Kopf ' END || page_id AS title, 'Frau ' || page_id AS company, '5513' || (page_id % 10) || ' Mainz' AS location, '06.10.2025' AS published,
 sha256(trim(repeat('lang ' || page_id || ' ', 30))) AS description, 'Kubernetes ' || page_id AS keywords FROM pages""")
def p40_gulp(spark, d):
    return PG.parse_pages(view(spark, d, "pages", GULP)).select(
        "page_id", "title", "company", "location", "published", F.sha2("description", 256).alias("description"), F.array_join("schlagworte", "|").alias("keywords"))


P41_PAGE = {"page_id": "page_id", "url": "url", "html": P38_PAGE["html"] + " || '<div class=\"page\"><div class=\"main\"><p>Aufgabe ' || CAST(page_id AS STRING) || '</p><p>' || trim(repeat(url || ' ', 20)) || '</p></div></div><span class=\"tag\">k' || CAST(page_id % 7 AS STRING) || '</span>'"}


@query("p41_page_schema", """SELECT page_id, nullif(replace(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1', 1), '\\s*<[^>]*>\\s*', '', 'g')), '&amp;', '&'), '') AS title,
 nullif(regexp_extract(url, '([0-9]+)(?:\\.html)?/?(?:[?#].*)?$', 1), '') AS reference_id, 'Mainz' || page_id AS place, sha256('Aufgabe ' || page_id || chr(10) || trim(repeat(url || ' ', 20))) AS description, 'k' || (page_id % 7) AS keywords FROM pages""")
def p41(spark, d):
    df = PG.parse_pages(view(spark, d, "pages", P41_PAGE))
    return df.select("page_id", "title", "reference_id", F.col("details")["Ort"].alias("place"), F.sha2("description", 256).alias("description"),
                     F.array_join("schlagworte", "|").alias("keywords"))


P42_MAIL = {"page_id": "page_id", "text": "'Neu: ' || url || ' und https://ads.example.org/x/' || CAST(page_id AS STRING) || ' Ende'",
            "html": "'<a class=\"b\" href=\"' || url || '\">x</a><a href=\"mailto:a@b.de\">y</a><a href=\"https://jobs.example.com/p/' || CAST(page_id AS STRING) || '\">z</a>'"}


@query("p42_message_urls", """SELECT page_id, CASE WHEN regexp_matches(url, 'spam|pills') THEN '' ELSE url || ' ' END || 'https://jobs.example.com/p/' || page_id AS urls FROM pages""")
def p42(spark, d):
    found = mail.message_urls(F.col("text"), F.col("html"), [r"https?://\S+\.example\.\S+"], [r"spam|pills", r"^https://ads\."])
    return view(spark, d, "pages", P42_MAIL).select("page_id", F.array_join(found, " ").alias("urls"))


# Texts with personal data of every kind, next to what the documents already hold.
PII_VIEW = {
    "doc_id": "doc_id",
    "text": f"text || {NL} || " + pick("doc_id", 8, [
        "'Kontakt: max.muster' || CAST(doc_id AS STRING) || '@firma.de und info@x-y.org'", f"'Tel: +49 30 123456' || {NL} || 'Mobil 0171 5556667'",
        "'IBAN DE89 3704 0044 0532 0130 00 danke'", "'Frau Meier und Herr Lang-Schulz kommen, Mr. Smith auch'",
        f"'Mit freundlichen Grüßen' || {NL} || 'Karl ' || source", f"'---- Original Message' || {NL} || 'alt'",
        f"'From: a b' || {NL} || 'Sent: now' || {NL} || 'x'", "'nichts'"]),
}
PII_CTE = cte("v", "documents", PII_VIEW)
_CUT = r"(?i)(?:^|\n)(?:[-]{4,}\s*(?:Forwarded|Weitergeleitet|Original)\s+[Mm]essage|From:\s+[^\n]+\nSent:)"
_SIG = r"(?i)(?:^|\n)(?:[\-_*]{2,}[ \t]*(?:\n|$)|Mit\s+freundlichen?\s+Grü|Viele\s+Grü|Beste\s+Grü|Best\s+regards|Kind\s+regards)"


def _trim_sql(x: str) -> str:
    return f"rtrim({x}, ' ' || chr(10) || chr(9) || chr(13))"


def pii_sql() -> str:
    steps = [("iban", "(?i)" + V.IBAN, "[IBAN]"), ("email", "(?i)" + V.EMAIL, "[EMAIL]"),
             ("contact_label", r"(?im)^(?:Tel(?:efon)?|Fax|Mobil|Mobile|Phone|Handy|Direct)[.:]?\s*[\+\d].*$", "[SCRUBBED]"),
             ("phone", "(?i)" + V.PHONE, "[PHONE]"), ("name", V.NAME, "[NAME]")]
    sql = f"""WITH {PII_CTE},
t0 AS (SELECT doc_id, CAST(regexp_matches(text, {text(_CUT)}) AS INT) AS n_thread, CASE WHEN regexp_matches(text, {text(_CUT)}) THEN {_trim_sql(f"regexp_split_to_array(text, {text(_CUT)})[1]")} ELSE text END AS x FROM v),
t1 AS (SELECT * EXCLUDE (x), CAST(regexp_matches(x, {text(_SIG)}) AS INT) AS n_signature, CASE WHEN regexp_matches(x, {text(_SIG)}) THEN {_trim_sql(f"regexp_split_to_array(x, {text(_SIG)})[1]")} ELSE x END AS x FROM t0)"""
    for i, (kind, pattern, mark) in enumerate(steps, start=2):
        sql += (f",\nt{i} AS (SELECT * EXCLUDE (x), CAST(len(regexp_extract_all(x, {text(pattern)})) AS INT) AS n_{kind}, "
                f"regexp_replace(x, {text(pattern)}, '{mark}', 'g') AS x FROM t{i - 1})")
    return sql


PII_SQL = pii_sql()


@query("p43_pii_scrub", f"{PII_SQL} SELECT doc_id, sha256(trim(x, ' ' || chr(10) || chr(9))) AS scrubbed FROM t6")
def p43(spark, d):
    return pii.scrub(view(spark, d, "documents", PII_VIEW)).select("doc_id", F.sha2("scrubbed", 256).alias("scrubbed"))


@query("p44_pii_counts", f"{PII_SQL} SELECT doc_id, n_thread, n_signature, n_iban, n_email, n_contact_label, n_phone, n_name FROM t6")
def p44(spark, d):
    return pii.scrub(view(spark, d, "documents", PII_VIEW)).select("doc_id", *[f"n_{k}" for k in V.KINDS])


@query("p45_safe_gate", f"""{PII_SQL}, g AS (SELECT doc_id, trim(regexp_replace(regexp_replace(x, '{V.PLACEHOLDER}', '', 'g'), '\\s+', ' ', 'g')) AS u FROM t6)
SELECT doc_id, length(u) >= 150 AND NOT regexp_matches(u, {text(V.EMAIL)}) AND NOT regexp_matches(u, {text(V.PHONE)}) AND NOT regexp_matches(u, {text('(?i)' + V.IBAN_LEFT)}) AS safe FROM g""")
def p45(spark, d):
    return pii.scrub(view(spark, d, "documents", PII_VIEW)).select("doc_id", "safe")


@query("p46_best_score", f"WITH {CORPUS_CTE} SELECT id, coalesce(nullif(llm_score, 0), nullif(fit_score, 0), nullif(pre_eval_score, 0), 0) AS score FROM c")
def p46(spark, d):
    from ..operators.corpus import best_score
    return corpus(spark, d).select("id", best_score(F.col("llm_score"), F.col("fit_score"), F.col("pre_eval_score")).alias("score"))


@query("p47_reference_metadata", f"""WITH {BODY_CTE} SELECT doc_id, trim(regexp_extract(body, '^#\\s+([^\\n]+)', 1)) AS title,
 trim(regexp_extract(body, '(?i)Position:\\s*([^\\n]+)', 1)) AS position, trim(regexp_extract(body, '(?i)Ref\\.?\\s*:\\s*([^\\n]+)', 1)) AS reference_number FROM b""")
def p47(spark, d):
    return bodies(spark, d).select("doc_id", M.reference_metadata(F.col("body")).alias("v")).select("doc_id", "v.*")


@query("p48_score_upsert", """SELECT user_id AS project_id, event_type AS kind, arg_max(CAST(floor(value) AS BIGINT), (ts, event_id)) AS score FROM events GROUP BY user_id, event_type""")
def p48(spark, d):
    facts = table(spark, d, "events").select(
        F.col("user_id").alias("project_id"), F.col("event_type").alias("kind"),
        F.floor("value").alias("score"), F.struct("ts", "event_id").alias("ts"))
    early = F.col("ts.ts") < F.lit(dt.datetime(2024, 1, 20))
    return evaluation.upsert_scores(facts.where(early), facts.where(~early)).drop("ts")


@query("p49_evaluation_fact", f"""WITH {CORPUS_CTE} SELECT id AS project_id, pre_eval_score, fit_score, CASE WHEN fit_score >= 85 THEN 'accepted' ELSE 'rejected' END AS decision,
 CASE WHEN id % 2 = 0 THEN '- ' || company || {NL} || '- ' || status ELSE trim(title) END AS rationale FROM (SELECT * REPLACE (coalesce(company, '?') AS company) FROM c)""")
def p49(spark, d):
    df = corpus(spark, d).withColumn("company", F.coalesce("company", F.lit("?"))).select(
        F.col("id").alias("project_id"), "pre_eval_score", F.lit("k").alias("pre_rationale"), "fit_score",
        F.when(F.col("fit_score") >= 85, "accepted").otherwise("rejected").alias("decision"),
        F.when(F.col("id") % 2 == 0, F.array("company", "status")).otherwise(F.array().cast("array<string>")).alias("rationale_list"),
        F.col("title").alias("rationale"))
    return evaluation.evaluation_fact(df, NOW).select("project_id", "pre_eval_score", "fit_score", "decision", "rationale")
