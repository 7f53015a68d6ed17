"""Operators against brute force and against cases with known results."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from postflow.functions import terms as T
from postflow.model import STATES, TRANSITIONS
from postflow.operators import (corpus, evaluation, ledger, lifecycle, matching, migration, ordered, pages,
                                retention, similarity, suitability)
from postflow.sources import config, feeds, frontmatter as FM

NOW = dt.datetime(2026, 10, 10, 12)


# --- Ordered work with a hot key ----------------------------------------------------------

@pytest.fixture(scope="module")
def hot_rows():
    rng = random.Random(7)
    keys = ["hot"] * 400 + [f"k{i % 40}" for i in range(600)]
    return [(k, i // 3, i, rng.randint(0, 9)) for i, k in enumerate(rng.sample(keys, len(keys)))]


def test_running_sum_equals_brute_force(spark, hot_rows):
    df = spark.createDataFrame(hot_rows, "k string, t int, i int, v int")
    got = {r.i: r.s for r in ordered.running_sum(df, ["k"], ["t", "i"], F.col("v"), "s").collect()}
    sums, want = {}, {}
    for k, t, i, v in sorted(hot_rows, key=lambda r: (r[1], r[2])):
        sums[k] = want[i] = sums.get(k, 0) + v
    assert got == want


def test_hot_key_is_spread(spark, hot_rows):
    cut = ordered.slices(spark.createDataFrame(hot_rows, "k string, t int, i int, v int"), "t", 8)
    sizes = [r["count"] for r in cut.where("k = 'hot'").groupBy("_slice").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 250


def test_previous_equals_brute_force(spark, hot_rows):
    df = spark.createDataFrame(hot_rows, "k string, t int, i int, v int")
    got = {r.i: r.p for r in ordered.previous(df, ["k"], ["t", "i"], "v", "p").collect()}
    last, want = {}, {}
    for k, t, i, v in sorted(hot_rows, key=lambda r: (r[1], r[2])):
        want[i], last[k] = last.get(k), v
    assert got == want


def test_state_fold_equals_sequential_fold(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        target = rng.choice(STATES + ["unheard"])
        rows.append(("hot" if i % 3 == 0 else f"p{i % 17}", i // 2, i, target, rng.random() < 0.1))
    df = spark.createDataFrame(rows, "project_id string, ts int, event_id int, to_state string, force boolean")
    got = {r.event_id: (r.from_state, r.accepted, r.state) for r in lifecycle.fold_states(
        df, "project_id", ["ts", "event_id"]).collect()}
    state, want = {}, {}
    for pid, _, i, target, force in sorted(rows, key=lambda r: (r[1], r[2])):
        now = state.get(pid)
        ok = force or not now or target in TRANSITIONS.get(now, [])
        state[pid] = target if ok else now
        want[i] = (now, ok, state[pid])
    assert got == want


def test_transition_matrix(spark):
    pairs = spark.createDataFrame([("scraped", "accepted"), ("sent", "scraped"), ("archived", "scraped"), ("nix", "open")],
                                  "from_state string, to_state string")
    assert sorted(map(tuple, lifecycle.valid_pairs(pairs).collect())) == [("archived", "scraped"), ("scraped", "accepted")]


# --- Matching -------------------------------------------------------------------------------

def group(filters, gid="g"):
    return config.load_groups({"search_groups": {gid: {"providers": {"p": {"channels": {}}}, "filters": filters}}})


def checks(spark, filters, **fields):
    columns = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in fields.items())
    df = spark.createDataFrame([tuple(fields.values())], columns)
    return matching.apply_filters(df, group(filters), NOW).first()


def test_unknown_passes_unless_rejected(spark):
    row = checks(spark, {"work_mode": {"allowed": ["remote"]}}, title="x", description="nichts")
    assert row.passed and row.unknown_criteria == ["work_mode"]
    row = checks(spark, {"work_mode": {"allowed": ["remote"], "reject_if_unknown": True}}, title="x", description="nichts")
    assert not row.passed and row.failed_criteria == ["work_mode"]


def test_all_criteria_are_checked(spark):
    row = checks(spark, {"include_terms": ["Laternen Werk"], "exclude_terms": ["Vollzeit", "(kaputt"], "rate": {"min_hourly": 80},
                         "language": {"allowed": ["de"]}, "max_age_days": 5}, title="Java", description="Vollzeit (kaputt 50 €/Std English",
                 published_date="2026-10-01")
    assert row.failed_criteria == ["include_terms", "exclude_terms", "rate", "language", "max_age_days"]
    assert row.checks[2].reason == "Stundensatz 50.0€ < Minimum 80.0€"


def test_explicit_fields_win(spark):
    row = checks(spark, {"work_mode": {"allowed": ["onsite"]}, "rate": {"max_daily": 900}}, title="t", description="remote, 2.000 € / Tag",
                 work_mode="Vor Ort", daily_rate=800.0)
    assert row.passed


def test_tags_count_for_topics_only(spark):
    df = spark.createDataFrame([("t", "d", ["Aktenhort", None, ""])], "title string, description string, schlagworte array<string>")
    assert matching.apply_filters(df, group({"include_terms": ["Aktenhort"]}), NOW).first().passed
    assert matching.apply_filters(df, group({"exclude_terms": ["Aktenhort"]}), NOW).first().passed


def test_rule_table_equals_literal_rules(spark):
    words = ["Power", "BI", "power-bi", "KI", "kapital", "q7q", "Make.com", "x", "Brandmauers", "LAN/WAN", "ISO", "27001", "Öl", "é"]
    rng = random.Random(5)
    docs = [(i, "", " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(200)]
    df = spark.createDataFrame(docs, "id int, title string, description string")
    groups = group({"include_terms": ["Laternen Werk", "KI", "q7q", "Make.com", "Brandmauer*", "LAN/WAN", "ISO 27001", "Öl"]})
    literal = {(r.id, t) for r in matching.match_terms(df, groups).collect() for t in r.matched}
    table = {(r.id, r.term) for r in matching.match_rule_table(df, config.term_rules(spark, groups), "id").collect()}
    assert literal == table and literal


def test_title_prefilter(spark):
    groups = group({"include_terms": ["Laternen Werk"]})
    df = spark.createDataFrame([("Buchhalterin", "nichts"), ("Buchhalter", "mit Laternen Werk"), ("Admin", "")], "t string, s string")
    got = [r[0] for r in df.select(matching.title_prefilter(F.col("t"), F.col("s"), T.compile_terms(["Buchhalter*"]), groups)).collect()]
    assert got == ["Buchhalter*", None, None]


def test_keyword_score(spark):
    df = spark.createDataFrame([("JavaScript und Python",), ("Java",), ("nur Go",)], "t string")
    score, _ = matching.keyword_score(F.col("t"), {"forbidden_tags": ["java"], "required_tags": [], "weighted_tags": {"python": 3, "go": 4}})
    assert [r[0] for r in df.select(score).collect()] == [42, -1, 57]
    assert df.select(matching.keyword_score(F.col("t"), {})[0]).first()[0] == 100


# --- Suitability --------------------------------------------------------------------------

RULES = {
    "weights": {"high": 15, "medium": 8, "transferable": 4, "low_priority": -15},
    "caps": {"high": 45, "medium": 24, "transferable": 8, "low_priority": -45},
    "thresholds": {"high": 50, "medium": 25}, "reject_score_cap": 10, "must_have_penalty": -25,
    "groups": {
        "a": {"high": ["Laternen Werk", "Ziel-Tafel*", "Aktenhort", "Lagebericht Wesen", "Ablaufschmiede"],
              "medium": ["Tor-Kanal", "Rufhaken*"], "transferable": ["q7q"]},
        "b": {"high": ["Netz-Unterbau*", "Brandmauer*", "Zonenteilung", "Teilungsplan*"],
              "medium": ["Datenobhut*", "Obhutbauplan*", "Namens Register"],
              "low_priority": ["Geräte-Ausgabe*", "Vorort-Hilfe*"]}},
    "common": {"role": {"points": 10, "terms": ["Altmeister", "Ratgeber*"]},
               "unsupported_must_haves": [{"label": "Zorbo", "terms": ["Zorbo"]}],
               "specialist_roles": [{"label": "Cyber", "score_cap": 40, "title_terms": ["Hüterwesen"],
                                     "required_experience_terms": ["technischen Datenobhut"]}]},
    "conditions": {"work_mode": {"onsite_only": ["kein Remote"], "hybrid": ["hybrid"], "remote": ["Remote"]},
                   "score_adjustments": {"onsite_only": -20, "workload_outside": -10}},
}
CASES = {
    "bi": ("Altmeister Laternen Werk Ratgeber", "Ziel-Tafels, Aktenhort, Lagebericht Wesen. Remote, 3 Tage pro Woche"),
    "q7q": ("q7q-Gang", "Ablaufschmiede mit Tor-Kanal oder Rufhaken auf q7q"),
    "pega": ("Architekt für Zorbo", "Ablaufschmiede\nMust-Have\n- Zorbo Praxis\nNice-To-Have\n- x"),
    "pega_must": ("Architekt", "Ablaufschmiede\nMust-Have\n- Zorbo Praxis"),
    "cyber": ("Altmeister Hüterwesen Ratgeber", "Netz-Unterbauen, Brandmauers, Zonenteilung, Obhutbauplan\n"
              "**Anforderungen**\n- Erfahrung in der technischen Datenobhut"),
    "support": ("Supporter", "Geräte-Ausgabe, Vorort-Hilfe, Namens Register. kein Remote, Auslastung: Vollzeit"),
}


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame([(k, t, d) for k, (t, d) in CASES.items()], "id string, title string, description string")
    return {r.id: r.suitability for r in suitability.score(df, RULES, NOW.date()).collect()}


def test_suitability_decisions(scored):
    assert {k: v.technical.decision for k, v in scored.items()} == {
        "bi": "hoch", "q7q": "mittel", "pega": "abgelehnt", "pega_must": "niedrig", "cyber": "mittel", "support": "niedrig"}
    assert {k: v.recommendation for k, v in scored.items()} == {
        "bi": "Bewerben", "q7q": "Prüfen", "pega": "Nicht bewerben", "pega_must": "Nicht bewerben", "cyber": "Prüfen",
        "support": "Nicht bewerben"}


def test_suitability_points(scored):
    assert scored["q7q"].technical.score == 15 + 16 + 4
    assert scored["bi"].technical.score == 45 + 10
    assert scored["cyber"].technical.score == 40 and any("begrenzt" in r for r in scored["cyber"].technical.reasons)
    assert scored["pega"].score <= 10 and "Zorbo" in scored["pega"].reject_reason
    assert scored["pega_must"].technical.score == 0 and scored["pega_must"].reject_reason is None
    assert scored["support"].conditions.work_mode.status == "nicht erfüllt"
    assert scored["bi"].conditions.workload.value == "3 Tage pro Woche (24 h/Woche)"


# --- Similarity ---------------------------------------------------------------------------

def test_similarity_equals_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"wort{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for i in range(30)]
    profs = [(f"p{i}", i, " ".join(rng.choice(vocabulary[:20]) for _ in range(15))) for i in range(4)]

    def tf(text):
        tokens = text.split()
        return {t: tokens.count(t) / len(tokens) for t in tokens}
    df = {}
    for _, _, text in profs:
        for t in set(text.split()):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(5 / (n + 1)) + 1 for t, n in df.items()}
    vec = {p: {t: w * idf[t] for t, w in tf(text).items()} for p, _, text in profs}

    def norm(v):
        return math.sqrt(sum(x * x for x in v.values()))
    want = {}
    for i, text in docs:
        v = {t: w * idf.get(t, 1.0) for t, w in tf(text).items()}
        scores = [(round(sum(v.get(t, 0) * w for t, w in vec[p].items()) / (norm(v) * norm(vec[p])), 4) if v else 0.0) for p, _, _ in profs]
        best = max(range(4), key=lambda k: scores[k])
        want[i] = (profs[best][0] if scores[best] > 0 else None, max(scores) if v else 0.0)
    got = similarity.pre_score(spark.createDataFrame(docs, "id int, text string"),
                               spark.createDataFrame(profs, "profile_id string, profile_ord int, text string"), "id").collect()
    assert {r.id: r.best_profile for r in got} == {k: v[0] for k, v in want.items()}
    assert all(abs(r.best_score - want[r.id][1]) < 1e-4 for r in got) and len(got) == 30


# --- Documents and migration ---------------------------------------------------------------

DOC = """---
schema_version: 2
project_id: url-abc
title: 'It''s: a title'
state: accepted
search_groups:
- a
- b
sources:
- provider: gulp
  url: https://x.de/1
  discovered_at: '2026-01-01'
state_history:
- state: scraped
  timestamp: '2026-01-01T00:00:00'
- state: accepted
  timestamp: '2026-01-02T00:00:00'
  override: true
note: some folded
  text
---

# Body
--- not a border"""


def test_document_round_trip(spark):
    df = spark.createDataFrame([("p", DOC)], "path string, content string")
    first = FM.to_records(FM.parse(df)).first()
    assert first.title == "It's: a title" and first.search_groups == ["a", "b"] and first.sources[0].url == "https://x.de/1"
    assert first.state_history[1].override is True and first.extra == {"note": "some folded text"}
    assert first.body == "\n# Body\n--- not a border"
    again = FM.to_records(FM.parse(FM.to_front_matter(FM.to_records(FM.parse(df))).select("path", "content"))).first()
    assert again.title == first.title and again.sources == first.sources and again.state_history == first.state_history
    assert again.extra == first.extra


def test_bad_headers(spark):
    df = spark.createDataFrame([("a", "no header"), ("b", "---\nopen: 1\ntext"), ("c", "---\n: [bad\n---\nbody"), ("d", "---\n---\nx")],
                               "path string, content string")
    rows = {r.path: (r.header, r.body) for r in FM.parse(df).collect()}
    assert rows == {"a": ({}, "no header"), "b": ({}, "---\nopen: 1\ntext"), "c": ({}, "body"), "d": ({}, "x")}


def test_upgrade_and_collision(spark, tmp_path):
    v1 = "---\ntitle: {t}\nprovider: p\nprovider_url: {u}\n---\nx"
    docs = [("1", v1.format(t="A", u="https://x.de/1")), ("2", v1.format(t="B", u="https://x.de/2")), ("3", DOC)]
    df = spark.createDataFrame(docs, "path string, content string")
    target = str(tmp_path / "v2")
    migration.upgrade(df, target, dry_run=False)
    again = spark.read.parquet(target)
    assert again.count() == 3 and again.where("size(sources) = 1").count() == 3
    assert {r.version: r.n for r in migration.version_inventory(FM.parse(df)).collect()} == {"v1": 2, "v2": 1}
    clash = df.unionByName(spark.createDataFrame([("4", v1.format(t="C", u="https://X.de/1/?q=1"))], "path string, content string"))
    with pytest.raises(migration.IdCollision):
        migration.upgrade(clash)


# --- Configuration, feeds, ledger, evaluation, retention, corpus ------------------------------

def test_group_loading():
    groups = config.load_groups({"search_groups": {
        "late": {"priority": 20, "providers": {"p": {"channels": {"rss": {"feed_urls": ["u"]}}}}},
        "early": {"priority": 1, "enabled": False, "providers": {"p": {"channels": {"rss": {"feed_urls": ["u"], "limit": 3}}}}}}})
    assert [g.group_id for g in groups] == ["early", "late"] and [g.group_id for g in config.active_groups(groups)] == ["late"]
    with pytest.raises(ValueError, match="feed_urls.*|provider"):
        config.load_groups({"search_groups": {"x": {"providers": {}}, "y": {"providers": {"p": {"channels": {"rss": {}}}}}}})
    merged = config.overlay_defaults({"a": {}, "b": {"filters": {"include_terms": []}}}, {"a": {"include_terms": ["T"]}, "b": {"include_terms": ["T"]}})
    assert merged["a"]["filters"]["include_terms"] == ["T"] and merged["b"]["filters"]["include_terms"] == []


def test_feed_limit_before_age(spark):
    rows = [("f", i, NOW - dt.timedelta(days=20 if i < 2 else 0)) for i in range(5)] + [("f", 5, None)]
    df = spark.createDataFrame(rows, "feed string, entry_ord long, published timestamp")
    assert [r.entry_ord for r in feeds.scan(df, NOW, 3, 7).collect()] == [2]
    assert feeds.scan(df, NOW, 10, 0).count() == 6 and feeds.recent(df, NOW, 7).count() == 4


def test_read_feed_xml_and_mail(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "de.xml").write_text(
        "<rss><channel><item><title>A</title><link>https://x.de/1</link><pubDate>Mon, 05 Oct 2026 10:00:00 +0000</pubDate></item>"
        "<item><link>https://x.de/2</link></item></channel></rss>", encoding="utf-8")
    rows = feeds.read_feed_xml(spark, str(tmp_path / "f")).orderBy("entry_ord").collect()
    assert [r.title for r in rows] == ["A", "No Title"] and rows[0].published == dt.datetime(2026, 10, 5, 10)
    box = tmp_path / "mail" / "inbox"
    box.mkdir(parents=True)
    (box / "1.eml").write_bytes(b"From: a@x.de\nSubject: Neu\nDate: Mon, 05 Oct 2026 10:00:00 +0200\nContent-Type: text/html\n\n<a href='http://x.de'>y</a>")
    row = feeds.read_messages(spark, str(box)).first()
    assert (row.mailbox, row.sender, row.ts) == ("inbox", "a@x.de", dt.datetime(2026, 10, 5, 8)) and "href" in row.html


def test_decision_validity(spark):
    rows = [("captured", "old", None), ("existing", "old", None), ("filtered", "old", None), ("filtered", "now", None), ("captured", "now", "error")]
    df = spark.createDataFrame(rows, "d string, t string, s string")
    got = [r[0] for r in df.select(ledger.valid_decision(F.col("d"), F.col("t"), F.lit("now"), F.coalesce("s", F.lit("")))).collect()]
    assert got == ["captured", "existing", None, "filtered", None]


def test_budget_admission(spark):
    df = spark.createDataFrame([(f"p{i}", c) for i, c in enumerate([0.01, 0.02, 0.5, 0.03, 0.01])], "project_id string, est_cost double") \
        .withColumn("est_cost", F.col("est_cost").cast("decimal(18,6)"))
    log = spark.createDataFrame([("2026-10-10T01:00:00", 0.94)], "timestamp string, cost_usd double").withColumn("cost_usd", F.col("cost_usd").cast("decimal(18,6)"))
    limits = evaluation.Limits(daily_budget=1.0, monthly_budget=20.0, max_calls_per_run=10)
    rows = {r.project_id: r.budget_reason for r in evaluation.admit(df, log, NOW.date(), ["project_id"], limits).collect()}
    assert rows == {"p0": None, "p1": None, "p2": "cost per call", "p3": None, "p4": "run, day or month limit"}


def test_settlement(spark):
    log = spark.createDataFrame([("reserved", "r1", 5.0), ("reserved", "r2", 5.0), ("actual", "", 1.0)], "type string, reservation_id string, cost_usd double")
    actual = spark.createDataFrame([("actual", "r1", 2.0), ("actual", "r9", 3.0), ("actual", "", 4.0)], "type string, reservation_id string, cost_usd double")
    got = sorted((r.type, r.reservation_id, r.cost_usd) for r in evaluation.settle(log, actual).collect())
    assert got == [("actual", "", 1.0), ("actual", "", 4.0), ("actual", "r1", 2.0), ("actual", "r9", 3.0), ("reserved", "r2", 5.0)]


def test_retention(spark):
    rows = [("projects/a_20261001_000000.md", NOW, "scraped", 0, 0), ("projects/b_20261009_000000.md", NOW, "scraped", 0, 0),
            ("projects/c_20261005_000000.md", NOW, "rejected", 50, 20), ("projects/d_20261005_000000.md", NOW, "rejected", 50, 90),
            ("venv/x.log", NOW - dt.timedelta(days=99), None, 0, 0), ("logs/x.log", NOW - dt.timedelta(days=99), None, 0, 0)]
    df = spark.createDataFrame(rows, "path string, mtime timestamp, state string, pre int, fit int").withColumn(
        "category", retention.file_category(F.col("path"), retention.posting_category(F.col("state"), F.col("pre"), F.col("fit"))))
    got = retention.purge_candidates(df, NOW)
    assert sorted(r.category for r in got.collect()) == ["logs", "rejected_low_llm", "scraped"]
    assert [r.category for r in retention.purge_set(got, 2).collect()] == ["logs", "scraped"]


def test_corpus_filter_semantics(spark):
    rows = [(1, "Alpha", None, "2026-10-01T08:00:00", 10, None, ["a"]), (2, "Beta", "Acme", None, None, 0, []), (3, "beta", "x", "2026-09-01", 0, 50, ["b"])]
    view = spark.createDataFrame(rows, "id int, title string, company string, retrieval_date string, pre_eval_score int, llm_score int, search_groups array<string>") \
        .withColumns({"status": F.lit("scraped"), "provider_name": F.lit(None).cast("string"), "evaluation_status": F.lit(None).cast("string")})

    def ids(**f):
        return sorted(r.id for r in corpus.corpus_query(view, corpus.CorpusFilter(**f)).collect())
    assert ids() == [1, 2, 3] and ids(search="BETA") == [2, 3] and ids(search="acme") == [2]
    assert ids(date_from="2026-09-15") == [1] and ids(date_to="2026-12-01") == [1, 3]
    assert ids(pre_eval_score_min=0) == [1, 3] and ids(llm_score_max=10) == [2]
    assert ids(providers=["FreelancerMap"]) == [1, 2, 3] and ids(evaluation_statuses=["not_evaluated"]) == [1, 2, 3]
    assert ids(search_groups=["a", "z"]) == [1]
    info = corpus.page_info(view, 1, 2).first()
    assert (info.total, info.has_next, info.has_prev) == (3, True, False)
    f = corpus.resolve_dates(corpus.CorpusFilter(date_from="previous_week"), dt.date(2026, 10, 10))
    assert (f.date_from, f.date_to) == ("2026-09-28", "2026-10-04")


def test_page_fields(spark):
    html = ("<html><head><title>T - Seite</title><script>var x='</p><h1>no</h1>'</script></head><body><h1>Titel &amp; mehr</h1>"
            "<!-- <h2>Beschreibung</h2> --><h2>Beschreibung</h2><p>Erste <b>Zeile</b><br>zwei</p><ul><li>A</li><li></li></ul><h3>Ende</h3><p>z</p>"
            "<dt>Start</dt><dd>:</dd><dd>sofort</dd><b>Ansprechpartner:</b><i>Frau</i><i>Muster</i><span class='keyword'>SQL</span>"
            "<span class='keyword'>SQL</span><span class='keyword'>7</span></body></html>")
    df = spark.createDataFrame([("https://x.de/projekt-123.html?x=1", html)], "url string, html string")
    row = pages.parse_pages(df).first()
    assert row.title == "Titel & mehr" and row.reference_id == "123" and row.schlagworte == ["SQL"]
    assert row.description == "Erste **Zeile**\nzwei\n\n- A"
    assert row.details == {"Start": "sofort", "Ansprechpartner": "Frau Muster"}


def _profile_tables(spark, n_docs, n_profiles, seed, words=120):
    r = random.Random(seed)
    vocabulary = [f"wort{k}" for k in range(words)]
    text = lambda n: " ".join(r.choice(vocabulary[:r.choice((12, words))]) for _ in range(n))
    docs = [(k, text(r.randint(0, 40))) for k in range(n_docs)] + [(n_docs, "nichts davon"), (n_docs + 1, None)]
    profiles = [(f"p{k}", k, text(r.randint(1, 12))) for k in range(n_profiles)]
    profiles += [(f"c{k}", n_profiles + k, profiles[k % 5][2]) for k in range(20)]  # ties
    return (spark.createDataFrame(docs, "id int, text string").repartition(4),
            spark.createDataFrame(profiles, "profile_id string, profile_ord int, text string"))


@pytest.mark.parametrize("seed", [1, 2])
def test_profile_search_equals_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(similarity, "CHAMPIONS", 1 + 3 * (seed - 1))
    docs, profiles = _profile_tables(spark, 150, 80, seed)
    want = sorted(map(tuple, similarity.best_profiles(docs, profiles, "id").collect()))
    got = sorted(map(tuple, similarity.search_profiles(docs, similarity.build_index(profiles), "id").collect()))
    assert got == want and len(got) == 152 and got[150][1] is None
    full = {r.id: (r.best_profile, r.best_score) for r in similarity.pre_score(docs, profiles, "id").collect()}
    assert full == {w[0]: w[1:3] for w in want}


def test_ten_times_the_profiles_are_far_from_ten_times_the_pairs(spark):
    """Texts and profiles on themes, with common words in all of them."""
    r = random.Random(7)
    text = lambda theme, n: " ".join(f"allgemein{r.randint(0, 20)}" if r.random() < 0.3 else f"t{theme}w{r.randint(0, 15)}" for _ in range(n))
    docs = spark.createDataFrame([(k, text(r.randint(0, 99), 60)) for k in range(100)], "id int, text string")
    pairs, scored = [], []
    for n in (100, 1000):
        profiles = spark.createDataFrame([(f"p{k}", k, text(k % (n // 2), 25)) for k in range(n)], "profile_id string, profile_ord int, text string")
        index = similarity.build_index(profiles)
        scored.append(similarity.candidates(similarity.document_terms(docs, index, "id"), index, "id").count())
        pairs.append(similarity.scores(docs, profiles, "id", top_n=0).where("profile_id is not null").count())
    assert pairs[1] > 8 * pairs[0] and scored[1] < 3 * scored[0] and scored[1] < pairs[1] / 20


def test_essential_terms_reach_the_floor():
    r = random.Random(3)
    for _ in range(200):
        ub = sorted((r.random() for _ in range(r.randint(0, 8))), reverse=True)
        floor = r.uniform(-0.5, 4)
        xs = [u / r.uniform(0.5, 1) for u in ub]
        n = similarity.essential(similarity.np.array(ub), similarity.np.array(xs), floor)
        reach = lambda k: min(sum(ub[k:]), math.sqrt(sum(x * x for x in xs[k:])))
        assert reach(n) < floor or n == len(ub)
        assert not n or reach(n - 1) >= floor - 1e-6


def _plain_fold(events):
    """{event: (from_state, accepted, state)} by a loop over each posting's events."""
    from postflow.model import TRANSITIONS

    state, out = {}, {}
    for key, ts, event, target, force in sorted(events, key=lambda e: (str(e[0]), e[1], e[2])):
        now = state.get(key)
        ok = bool(force) or not now or target in TRANSITIONS.get(now, ())
        out[event] = (now, ok, target if ok else now)
        state[key] = out[event][2]
    return out


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_fold_of_a_hot_posting_equals_a_loop(spark, batch):
    from postflow.model import STATES

    r = random.Random(11)
    names = [*STATES, "fremd", "anders"]
    events = [("hot" if r.random() < 0.4 else f"p{r.randint(0, 30)}", r.randint(0, 500), k, r.choice(names), r.random() < 0.1) for k in range(1500)]
    table = spark.createDataFrame(events, "k string, ts int, event_id int, to_state string, force boolean").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {x.event_id: (x.from_state, x.accepted, x.state) for x in lifecycle.fold_states(table, "k", ["ts", "event_id"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == _plain_fold(events)


def test_ledger_files_with_the_same_url(spark):
    def content(seen, decision):
        return '{"version": 1, "entries": {"u": {"last_seen": "%s", "status": "filtered", "groups": {"a": {"decision": "%s"}}}}}' % (seen, decision)
    files = spark.createDataFrame([(1, content("2024-01-01T00:00:00", "filtered")), (2, content("2024-01-02T00:00:00", "captured")), (3, '{"entries": ')],
                                  "file int, value string")
    entries, decisions = ledger.from_json(files)
    rows = entries.join(decisions, ["file", "url_key"]).select("file", F.dayofmonth("last_seen").alias("day"), "decision").collect()
    assert sorted(map(tuple, rows)) == [(1, 1, "filtered"), (2, 2, "captured")]
