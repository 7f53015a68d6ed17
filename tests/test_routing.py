"""The ingestion pass over several runs, and its streaming form."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from postflow.model import CLASSES, FEED_ENTRY
from postflow.operators import lifecycle
from postflow.plans import routing
from postflow.plans.routing import Setup, State
from postflow.sources import config
from postflow.streaming import ingest as SI, lifecycle as SL

NOW = dt.datetime(2026, 10, 10)
FEED_A, FEED_B = "https://x.de/a.xml", "https://x.de/b.xml"


def groups(terms_a=("Power BI",)):
    def one(terms, feeds, priority):
        return {"priority": priority, "filters": {"include_terms": list(terms)},
                "providers": {"freelancermap": {"channels": {"rss": {"feed_urls": feeds, "limit": 25, "max_age_days": 7}}}}}
    return config.load_groups({"search_groups": {"a": one(terms_a, [FEED_A, FEED_B], 1), "b": one(["Firewall*"], [FEED_A], 2)}}, ["Arzt"])


ENTRIES = [
    (FEED_A, 1, "https://x.de/p/1?ref=rss", "BI Berater", "", NOW),
    (FEED_A, 2, "https://x.de/p/2", "Power BI und Firewalls", "", NOW),
    (FEED_A, 3, "https://x.de/p/3", "Arzt gesucht", "", NOW),
    (FEED_A, 4, "https://x.de/p/4", "Koch", "", None),
    (FEED_A, 5, "https://x.de/p/5", "Seite fehlt", "", NOW),
    (FEED_A, 6, "https://x.de/p/6", "Altbestand", "", NOW),
    (FEED_A, 7, "https://x.de/p/7", "zu alt", "", NOW - dt.timedelta(days=30)),
    (FEED_A, 8, " ", "ohne Link", "", NOW),
    (FEED_B, 1, "https://x.de/p/1?ref=other#top", "BI Berater", "", NOW),
]
PAGES = [("https://x.de/p/1", "BI Berater", "Berichte mit Power BI"), ("https://x.de/p/2", "Power BI und Firewalls", "beides"),
         ("https://x.de/p/4", "Koch", "Küche")]


def frames(spark, entries=ENTRIES, pages=PAGES):
    e = spark.createDataFrame([("freelancermap", *r) for r in entries], FEED_ENTRY)
    p = spark.createDataFrame([(*r, None) for r in pages], "url_key string, page_title string, description string, schlagworte string")
    return e, p


def first_state(spark):
    empty = routing.empty_state(spark)
    from postflow.functions import urls
    known = spark.createDataFrame([("https://x.de/p/6",)], "u string").select(urls.project_id(F.col("u"), F.lit("")).alias("project_id"))
    return State(empty.ledger, empty.decisions, known, empty.postings)


def by_entry(result):
    return {(r.feed[-5], r.entry_ord): r.entry_class for r in result.classes.collect()}


@pytest.fixture(scope="module")
def first_run(spark):
    entries, pages = frames(spark)
    return routing.run(entries, first_state(spark), pages, Setup(groups(), NOW, ["Arzt"]))


def test_every_entry_has_one_class(first_run):
    got = by_entry(first_run)
    assert got == {("a", 1): "new", ("a", 2): "new", ("a", 3): "filtered", ("a", 4): "filtered", ("a", 5): "errors",
                   ("a", 6): "known", ("b", 1): "known"}
    assert set(got.values()) <= set(CLASSES)


def test_postings_and_actions(first_run):
    postings = {r.title: r for r in first_run.state.postings.collect()}
    assert set(postings) == {"BI Berater", "Power BI und Firewalls"}
    assert postings["Power BI und Firewalls"].search_groups == ["a", "b"] and len(postings["BI Berater"].sources) == 1
    assert sorted((r.group_id, r.action) for r in first_run.actions.collect()) == [("a", "created"), ("a", "created"), ("b", "merged")]


def test_ledger_and_rejections(first_run):
    ledger = {r.url_key[-1]: (r.status, r.basis, r.errors) for r in first_run.state.ledger.collect()}
    assert ledger == {"1": ("captured", "page", 0), "2": ("captured", "page", 0), "3": ("filtered", "rss_title", 0),
                      "4": ("filtered", "page", 0), "5": ("error", None, 1), "6": ("existing", "existing", 0)}
    rejected = sorted((r.search_group_id, r.provider_url[-1], r.failed_criteria[0]) for r in first_run.rejections.collect()
                      if r.provider_url[-1] in "34")
    assert rejected == [("a", "3", "rss_title_prefilter"), ("a", "4", "include_terms"), ("b", "3", "rss_title_prefilter"), ("b", "4", "include_terms")]


def test_second_run_changes_only_last_seen(spark, first_run):
    entries, pages = frames(spark)
    later = NOW + dt.timedelta(days=1)
    again = routing.run(entries, first_run.state, pages, Setup(groups(), later, ["Arzt"]))
    classes = by_entry(again)
    assert "new" not in classes.values() and classes[("a", 5)] == "errors" and classes[("a", 1)] == "known"

    def rows(df, *drop):
        return sorted(map(str, df.drop(*drop).select(sorted(set(df.columns) - set(drop))).collect()))
    assert rows(again.state.decisions) == rows(first_run.state.decisions)
    assert rows(again.state.postings) == rows(first_run.state.postings)
    assert rows(again.state.ledger, "last_seen", "errors") == rows(first_run.state.ledger, "last_seen", "errors")
    assert again.state.ledger.where("url_key like '%5'").first().errors == 2


def test_failed_page_is_retried(spark, first_run):
    entries, pages = frames(spark, pages=PAGES + [("https://x.de/p/5", "jetzt da", "Power BI")])
    again = routing.run(entries, first_run.state, pages, Setup(groups(), NOW, ["Arzt"]))
    assert by_entry(again)[("a", 5)] == "new"
    assert again.state.ledger.where("url_key like '%5'").first().status == "captured"


def test_rule_change_reopens_filtered_only(spark, first_run):
    changed = Setup(groups(("Power BI", "Küche")), NOW, ["Arzt"])
    entries, pages = frames(spark)
    again = routing.run(entries, first_run.state, pages, changed)
    assert by_entry(again)[("a", 4)] == "new" and by_entry(again)[("a", 1)] == "known"
    # Out of the feed: only a replay takes it up.
    gone, pages = frames(spark, entries=ENTRIES[:1])
    assert by_entry(routing.run(gone, first_run.state, pages, changed)) == {("a", 1): "known"}
    replayed = routing.run(gone, first_run.state, pages, changed, replay=True)
    labels = {r.url_key[-1]: r.entry_class for r in replayed.classes.where("label = 'NEUBEWERTUNG'").collect()}
    assert labels == {"3": "filtered", "4": "new"}


def test_work_cap_defers_the_rest(spark):
    entries, pages = frames(spark)
    result = routing.run(entries, first_state(spark), pages, Setup(groups(), NOW, ["Arzt"], max_page_reads=2))
    got = by_entry(result)
    assert got[("a", 1)] == got[("a", 2)] == "new" and got[("a", 4)] == got[("a", 5)] == "deferred"
    assert result.state.decisions.where("url_key like '%4'").count() == 0


def test_expiry(spark, first_run):
    entries, pages = frames(spark, entries=ENTRIES[1:2])
    later = routing.run(entries, first_run.state, pages, Setup(groups(), NOW + dt.timedelta(days=200), ["Arzt"]))
    # The entry is too old by then, and so is everything seen 200 days ago.
    assert later.state.ledger.count() == 0 and later.state.decisions.count() == 0


def test_unsuitable_postings_are_rejected(spark):
    rules = {"groups": {}, "common": {"unsupported_must_haves": [{"label": "BI", "terms": ["Berater"]}]}, "reject_score_cap": 10}
    entries, pages = frames(spark, entries=ENTRIES[:2], pages=[("https://x.de/p/1", "BI Berater", "Power BI\nProfil:\nBerater"), PAGES[1]])
    result = routing.run(entries, first_state(spark), pages, Setup(groups(), NOW, suitability_rules=rules))
    assert {r.title: r.state for r in result.state.postings.collect()} == {"BI Berater": "rejected", "Power BI und Firewalls": "scraped"}


def test_stream_batches_are_idempotent(spark, tmp_path):
    entries, pages = frames(spark)
    entries.write.parquet(str(tmp_path / "landing"))
    store = SI.SnapshotStore(spark, str(tmp_path / "state"))
    setup = Setup(groups(), NOW, ["Arzt"])
    SI.ingest(spark, str(tmp_path / "landing"), store, lambda: pages, setup, str(tmp_path / "cp")).awaitTermination()
    assert store.complete(1) and not store.complete(2)
    assert store.read(1).ledger.count() == 6 and store.table("classes").where("entry_class = 'new'").count() >= 2
    before = sorted(map(str, store.read(1).decisions.collect()))
    SI.batch_writer(store, lambda: pages, setup)(entries, 0)  # a repeated batch does nothing
    assert sorted(map(str, store.read(1).decisions.collect())) == before
    with pytest.raises(ValueError):
        store.read(2)


def test_state_stream_equals_batch_fold(spark, tmp_path):
    rows = [(i % 5, NOW + dt.timedelta(minutes=i), i, ["evaluated", "accepted", "applied", "sent", "scraped"][(i * 7) % 5], i % 11 == 0) for i in range(200)]
    events = spark.createDataFrame(rows, "project_id long, ts timestamp, event_id long, to_state string, force boolean")
    events.write.parquet(str(tmp_path / "in"))
    log = SL.state_log(str(tmp_path / "log"), events)
    SL.fold_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), log, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.event_id: (r.accepted, r.state) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.event_id: (r.accepted, r.state) for r in lifecycle.fold_states(events, "project_id", ["ts", "event_id"]).collect()}
    assert got == want
